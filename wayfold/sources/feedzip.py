"""Feed archives as a data source: spark.read.format("feedzip") over zip files of CSV tables, and a writer of such archives.

Each archive's member is a partition of its own and is streamed: neither the archive nor the table is ever held whole. Paths are those of a file system that all executors mount;
for stores that only Spark reads, gtfs.read_table takes the archive through Spark.

Options: path (a folder, an archive, or several joined by commas), table (its name without .txt). The schema gives the columns, all strings, that are
taken from a row; three more may be named: _feed, the archive's name; _line, the row's line; _fault, what is wrong with it:

  ragged            the row has more or fewer fields than the header; those it has are given
  repeated_column   the header has a column twice (line 1); the first one is taken
  missing_column:c  the header has no column c, which the table must have (line 1)
  no_rows           nothing follows the header (line 1)
  missing_table     the archive has no such member (line 0)
  unreadable        the archive or its text cannot be read (the line reached)

Rows of faults other than `ragged` hold no values. Without _fault in the schema they are left out, ragged rows are kept. Blank lines are skipped; a
byte-order mark and blanks around header names are dropped.
"""

from __future__ import annotations

import csv
import io
import os
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfold.sources.gtfs import REQUIRED

BATCH_ROWS = 10_000
EXTRA = {"_feed": pa.string(), "_line": pa.int64(), "_fault": pa.string()}


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def archives(path: str) -> list[str]:
    """The zip files that a path option names, in order."""
    found = []
    for p in map(local, filter(None, (x.strip() for x in path.split(",")))):
        found += sorted(os.path.join(p, f) for f in os.listdir(p) if f.endswith(".zip")) if os.path.isdir(p) else [p]
    return found


@dataclass
class Member(InputPartition):
    archive: str
    table: str


class FeedReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str]):
        self.path, self.table, self.columns = path, table, columns

    def partitions(self) -> list[Member]:
        return [Member(a, self.table) for a in archives(self.path)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in self._rows(partition):
            held.append(row)
            if len(held) == BATCH_ROWS:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(x, EXTRA.get(c, pa.string())) for c, x in zip(self.columns, zip(*rows, strict=True), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, self.columns)

    def _rows(self, member: Member) -> Iterator[tuple]:
        feed, faults = os.path.basename(member.archive), "_fault" in self.columns

        def told(line: int, fault: str | None, values: dict[str, str | None] | None = None) -> tuple:
            own = {"_feed": feed, "_line": line, "_fault": fault, **(values or {})}
            return tuple(own.get(c) for c in self.columns)

        line = 0
        try:
            with zipfile.ZipFile(member.archive) as z:
                if f"{member.table}.txt" not in z.namelist():
                    if faults:
                        yield told(0, "missing_table")
                    return
                rows = csv.reader(io.TextIOWrapper(z.open(f"{member.table}.txt"), "utf-8-sig", newline=""))
                header = [h.strip() for h in next(rows, [])]
                line = 1
                at = {c: header.index(c) for c in self.columns if c not in EXTRA and c in header}
                if faults:
                    yield from (told(1, f"missing_column:{c}") for c in REQUIRED.get(member.table, ()) if c not in header)
                    if len(set(header)) < len(header):
                        yield told(1, "repeated_column")
                some = False
                for row in rows:
                    line = rows.line_num
                    if not any(row):
                        continue
                    some = True
                    values = {c: row[k] if k < len(row) else None for c, k in at.items()}
                    yield told(line, "ragged" if len(row) != len(header) else None, values)
                if not some and faults:
                    yield told(1, "no_rows")
        except (OSError, zipfile.BadZipFile, UnicodeDecodeError, csv.Error):
            if not faults:
                raise
            yield told(line, "unreadable")


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feedzip"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in (*REQUIRED.get(self.options["table"], ()), "_feed"))

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options["path"], self.options["table"], schema.fieldNames())


def read(spark: SparkSession, path: str, table: str, columns: list[str], faults: bool = False) -> DataFrame:
    """One table of all archives: the columns and _feed, with faults also _line and _fault."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package installed
    spark.dataSource.register(FeedSource)
    schema = ", ".join([*(f"{c} string" for c in columns), "_feed string", *(["_line long", "_fault string"] if faults else [])])
    return spark.read.format("feedzip").schema(schema).option("table", table).load(path)


def write_archives(df: DataFrame, feed: str, table: str, folder: str, raw: bool = False) -> DataFrame:
    """(feed, path, rows): each feed's rows as the table of an archive '<feed>' in a folder that all executors mount.

    Rows stream to the archive of their partition, which holds one feed or several, sorted; an archive appears under its name when it is whole.
    raw: fields are joined by commas as they are, without quotes.
    """
    columns, target = [c for c in df.columns if c != feed], local(folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(target, exist_ok=True)
        now, n, z, out = None, 0, None, None

        def close() -> tuple[str, str, int]:
            out.close()
            z.close()
            os.replace(f"{target}/.{now}", f"{target}/{now}")
            return now, f"{target}/{now}", n

        done = []
        for part in parts:
            for name, rows in part.groupby(feed, sort=True):
                if name != now:
                    if z is not None:
                        done.append(close())
                    now, n = name, 0
                    z = zipfile.ZipFile(f"{target}/.{now}", "w", zipfile.ZIP_DEFLATED)
                    out = z.open(f"{table}.txt", "w", force_zip64=True)
                    out.write((",".join(columns) + "\n").encode())
                if raw:
                    out.writelines(f"{','.join(r)}\n".encode() for r in rows[columns].fillna("").itertuples(index=False, name=None))
                else:
                    out.write(rows[columns].to_csv(index=False, header=False, lineterminator="\n").encode())
                n += len(rows)
        if z is not None:
            done.append(close())
        yield pd.DataFrame(done, columns=["feed", "path", "rows"])

    return df.repartition(feed).sortWithinPartitions(feed, *columns).mapInPandas(run, "feed string, path string, rows long")
