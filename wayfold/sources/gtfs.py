"""Feed archives: zip files of CSV tables, read as all-string DataFrames."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = {"stops": ("stop_id",), "routes": ("route_id",), "trips": ("route_id", "service_id", "trip_id"), "stop_times": ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time")}
BATCH = 20_000


def read_table(spark: SparkSession, paths: list[str], name: str, columns: list[str]) -> DataFrame:
    """One table of every archive: `columns` as strings (null where the file lacks one), and feed, the archive's name.

    Header names are trimmed and lose a byte-order mark. An archive without the table gives no rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if f"{name}.txt" not in z.namelist():
                        continue
                    rows = csv.reader(io.TextIOWrapper(z.open(f"{name}.txt"), "utf-8-sig", newline=""))
                    header = [h.strip() for h in next(rows, [])]
                    at = {c: header.index(c) for c in columns if c in header}
                    out: list[list] = []
                    for row in rows:
                        if any(row):
                            out.append([path.rsplit("/", 1)[-1], *((row[at[c]] if c in at and at[c] < len(row) else None) for c in columns)])
                        if len(out) == BATCH:
                            yield pd.DataFrame(out, columns=["feed", *columns])
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=["feed", *columns])

    schema = "feed string, " + ", ".join(f"{c} string" for c in columns)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, schema)


def header_faults(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(feed, table, fault): missing tables, missing or repeated columns, tables without rows, ragged rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                feed = path.rsplit("/", 1)[-1]
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for table, needed in REQUIRED.items():
                        if f"{table}.txt" not in z.namelist():
                            out.append((feed, table, "missing_table"))
                            continue
                        rows = csv.reader(io.TextIOWrapper(z.open(f"{table}.txt"), "utf-8-sig", newline=""))
                        header = [h.strip() for h in next(rows, [])]
                        out += [(feed, table, f"missing_column:{c}") for c in needed if c not in header]
                        if len(set(header)) < len(header):
                            out.append((feed, table, "repeated_column"))
                        n, ragged = 0, False
                        for row in rows:
                            n += any(row)
                            ragged |= bool(row) and len(row) != len(header)
                        out += [(feed, table, "no_rows")] * (not n) + [(feed, table, "ragged")] * ragged
            yield pd.DataFrame(out, columns=["feed", "table", "fault"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "feed string, table string, fault string")


def to_parquet(spark: SparkSession, paths: list[str], tables: dict[str, list[str]], target: str) -> None:
    """Each table once as Parquet, partitioned by feed, so that later reads prune columns and feeds."""
    for name, columns in tables.items():
        read_table(spark, paths, name, columns).write.mode("overwrite").partitionBy("feed").parquet(f"{target}/{name}")


def fingerprint(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, mtime_s): what decides whether a bake is still that of its sources."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "length", F.floor(F.unix_millis("modificationTime") / 1000).cast("long").alias("mtime_s"))
