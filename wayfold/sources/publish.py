"""Publishing tables so that readers always see a whole one, and building them only when their sources changed.

A published place is a folder of versions and a small file that names the current one. A version is written in full before the name is replaced, in one
rename that overwrites; so whatever step a writer dies at, readers find the version before or the new one. The version
before stays for those who are reading it; older ones go.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def version(spark: SparkSession, path: str) -> str | None:
    """The name of the version that readers of `path` get."""
    fs, p = _fs(spark, f"{path}/{POINTER}")
    return spark.read.text(str(p)).first()[0] if fs.exists(p) else None


def exists(spark: SparkSession, path: str) -> bool:
    return version(spark, path) is not None


def read(spark: SparkSession, path: str, part: str = "table") -> DataFrame:
    return spark.read.parquet(f"{path}/{version(spark, path)}/{part}")


def point(spark: SparkSession, path: str, name: str) -> None:
    """Replace the pointer by one that names another version; the file system renames over the old one in one step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, staged = _fs(spark, f"{path}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(name.encode()))
    out.close()
    modes = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(modes, 1)
    overwrite[0] = modes.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")), overwrite)


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], bool] = lambda _: True, beside: dict[str, DataFrame] | None = None) -> DataFrame:
    """Write a new version, check what was written, then let readers have it. beside: further tables of the same version."""
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    for part, table in {"table": df, **(beside or {})}.items():
        table.write.parquet(f"{path}/{name}/{part}")
    fs, new = _fs(spark, f"{path}/{name}")
    if not check(spark.read.parquet(f"{path}/{name}/table")):
        fs.delete(new, True)
        raise ValueError(f"{path}: what was written does not pass its check")
    before = version(spark, path)
    point(spark, path, name)
    for found in fs.listStatus(new.getParent()):
        if found.isDirectory() and found.getPath().getName() not in (name, before):
            fs.delete(found.getPath(), True)
    return spark.read.parquet(f"{path}/{name}/table")


def fingerprint(*sources: DataFrame, **parameters: object) -> DataFrame:
    """One row that differs when any source row or parameter does: counts and hashes of whole rows, in no order."""
    one = sources[0].sparkSession.range(1).select(F.lit(repr(sorted(parameters.items()))).alias("parameters"))
    for k, df in enumerate(sources):
        row = F.xxhash64(*(F.col(c) for c in df.columns))
        told = df.agg(F.count(F.lit(1)).alias(f"rows_{k}"), F.coalesce(F.bit_xor(row), F.lit(0)).alias(f"bits_{k}"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias(f"sum_{k}"))
        one = one.join(F.broadcast(told))  # one row each
    return one


def load_or_build(spark: SparkSession, path: str, sources: DataFrame, build: Callable[[], DataFrame], beside: Callable[[], dict[str, DataFrame]] = dict) -> DataFrame:
    """The table at `path` if it was built from these sources, else a new one. sources: rows that identify them, published with the table and those beside it."""
    if exists(spark, path):
        had = read(spark, path, "sources")
        if had.columns == sources.columns and had.exceptAll(sources).isEmpty() and sources.exceptAll(had).isEmpty():
            return read(spark, path)
    return publish(build(), path, beside={"sources": sources, **beside()})
