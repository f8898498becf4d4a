"""What the corpus operators share: reading, writing shared intermediate tables, shipping the package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make the package importable by Python workers and keep Arrow batches of whole texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    sc = spark.sparkContext
    if getattr(sc, "_wayfold_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="wayfold-")) / "wayfold_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._wayfold_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all run on one machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wayfold-checkpoint-"))
        found = sc.getCheckpointDir()
    return found


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends."""
    sc = spark.sparkContext
    if not getattr(sc, "_wayfold_corpus", None):
        sc._wayfold_corpus = f"{shared_dir(spark)}/wayfold/corpus-{uuid.uuid4().hex}"
        fs, p = _path(spark, sc._wayfold_corpus)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return sc._wayfold_corpus


def materialize(df: DataFrame, tag: str, instead: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors cost no recomputation.

    instead: the table of an earlier round that nothing needs any more; it is deleted.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wayfold_path = path
    if instead is not None and getattr(instead, "_wayfold_path", None):
        fs, p = _path(spark, instead._wayfold_path)
        fs.delete(p, True)
    return out


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column], tag: str) -> DataFrame:
    """df with inclusive running sums over all rows in a total order, without a task that sees all rows.

    Rows are dealt to ranges of the order and written; sums run within each range, after the totals of those before,
    one row a range.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), tag)
    totals = dealt.groupBy("_range").agg(*(F.sum(x).alias(f"_{c}") for c, x in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(totals), "_range")  # as many rows as the shuffle has partitions
    return out.select(*df.columns, *((F.sum(x).over(inside) + F.col(f"_{c}")).alias(c) for c, x in sums.items()))


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


NO_ID = -(1 << 63)


def solid_id(doc_id: Column) -> Column:
    """A long without nulls, for pandas, which would turn a column with nulls into doubles."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID).cast("long"))


def loose_id(doc_id: Column) -> Column:
    """The inverse of solid_id."""
    return F.when(doc_id != F.lit(NO_ID).cast("long"), doc_id)
