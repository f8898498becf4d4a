"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def path_of(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends."""
    sc = spark.sparkContext
    if not getattr(sc, "_wayfold_rounds", None):
        sc._wayfold_rounds = f"{shared_dir(spark)}/wayfold/rounds-{uuid.uuid4().hex}"
        fs, p = path_of(spark, sc._wayfold_rounds)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return sc._wayfold_rounds


def settle(df: DataFrame, tag: str = "round", instead: DataFrame | None = None) -> DataFrame:
    """Write a round's table to the shared folder and read it back.

    instead: the table of an earlier round that nothing needs any more; it is deleted.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wayfold_path = path
    if instead is not None and getattr(instead, "_wayfold_path", None):
        fs, p = path_of(spark, instead._wayfold_path)
        fs.delete(p, True)
    return out
