"""Delay reports as a stream (an extension: the batch engine has no streams).

Events are read as a file stream, late data is bounded by a watermark, and delays are summed per pattern and window. With
availableNow a run reads what there is, ends, and resumes from its checkpoint the next time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.rounds import shared_dir

LATE = "1 hour"


def reports(spark: SparkSession, path: str) -> DataFrame:
    """The stream of delay reports: pattern_id, at, delay_s."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{path}*")
    return raw.select((F.col("user_id") % 20).cast("long").alias("pattern_id"), F.col("ts").cast("timestamp").alias("at"), "value", "event_type")


def windowed(stream: DataFrame, window) -> DataFrame:
    return stream.withWatermark("at", LATE).groupBy(window.alias("w"), "pattern_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("delay"))


def tumbling(stream: DataFrame, length: str = "6 hours") -> DataFrame:
    return windowed(stream, F.window("at", length))


def sliding(stream: DataFrame, length: str = "6 hours", slide: str = "3 hours") -> DataFrame:
    return windowed(stream, F.window("at", length, slide))


def sessions(stream: DataFrame, gap: str = "6 hours") -> DataFrame:
    return windowed(stream, F.session_window("at", gap))


def run_available(result: DataFrame, spark: SparkSession) -> DataFrame:
    """Run the stream over what there is into a table of the shared folder, in append mode, and read that."""
    base = f"{shared_dir(spark)}/wayfold/stream-{uuid.uuid4().hex}"
    done = result.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out")
