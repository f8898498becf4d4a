"""Queries that write feed archives from the tables and scan them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfold.operators.rounds import run_dir
from wayfold.plans.base import query
from wayfold.sources import feedzip

_TIMES = ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time")
_FEED = "concat('feed', CAST(CAST(route_id AS BIGINT)%5 AS VARCHAR(20)), '.zip')"


def stop_times(n):
    """The stop times as five archives; what they hold is (feed, path, rows)."""
    folder = f"{run_dir(n.spark)}/archives-{uuid.uuid4().hex}"
    rows = n.view("gt_stop_times").select(F.concat(F.lit("feed"), F.col("route_id").cast("long") % 5, F.lit(".zip")).alias("feed"), *_TIMES)
    return feedzip.write_archives(rows, "feed", "stop_times", folder), folder


@query("s02_archive_scan", f"SELECT {_FEED} AS feed, trip_id, stop_id, stop_sequence, coalesce(arrival_time,'') AS arrival_time, coalesce(departure_time,'') AS departure_time FROM gt_stop_times")
def _(n):
    written, folder = stop_times(n)
    written.count()
    return feedzip.read(n.spark, folder, "stop_times", list(_TIMES)).withColumnRenamed("_feed", "feed").select("feed", *_TIMES)


@query("s02_archive_contents", f"SELECT {_FEED} AS feed, count(*) AS rows FROM gt_stop_times GROUP BY 1")
def _(n):
    return stop_times(n)[0].select("feed", "rows")


@query("s03_archive_faults", """WITH r AS (SELECT concat('feed', CAST(o_custkey%4 AS VARCHAR), '.zip') AS feed, o_orderkey AS k FROM orders) SELECT feed, fault, count(*) AS lines FROM (
    SELECT feed, CASE WHEN k%7=0 THEN 'ragged' END AS fault FROM r UNION ALL SELECT DISTINCT feed, 'missing_column:service_id' FROM r UNION ALL SELECT DISTINCT feed, 'repeated_column' FROM r) u GROUP BY feed, fault""")
def _(n):
    """Trips of orders: the header lacks a column and has one twice, and a comma within every seventh route makes a field too many."""
    orders = n.table("orders")
    route = F.concat(F.lit("R"), F.col("o_custkey"))
    rows = orders.select(F.concat(F.lit("feed"), F.col("o_custkey") % 4, F.lit(".zip")).alias("feed"), route.alias("route_id"), F.col("o_orderkey").cast("string").alias(" trip_id"), route.alias("route_id "), F.when(F.col("o_orderkey") % 7 == 0, F.lit("a,b")).otherwise("a").alias("note"))
    folder = f"{run_dir(n.spark)}/archives-{uuid.uuid4().hex}"
    feedzip.write_archives(rows, "feed", "trips", folder, raw=True).count()
    found = feedzip.read(n.spark, folder, "trips", ["trip_id"], faults=True)
    return found.groupBy(F.col("_feed").alias("feed"), F.col("_fault").alias("fault")).agg(F.count(F.lit(1)).alias("lines"))
