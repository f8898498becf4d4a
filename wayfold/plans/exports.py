"""Queries that write files for others and read them again, and more checks of feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfold.operators import assemble, validate
from wayfold.operators.rounds import run_dir
from wayfold.plans.base import query
from wayfold.plans.search import BY, ONE, PURE, ROUNDS, labels, purewalk

DAY = "20240306"
MINUTES = f"""k AS (SELECT a.cell_id, max(v-a.walk_s) AS home FROM tn_access a JOIN b{ROUNDS} b ON b.stop_id=a.stop_id GROUP BY a.cell_id),
    mi AS (SELECT c.cell_id, c.hood, CASE WHEN m<75 THEN m END AS minutes FROM (SELECT c.cell_id, c.hood, CAST(ceil(least(coalesce({BY}-home, walk_only_s), coalesce(walk_only_s, {BY}-home))/60.0) AS BIGINT) AS m FROM tn_cell c LEFT JOIN k ON k.cell_id=c.cell_id LEFT JOIN pw ON pw.cell_id=c.cell_id) c)"""


def minutes(n):
    return assemble.arrive_by(n.cell, n.reach, labels(n), purewalk(n), BY).select("cell_id", "minutes")


def folder(n, kind):
    return f"{run_dir(n.spark)}/{kind}-{uuid.uuid4().hex}"


@query("s16_origins_to_results", f"{ONE}, {PURE}, {MINUTES} SELECT CAST(cell_id AS VARCHAR) AS id, minutes FROM mi WHERE minutes IS NOT NULL")
def _(n):
    """Origins from JSON lines, results to JSON lines; unreached origins have no result."""
    origins, results = folder(n, "origins"), folder(n, "results")
    n.cell.select(F.col("cell_id").cast("string").alias("id"), F.col("x_m").alias("x"), F.col("y_m").alias("y")).write.json(origins)
    asked = n.spark.read.schema("id string, x long, y long").json(origins)
    found = asked.join(minutes(n), F.col("id").cast("long") == F.col("cell_id"))
    found.where("minutes is not null").select("id", "minutes").write.json(results)
    return n.spark.read.schema("id string, minutes long").json(results)


@query("s17_csv_export", f"{ONE}, {PURE}, {MINUTES} SELECT hood, concat(n_name,', \"',n_name,'\"') AS name, min(minutes) AS best, count(*) FILTER (minutes IS NOT NULL) AS cells FROM mi JOIN nation ON n_nationkey=hood GROUP BY hood, n_name HAVING min(minutes)<=45")
def _(n):
    """Neighbourhoods within 45 minutes as CSV: names hold commas and quotes, which are doubled within quotes."""
    names = n.table("nation").select(F.col("n_nationkey").cast("long").alias("hood"), F.concat("n_name", F.lit(', "'), "n_name", F.lit('"')).alias("name"))
    best = n.cell.join(minutes(n), "cell_id").groupBy("hood").agg(F.min("minutes").alias("best"), F.count("minutes").alias("cells")).where("best <= 45")
    path = folder(n, "export")
    best.join(names, "hood").select("hood", "name", "best", "cells").write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return n.spark.read.schema("hood long, name string, best long, cells long").option("header", True).option("quote", '"').option("escape", '"').csv(path)


@query("s13_bundle", """SELECT 'cells' AS part, CAST(hood AS VARCHAR) AS key, string_agg(CAST(cell_id AS VARCHAR),',' ORDER BY cell_id) AS items FROM tn_cell GROUP BY hood
    UNION ALL SELECT 'lines', mode, string_agg(DISTINCT line_name,',' ORDER BY line_name) FROM tn_line GROUP BY mode UNION ALL SELECT 'service_date', 'modeled', '20240306'""")
def _(n):
    """The bundle a page loads: cells by neighbourhood, lines by mode, the day; one JSON file each, read back."""
    ids = F.transform(F.sort_array(F.collect_list("cell_id")), lambda c: c.cast("string"))
    cells = n.cell.groupBy(F.col("hood").cast("string").alias("key")).agg(ids.alias("items")).withColumn("part", F.lit("cells"))
    lines = n.line.groupBy(F.col("mode").alias("key")).agg(F.array_sort(F.collect_set("line_name")).alias("items")).withColumn("part", F.lit("lines"))
    day = n.spark.range(1).select(F.lit("modeled").alias("key"), F.array(F.lit(DAY)).alias("items"), F.lit("service_date").alias("part"))
    path = folder(n, "bundle")
    cells.unionByName(lines).unionByName(day).write.partitionBy("part").json(path)
    return n.spark.read.schema("key string, items array<string>, part string").json(path).select("part", "key", F.array_join("items", ",").alias("items"))


KEYS = """SELECT 'repeated_route' AS code, count(*) AS violations FROM (SELECT route_id FROM gt_routes GROUP BY route_id HAVING count(*)>1) a
    UNION ALL SELECT 'repeated_trip', count(*) FROM (SELECT trip_id FROM gt_trips GROUP BY trip_id HAVING count(*)>1) b
    UNION ALL SELECT 'repeated_service', count(*) FROM (SELECT service_id FROM gt_calendar GROUP BY service_id HAVING count(*)>1) c
    UNION ALL SELECT 'unknown_route', count(*) FROM gt_trips t WHERE NOT EXISTS (SELECT 1 FROM gt_routes r WHERE r.route_id=t.route_id)
    UNION ALL SELECT 'unknown_service', count(*) FROM gt_trips t WHERE NOT EXISTS (SELECT 1 FROM gt_calendar c WHERE c.service_id=t.service_id) AND NOT EXISTS (SELECT 1 FROM gt_calendar_dates d WHERE d.service_id=t.service_id)
    UNION ALL SELECT 'unknown_trip', count(*) FROM gt_stop_times s WHERE NOT EXISTS (SELECT 1 FROM gt_trips t WHERE t.trip_id=s.trip_id)
    UNION ALL SELECT 'trip_without_times', count(*) FROM gt_trips t WHERE NOT EXISTS (SELECT 1 FROM gt_stop_times s WHERE s.trip_id=t.trip_id)
    UNION ALL SELECT 'single_stop', count(*) FROM (SELECT trip_id FROM gt_stop_times GROUP BY route_id, trip_id HAVING count(*)<2) e"""


@query("v01_feed_keys", KEYS)
def _(n):
    return validate.feed_keys(n.view("gt_routes"), n.view("gt_trips"), n.view("gt_stop_times"), n.view("gt_calendar"), n.view("gt_calendar_dates"))


@query("v02_service_states", f"""WITH e AS (SELECT service_id, bool_or(exception_type='1' AND date='{DAY}') AS added, bool_or(exception_type='2' AND date='{DAY}') AS removed, max(date) AS last_date FROM gt_calendar_dates GROUP BY service_id)
    SELECT coalesce(c.service_id, e.service_id) AS service_id, CASE WHEN coalesce(added,false) AND coalesce(removed,false) THEN 'contradictory' WHEN coalesce(removed,false) THEN 'removed' WHEN coalesce(added,false) THEN 'active' WHEN greatest(coalesce(end_date,''),coalesce(last_date,''))<'{DAY}' THEN 'expired'
      WHEN start_date>'{DAY}' THEN 'not_started' WHEN wednesday='1' AND end_date>='{DAY}' THEN 'active' ELSE 'no_service' END AS state FROM gt_calendar c FULL JOIN e ON e.service_id=c.service_id""")
def _(n):
    return validate.service_states(n.view("gt_calendar"), n.view("gt_calendar_dates"), DAY, "wednesday")
