"""From feed tables to a timetable: active services, clean trips, patterns, sub-patterns that never overtake."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import feeds


def active_services(calendar: DataFrame, dates: DataFrame, day: str, weekday: str) -> DataFrame:
    """Services of the day: (by weekday and range, or added) and then not removed; the order of the two matters."""
    own = dates.where(F.col("date") == day)
    base = calendar.where((F.col(weekday) == "1") & (F.col("start_date") <= day) & (F.col("end_date") >= day)).select("service_id")
    added = own.where("exception_type = '1'").select("service_id")
    removed = own.where("exception_type = '2'").select("service_id")
    return base.union(added).distinct().join(removed, "service_id", "left_anti")


def clean_times(stop_times: DataFrame) -> DataFrame:
    """Stop times with numbers, without the trips that lack both times anywhere."""
    a, d = feeds.patched(feeds.seconds(F.col("arrival_time")), feeds.seconds(F.col("departure_time")))
    rows = stop_times.select("route_id", "trip_id", F.col("stop_sequence").try_cast("long").alias("seq"), "stop_id", a.alias("arr_s"), d.alias("dep_s"))
    gap = F.bool_or(F.col("arr_s").isNull()).over(Window.partitionBy("trip_id"))  # one pass, dealt as later groups by trip need it
    return rows.withColumn("gap", gap).where("not gap").drop("gap")


def in_band(times: DataFrame, first: int, last: int, trip: list[str]) -> DataFrame:
    """Trips whose span meets the band, as (trip keys)."""
    span = times.groupBy(*trip).agg(F.min_by("dep_s", "pos").alias("starts"), F.max_by("arr_s", "pos").alias("ends"))
    return span.where((F.col("starts") <= last) & (F.col("ends") >= first)).select(*trip)


def stop_patterns(times: DataFrame) -> DataFrame:
    """(route_id, stops, trips): trips grouped by route and ordered stop list."""
    lists = times.groupBy("route_id", "trip_id").agg(F.sort_array(F.collect_list(F.struct("seq", "stop_id"))).alias("x"))
    stops = F.transform("x", lambda s: s["stop_id"])
    return lists.select("route_id", "trip_id", F.array_join(stops, ">").alias("stops")).groupBy("route_id", "stops").agg(F.count(F.lit(1)).alias("trips"))


def fifo_chains(stop_time: DataFrame) -> DataFrame:
    """(pattern_id, trip_id, chain, rank): trips dealt to the first chain whose last trip they nowhere overtake.

    Greedy and order-dependent, so a pattern's trips, in order of first departure, go through one Python group; a pattern
    is one line's trips on one day.
    """
    rows = stop_time.groupBy("pattern_id", "trip_id").agg(F.sort_array(F.collect_list(F.struct("pos", "arr_s", "dep_s"))).alias("x"))
    rows = rows.select("pattern_id", "trip_id", F.transform("x", lambda s: s["arr_s"]).alias("arr"), F.transform("x", lambda s: s["dep_s"]).alias("dep"))

    def split(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(first=[d[0] for d in part["dep"]]).sort_values(["first", "trip_id"], kind="stable")
        last, out = [], []
        for trip, arr, dep in zip(part["trip_id"], part["arr"], part["dep"], strict=True):
            for k, (a, d, n) in enumerate(last):  # noqa: B007
                if (arr >= a).all() and (dep >= d).all():
                    break
            else:
                k, n = len(last), 0
                last.append(None)
            last[k] = (arr, dep, n + 1)
            out.append((part["pattern_id"].iloc[0], trip, k, n))
        return pd.DataFrame(out, columns=["pattern_id", "trip_id", "chain", "rank"])

    return rows.groupBy("pattern_id").applyInPandas(split, "pattern_id long, trip_id long, chain long, rank long")


def route_shapes(shapes: DataFrame) -> DataFrame:
    """(route_id, shape_id, points, line): the shape with most points of each route, as one line of ordered points."""
    n = shapes.groupBy("route_id", "shape_id").agg(F.count(F.lit(1)).alias("points"))
    first = Window.partitionBy("route_id").orderBy(F.desc("points"), "shape_id")
    best = n.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    drawn = shapes.join(best, ["route_id", "shape_id"]).groupBy("route_id", "shape_id", "points")
    ordered = F.sort_array(F.collect_list(F.struct("seq", "x_m", "y_m")))
    return drawn.agg(ordered.alias("x")).select("route_id", "shape_id", "points", F.array_join(F.transform("x", lambda p: F.concat_ws(" ", p["x_m"], p["y_m"])), ",").alias("line"))
