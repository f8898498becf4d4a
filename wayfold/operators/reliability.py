"""Monte-Carlo reliability: delayed timetables, committed legs scored in each draw, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.rounds import settle
from wayfold.operators.search import first_at_or_after

CAP_MIN = 75


def delayed(stop_time: DataFrame, draws: DataFrame, chains: DataFrame) -> DataFrame:
    """(draw_id, pattern_id, trip_id, pos, stop_id, arr_s, dep_s): the timetable of each draw.

    draws: pattern_id, trip_id, draw_id, delta0, slope. A trip starts delta0 late and drifts by slope with its elapsed time, truncated to seconds; within a chain (pattern_id, trip_id,
    chain, rank) no trip overtakes the one before: running maxima, for arrivals and departures apart.
    """
    elapsed = F.col("dep_s") - F.first("dep_s").over(Window.partitionBy("pattern_id", "trip_id").orderBy("pos"))
    late = F.floor(F.col("delta0") + F.col("slope") * F.col("elapsed") + 1e-9).cast("long")
    rows = stop_time.withColumn("elapsed", elapsed).join(draws.select("pattern_id", "trip_id", "draw_id", "delta0", "slope"), ["pattern_id", "trip_id"]).join(chains, ["pattern_id", "trip_id"])
    w = Window.partitionBy("draw_id", "pattern_id", "chain", "pos").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    moved = rows.withColumn("a", F.col("arr_s") + late).withColumn("d", F.col("dep_s") + late)
    return moved.select("draw_id", "pattern_id", "trip_id", "pos", "stop_id", F.max("a").over(w).alias("arr_s"), F.max("d").over(w).alias("dep_s"))


def next_committed(commits: DataFrame, times: DataFrame, ids: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """(draw_id, ids, home_s, stop_id, arr_s): the first trip of the committed pattern one can still board, as it arrives.

    commits: ids, home_s, walk_s, pattern_id, bpos, apos. An as-of join, forward, per draw.
    """
    draws = times.select("draw_id").distinct()
    ready = commits.select(*ids, "home_s", "pattern_id", "bpos", "apos", (F.col("home_s") + F.col("walk_s")).alias("ready_s")).join(F.broadcast(draws))  # a few dozen draws
    board = times.select("draw_id", "pattern_id", F.col("pos").alias("bpos"), "dep_s", F.struct("dep_s", "trip_id").alias("next"))
    first = first_at_or_after(ready, board, ["draw_id", "pattern_id", "bpos"], "ready_s", "dep_s", "next").where("next is not null").withColumn("trip_id", F.col("next.trip_id"))
    alight = times.select("draw_id", "pattern_id", "trip_id", F.col("pos").alias("apos"), "stop_id", "arr_s")
    return first.join(alight, ["draw_id", "pattern_id", "trip_id", "apos"]).select("draw_id", *ids, "home_s", "stop_id", "arr_s")


def met(arrived: DataFrame, profile: DataFrame, slack: int = 60, ids: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """(draw_id, ids, home_s, t): the first deadline that the alighting still meets, null if none."""
    asked = arrived.select("draw_id", "stop_id", *ids, "home_s", (F.col("arr_s") + slack).alias("ready_s"))
    return first_at_or_after(asked, profile.select("draw_id", "stop_id", "latest_s", F.col("deadline_s").alias("t")), ["draw_id", "stop_id"], "ready_s", "latest_s", "t")


def _from_home(cap: int):
    minutes = F.least(F.greatest((F.col("t") - F.col("home_s")) / 60.0, F.lit(0.0)), F.lit(float(cap)))
    return F.coalesce(minutes, F.lit(float(cap))).alias("minutes")


def scored(arrived: DataFrame, profile: DataFrame, slack: int = 60, cap: int = CAP_MIN, ids: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """(draw_id, ids, minutes): the first deadline that the alighting still meets, as minutes from home; the cap if none."""
    return met(arrived, profile, slack, ids).select("draw_id", *ids, _from_home(cap))


def replayed_once(commits: DataFrame, times: DataFrame, profile: DataFrame, ids: tuple[str, ...], slack: int = 60, cap: int = CAP_MIN) -> DataFrame:
    """scored() of next_committed(), with as few replays as there are different plans.

    What follows a commitment depends on its ride and on when one is at the stop, not on who goes there: cells that share both share one replay per draw, and only
    their own minutes differ.
    """
    plan = ("pattern_id", "bpos", "apos", "ready_s")
    asked = commits.select(*ids, "home_s", "pattern_id", "bpos", "apos", (F.col("home_s") + F.col("walk_s")).alias("ready_s"))
    once = asked.select(F.struct(*plan).alias("plan"), F.lit(0).cast("long").alias("home_s"), F.col("ready_s").alias("walk_s"), "pattern_id", "bpos", "apos").distinct()
    ends = settle(met(next_committed(once, times, ("plan",)), profile, slack, ("plan",)).select("draw_id", "plan.*", "t"), "plan-ends")
    return asked.join(ends, list(plan)).select("draw_id", *ids, _from_home(cap))


def published(minutes: DataFrame, floors: DataFrame, ids: list[str], draws: int, cap: int = CAP_MIN) -> DataFrame:
    """(ids, raw, real, frag, p90, spread, stuck) in whole minutes, as they are shown.

    minutes: draw_id, ids, minutes; a draw without a row counts as the cap. floors: ids, perfect. Draws are floored at the perfect
    minute before anything but `raw` is taken; medians go up, spreads to even.
    """
    every = floors.withColumn("draw_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    rows = every.join(minutes, [*ids, "draw_id"], "left").withColumn("m", F.coalesce("minutes", F.lit(float(cap))))
    rows = rows.withColumn("f", F.greatest("m", F.col("perfect").cast("double")))
    p50, p90 = F.percentile("f", 0.5), F.percentile("f", 0.9)
    whole = lambda c: c.cast("long")
    return rows.groupBy(*ids).agg(
        whole(F.ceil(F.round(F.percentile("m", 0.5), 6))).alias("raw"), whole(F.ceil(F.round(p50, 6))).alias("real"), whole(F.greatest(F.bround(F.round(p90 - p50, 6)), F.lit(0.0))).alias("frag"),
        whole(F.bround(F.round(p90, 6))).alias("p90"), whole(F.bround(F.round(F.stddev_pop("f"), 6))).alias("spread"), F.round(F.avg(F.when(F.col("f") >= cap, 1.0).otherwise(0.0)), 6).alias("stuck"),
    )


def summary(minutes: DataFrame, keys: list[str], floor: str | None = None, cap: int = CAP_MIN) -> DataFrame:
    """Raw and floored median, p90, fragility (p90 - p50), spread and share of stuck draws per key."""
    p50, p90 = F.percentile("minutes", 0.5), F.percentile("minutes", 0.9)
    low = F.greatest(p50, F.max(floor)) if floor else p50
    return minutes.groupBy(*keys).agg(
        F.round(p50, 4).alias("p50"), F.round(low, 4).alias("p50_floored"), F.round(p90, 4).alias("p90"), F.round(F.greatest(p90 - p50, F.lit(0.0)), 4).alias("frag"),
        F.round(F.stddev_pop("minutes"), 4).alias("spread"), F.round(F.avg(F.when(F.col("minutes") >= cap, 1.0).otherwise(0.0)), 6).alias("stuck"),
    )
