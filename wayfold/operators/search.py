"""Backward search over a timetable in rounds, for any number of keys (destination, deadline, delay draw) at once.

State: best(key, stop_id, v) is the latest time at which one may stand at a stop and still arrive by the key's deadline.
A round boards trips: a trip whose arrival at some later stop leaves the board slack before v there can be boarded at all
its earlier stops. Only strict improvements count; only stops improved by a ride relax footpaths, one hop, from the
values of the same round. A label that a footpath gave never walks on. These rules are part of the semantics.

Trips of a pattern that never overtake one another are a lane: one row per position, with the times of all its trips in
order. The trips that can be caught from a position are the first k of the lane, and the k-th is the latest at every earlier
position. So a round is an equi-join of the frontier with lanes on the stop, which finds k, and one on the lane,
which reads the k-th departure: rows are lanes and positions, not trips. A round writes one table, the labels; those
of the round are its frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from wayfold.operators.rounds import settle
from wayfold.operators.spatial import Reach

SLACK_S, MAX_ROUNDS = 60, 8


def grid(first: int, last: int, step: int) -> list[int]:
    return list(range(first, last + 1, step))


def seed(egress: DataFrame, deadlines: list[int]) -> DataFrame:
    """egress for every deadline, with v, the time by which its stops must be left on foot."""
    return egress.withColumn("deadline_s", F.explode(F.array(*(F.lit(d).cast("long") for d in deadlines)))).withColumn("v", F.col("deadline_s") - F.col("walk_s"))


def lanes(stop_time: DataFrame, chains: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, lane, pos, stop_id, arr array, dep array): rows of lanes, trips in order of their times.

    chains: (pattern_id, trip_id, chain, rank), trips of a chain never overtaking one another. Without it, trips of a pattern with
    equal running times are a lane: they differ by a shift, so none overtakes another.
    """
    if chains is None:
        trip = Window.partitionBy(*keys, "pattern_id", "trip_id")
        rows = stop_time.withColumn("first", F.min("dep_s").over(trip))
        each = F.xxhash64("pos", "stop_id", F.col("arr_s") - F.col("first"), F.col("dep_s") - F.col("first"))  # a trip's shape: its rows' hashes, whatever their order
        rows = rows.withColumn("lane", F.concat_ws("-", "pattern_id", F.bit_xor(each).over(trip))).withColumn("rank", F.struct("first", "trip_id"))
    else:
        rows = stop_time.join(chains, ["pattern_id", "trip_id"])
        rows = rows.withColumn("lane", F.concat_ws("-", "pattern_id", "chain"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "arr_s", "dep_s"))).alias("x")
    per = rows.groupBy(*keys, "lane", "pos", "stop_id").agg(ordered)
    return per.select(*keys, "lane", "pos", "stop_id", F.col("x.arr_s").alias("arr"), F.col("x.dep_s").alias("dep"))


def _footpaths(transfer: DataFrame | Reach):
    """What hop(rows, keys) gives: (keys, stop_id, v, to) of the stops from which a footpath reaches those of rows, `to` being the negative stop reached.

    transfer: from_id, to_id, walk_s; or by places, where stops on one point share their latest time and the smallest stop that has it, and walk once.
    There a stop may reach itself, no later than it is left, which is no improvement.
    """
    to = (-F.col("stop_id")).alias("to")
    if not isinstance(transfer, Reach):
        walks = settle(transfer.select(F.col("to_id").alias("stop_id"), F.col("from_id"), F.col("walk_s").alias("hop_s")), "walks")
        return lambda rows, keys: rows.join(walks, "stop_id").select(*keys, F.col("from_id").alias("stop_id"), (F.col("v") - F.col("hop_s")).alias("v"), to)
    pairs, froms, tos = settle(transfer.pairs, "walks"), settle(transfer.froms, "places"), settle(transfer.tos, "places")

    def hop(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        at = rows.join(tos, "stop_id").groupBy(*keys, "to_at").agg(F.max(F.struct("v", to)).alias("x"))
        best = F.max(F.struct((F.col("x.v") - F.col("walk_s")).alias("v"), F.col("x.to").alias("to"))).alias("x")
        return at.join(pairs, "to_at").groupBy(*keys, "from_at").agg(best).join(froms, "from_at").select(*keys, "stop_id", "x.v", "x.to")

    return hop


def reverse_search(lane: DataFrame, transfer: DataFrame | Reach, start: DataFrame, keys: tuple[str, ...] = ("deadline_s",), rounds: int = MAX_ROUNDS, slack: int = SLACK_S, time_keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, stop_id, v, rides): the labels after at most `rounds` rides; rides is the round of the label.

    lane: as lanes() gives it. transfer: from_id, to_id, walk_s, or by places. start: keys, stop_id, v. time_keys: keys that lanes have too (a delay draw, say).
    """
    keys = tuple(keys)
    one = [*keys, "stop_id"]
    lane = settle(lane, "lanes")
    alight = lane.select(*time_keys, "lane", F.col("pos").alias("apos"), "stop_id", "arr")
    board = lane.select(*time_keys, "lane", F.col("pos").alias("bpos"), "stop_id", "dep")
    footpaths = _footpaths(transfer)

    def hop(rows: DataFrame, k: int) -> DataFrame:
        """Latest times at the stops from which a footpath reaches these."""
        return footpaths(rows, keys).select(*one, "v", F.lit(k).alias("rides"))

    def merged(*parts: DataFrame) -> DataFrame:
        """The latest times; of equal ones the earlier round's."""
        every = reduce(DataFrame.union, (p.select(*one, "v", "rides") for p in parts))
        return every.groupBy(*one).agg(F.max(F.struct("v", (-F.col("rides")).alias("r"))).alias("x")).select(*one, "x.v", (-F.col("x.r")).alias("rides"))

    first = start.groupBy(*one).agg(F.max("v").alias("v")).withColumn("rides", F.lit(0))
    best = settle(merged(first, hop(first, 0)), "best")
    for k in range(1, rounds + 1):
        frontier = best.where(F.col("rides") == k - 1).select(*one, (F.col("v") - slack).alias("by"))
        n = F.size(F.filter("arr", lambda t: t <= F.col("by")))
        caught = frontier.join(alight, ["stop_id", *time_keys]).select(*keys, "lane", "apos", n.alias("k")).where("k > 0")
        ride = caught.join(board, ["lane", *time_keys]).where("bpos < apos")
        cand = ride.groupBy(*one).agg(F.max(F.element_at("dep", F.col("k"))).alias("v"))
        old = best.select(*one, F.col("v").alias("had"))
        newly = cand.join(old, one, "left").where("had is null or v > had").select(*one, "v", F.lit(k).alias("rides"))
        seen = Observation()
        best = settle(merged(best, newly, hop(newly, k)).observe(seen, F.max("rides").alias("last")), "best", instead=best)
        if seen.get["last"] != k:  # counted while the round was written
            break
    return best.select(*one, "v", "rides")


VIA = ("kind", "to_stop", "to_round", "to_layer", "pattern_id", "trip_id", "bpos", "apos", "dep_s", "arr_s")


def _via(**known):
    """The back-pointer of a label."""
    return F.struct(*(known.get(c, F.lit(None)).cast("string" if c == "kind" else "long").alias(c) for c in VIA)).alias("via")


def traced_search(stop_time: DataFrame, transfer: DataFrame | Reach, start: DataFrame, keys: tuple[str, ...] = ("deadline_s",), rounds: int = MAX_ROUNDS, slack: int = SLACK_S) -> tuple[DataFrame, DataFrame]:
    """The labels of reverse_search with `via`, what they come from, and the history: every improvement of every round.

    History: (keys, stop_id, rides, layer, v, via), layer 1 being those by footpath. Ties among rides: lower pattern, later
    boarding, lower trip; among footpaths: lower stop; a ride beats a footpath. Trips are told apart here, so it runs on stop times.
    """
    keys = tuple(keys)
    one = [*keys, "stop_id"]
    row = [*one, "v", "rides", "via"]
    times = settle(stop_time.select("pattern_id", "trip_id", "pos", "stop_id", "arr_s", "dep_s"), "times")
    footpaths = _footpaths(transfer)

    def hop(rows: DataFrame, k: int) -> DataFrame:
        found = footpaths(rows, keys).groupBy(*one).agg(F.max(F.struct("v", "to")).alias("x"))
        return found.select(*one, "x.v", F.lit(k).alias("rides"), _via(kind=F.lit("foot"), to_stop=-F.col("x.to"), to_round=F.lit(k), to_layer=F.lit(0)))

    def better(rows: DataFrame, than: DataFrame) -> DataFrame:
        old = than.select(*one, F.col("v").alias("had"))
        return rows.join(old, one, "left").where("had is null or v > had").drop("had")

    def merged(*parts: DataFrame) -> DataFrame:
        every = reduce(DataFrame.union, (p.select(*row) for p in parts))
        return every.groupBy(*one).agg(F.max(F.struct("v", (-F.col("rides")).alias("r"), "via")).alias("x")).select(*one, "x.v", (-F.col("x.r")).alias("rides"), "x.via")

    first = start.groupBy(*one).agg(F.max("v").alias("v"))
    first = settle(first.select(*one, "v", F.lit(0).alias("rides"), _via(kind=F.lit("egress"), dep_s=F.col("v"))), "seed")
    foot = settle(better(hop(first, 0), first), "foot")
    history, best = [(first, 0), (foot, 1)], merged(first, foot)  # labels are the last of all improvements, which are written
    frontier = best
    for k in range(1, rounds + 1):
        reach = frontier.select(*row).withColumnRenamed("v", "left_by").join(times, "stop_id").where(F.col("arr_s") <= F.col("left_by") - slack)
        last = F.max(F.struct("pos", "arr_s", "stop_id", F.when(F.col("via.kind") == "foot", 1).otherwise(0).alias("layer"), "rides"))
        trips = reach.groupBy(*keys, "pattern_id", "trip_id").agg(last.alias("last"))
        board = trips.join(times, ["pattern_id", "trip_id"]).where(F.col("pos") < F.col("last.pos"))
        top = F.max(F.struct("dep_s", (-F.col("pattern_id")).alias("p"), "pos", (-F.col("trip_id")).alias("t"), "last"))
        via = _via(
            kind=F.lit("ride"), to_stop=F.col("x.last.stop_id"), to_round=F.col("x.last.rides"), to_layer=F.col("x.last.layer"), pattern_id=-F.col("x.p"), trip_id=-F.col("x.t"),
            bpos=F.col("x.pos"), apos=F.col("x.last.pos"), dep_s=F.col("x.dep_s"), arr_s=F.col("x.last.arr_s"),
        )
        cand = board.groupBy(*one).agg(top.alias("x")).select(*one, F.col("x.dep_s").alias("v"), F.lit(k).alias("rides"), via)
        newly = settle(better(cand, best), "newly")
        if newly.isEmpty():
            break
        foot = settle(better(hop(newly, k), merged(best, newly)), "foot")
        history += [(newly, 0), (foot, 1)]
        frontier, best = merged(newly, foot), merged(*(df for df, _ in history))
    every = reduce(DataFrame.union, (df.select(*one, "rides", F.lit(layer).alias("layer"), "v", "via") for df, layer in history))
    return best.select(*row), every


def trace(labels: DataFrame, history: DataFrame, keys: tuple[str, ...] = ("deadline_s",), rounds: int = MAX_ROUNDS) -> DataFrame:
    """(keys, origin, leg, from_stop, v, kind, to_stop, dep_s, arr_s, pattern_id, trip_id, bpos, apos): the legs behind every label."""
    ix = history.select(*keys, F.col("stop_id").alias("at"), F.col("rides").cast("long").alias("round"), F.col("layer").cast("long").alias("layer"), "v", "via")
    here = labels.select(*keys, F.col("stop_id").alias("origin"), F.col("stop_id").alias("at"), F.col("rides").cast("long").alias("round"), F.when(F.col("via.kind") == "foot", 1).otherwise(0).cast("long").alias("layer"))
    legs = []
    for leg in range(2 * rounds + 2):
        step = settle(here.join(ix, [*keys, "at", "round", "layer"]), "trace")
        if step.isEmpty():
            break
        via = [F.col(f"via.{c}").alias(c) for c in ("kind", "to_stop", "dep_s", "arr_s", "pattern_id", "trip_id", "bpos", "apos")]
        legs.append(step.select(*keys, "origin", F.lit(leg).cast("long").alias("leg"), F.col("at").alias("from_stop"), F.col("v"), *via))
        here = step.where("via.to_stop is not null").select(*keys, "origin", F.col("via.to_stop").alias("at"), F.col("via.to_round").alias("round"), F.col("via.to_layer").alias("layer"))
    return reduce(DataFrame.union, legs)


def monotone(profile: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A later deadline never leaves less time: running maximum over deadlines."""
    w = Window.partitionBy(*keys, "stop_id").orderBy("deadline_s").rowsBetween(Window.unboundedPreceding, 0)
    return profile.withColumn("latest_s", F.max("v").over(w))


def first_at_or_after(rows: DataFrame, steps: DataFrame, keys: list[str], key: str, step: str, out: str) -> DataFrame:
    """As-of join, forward: rows with the smallest `out` among steps of equal keys with steps[step] >= rows[key]; null if none.

    Rows and steps are one sequence per key, read from the latest time back with a running minimum: each is seen once.
    """
    asked = rows.select(*keys, F.col(key).alias("_t"), F.lit(1).alias("_asked"), F.lit(None).cast(steps.schema[out].dataType).alias("_out"), F.struct(*rows.columns).alias("_row"))
    given = steps.select(*keys, F.col(step).alias("_t"), F.lit(0).alias("_asked"), F.col(out).alias("_out"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    back = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_asked").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.union(given).withColumn("_out", F.min("_out").over(back)).where("_asked = 1")
    return met.select("_row.*", F.col("_out").alias(out))


def arrival_profile(profile: DataFrame, departures: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, stop_id, dep_s, arr_w_s): the first deadline whose latest time at the stop is not before the departure.

    profile: monotone, with latest_s. departures: a uniform grid; a deadline serves those since the latest time of the one
    before, found by arithmetic instead of a search.
    """
    lo, n = departures[0], len(departures)
    step = departures[1] - lo if n > 1 else 1
    w = Window.partitionBy(*keys, "stop_id").orderBy("deadline_s")
    spans = profile.withColumn("prev", F.lag("latest_s").over(w)).where("prev is null or latest_s > prev")
    first = F.greatest(F.coalesce(F.floor((F.col("prev") - lo) / step) + 1, F.lit(0)), F.lit(0))
    last = F.least(F.floor((F.col("latest_s") - lo) / step), F.lit(n - 1))
    held = spans.withColumn("a", first.cast("long")).withColumn("b", last.cast("long")).where("b >= a")
    slots = held.select(*keys, "stop_id", F.explode(F.sequence("a", "b")).alias("k"), F.col("deadline_s").alias("arr_w_s"))
    return slots.select(*keys, "stop_id", (lo + F.col("k") * step).cast("long").alias("dep_s"), "arr_w_s")


def percentile_lower(values, p: int):
    """sorted[floor((n-1)*p/100)] of an aggregated column."""
    every = F.sort_array(F.collect_list(values))
    return F.element_at(every, (F.floor((F.size(every) - 1) * p / 100) + 1).cast("int"))
