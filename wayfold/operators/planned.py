"""Planned journeys: the tails behind every stop and deadline, validated templates, branches, and what cells choose among.

A tail is the legs from a stop to the destination for one deadline, as the traced search found them. All steps are sets:
a stop's templates and branches are made once, whatever the number of cells that walk to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY_HOP_S, CAP_S = 120, 4500


def tails(legs: DataFrame, stop_time: DataFrame, egress: DataFrame, line: DataFrame) -> DataFrame:
    """(deadline_s, stop_id, v, rides, finish_s, walk_s, route, dominant, SHAPE): one row per traced label.

    legs: as search.trace() gives them. v is the latest time to leave the stop; finish_s the arrival of the last ride and the walks
    behind it, null without a ride; walk_s all walks. The last ride is left where arrival plus walk is least, then the walk, then
    the later position, never further than that. route names the rides' lines in order; dominant is the line of the longest ride
    of at least TINY_HOP_S, ties by name. SHAPE: shape tells the ridden patterns and positions, 'pattern:from-to' joined by '>', and
    no times or names; pattern_id, trip_id, bpos, ride_dep_s and seg (its shape) are the first ride's, last_seg the last one's; foot_s,
    hop_s and out_s are the walks before, between and behind the rides, ride_s the seconds on board, depth the rides of at least TINY_HOP_S.
    """
    journey = Window.partitionBy("deadline_s", "origin").orderBy("leg")
    ahead = F.lead("v").over(journey)
    rows = legs.withColumn("next_kind", F.lead("kind").over(journey)).withColumn(
        "w", F.when(F.col("kind") == "foot", ahead - F.col("v")).when(F.col("kind") == "egress", F.col("deadline_s") - F.col("v")).otherwise(0)
    )
    last = rows.where("kind = 'ride' and next_kind = 'egress'").select("deadline_s", "origin", "leg", "pattern_id", "trip_id", "bpos")
    later = last.join(stop_time.select("pattern_id", "trip_id", "pos", "stop_id", F.col("arr_s").alias("at_s")), ["pattern_id", "trip_id"]).where("pos > bpos")
    later = later.join(egress.select("stop_id", F.col("walk_s").alias("out_s")), "stop_id")
    best = later.groupBy("deadline_s", "origin", "leg").agg(F.min(F.struct((F.col("at_s") + F.col("out_s")).alias("finish"), "out_s", (-F.col("pos")).alias("p"), "at_s")).alias("b"))
    rows = rows.join(best, ["deadline_s", "origin", "leg"], "left").join(line.select("pattern_id", "line_name"), "pattern_id", "left")
    ride = F.col("kind") == "ride"
    arrive = F.coalesce(F.col("b.at_s"), F.col("arr_s"))
    own = Window.partitionBy("deadline_s", "origin")
    rows = rows.withColumn("last_ride", F.max(F.when(ride, F.col("leg"))).over(own)).withColumn("first_ride", F.min(F.when(ride, F.col("leg"))).over(own))
    behind = F.col("leg") > F.coalesce("last_ride", F.lit(-1))
    seg = F.concat("pattern_id", F.lit(":"), "bpos", F.lit("-"), F.coalesce(-F.col("b.p"), F.col("apos")))
    # where the last ride is left earlier, the walk behind it is the one from there
    shorter = F.max(F.col("b.out_s"))
    each = rows.groupBy("deadline_s", F.col("origin").alias("stop_id")).agg(
        F.min_by("v", "leg").alias("v"), F.count(F.when(ride, 1)).alias("rides"), F.max(F.when(F.col("leg") == F.col("last_ride"), arrive)).alias("arrived"),
        F.coalesce(shorter, F.sum(F.when(behind, F.col("w")).otherwise(0))).alias("out_s"), F.sum(F.when(behind, 0).otherwise(F.col("w"))).alias("before_s"),
        F.sort_array(F.collect_list(F.when(ride, F.struct("leg", "line_name")))).alias("x"),
        F.min(F.when(ride & (arrive - F.col("dep_s") >= TINY_HOP_S), F.struct((F.col("dep_s") - arrive).alias("d"), "line_name"))).alias("top"),
        F.sort_array(F.collect_list(F.when(ride, F.struct("leg", seg.alias("seg"))))).alias("segs"), F.sum(F.when(ride, arrive - F.col("dep_s")).otherwise(0)).alias("ride_s"), F.count(F.when(ride & (arrive - F.col("dep_s") >= TINY_HOP_S), 1)).alias("depth"),
        F.sum(F.when(F.col("leg") < F.col("first_ride"), F.col("w")).otherwise(0)).alias("foot_s"), F.min(F.when(ride, F.struct("leg", "pattern_id", "trip_id", "bpos", "dep_s"))).alias("f"),
    )
    return each.select(
        "deadline_s", "stop_id", "v", "rides", (F.col("arrived") + F.col("out_s")).alias("finish_s"), (F.col("before_s") + F.col("out_s")).alias("walk_s"),
        F.array_join(F.transform("x", lambda r: r["line_name"]), " > ").alias("route"), F.col("top.line_name").alias("dominant"),
        F.array_join(F.transform("segs", lambda r: r["seg"]), ">").alias("shape"), "f.pattern_id", "f.trip_id", "f.bpos", F.col("f.dep_s").alias("ride_dep_s"),
        F.get("segs", F.lit(0))["seg"].alias("seg"), F.get("segs", F.size("segs") - 1)["seg"].alias("last_seg"), "foot_s", (F.col("before_s") - F.col("foot_s")).alias("hop_s"), "out_s", "ride_s", "depth",
    )


def _tail_s(board: Column) -> Column:
    """Seconds from boarding time to the destination: by the clock with rides, else the walk."""
    return F.when(F.col("rides") > 0, F.col("finish_s") - board).otherwise(F.col("walk_s"))


def templates(anchors: DataFrame, tail: DataFrame, window_start: int) -> DataFrame:
    """(stop_id, board_s, deadline_s, reanchored, tail_s, walk_s, rides, route): a stop's anchor, if its chain can be boarded.

    anchors: stop_id, dep_s, arr_w_s. A monotone profile may name a deadline whose own chain leaves before dep_s; it is then
    anchored at that chain's latest time, if that lies in the window, else dropped.
    """
    rows = anchors.select("stop_id", "dep_s", F.col("arr_w_s").alias("deadline_s")).join(tail, ["stop_id", "deadline_s"])
    board = F.when(F.col("dep_s") <= F.col("v"), F.col("dep_s")).when(F.col("v") >= window_start, F.col("v"))
    rows = rows.withColumn("board_s", board.cast("long")).where("board_s is not null")
    return rows.select("stop_id", "board_s", "deadline_s", (F.col("board_s") != F.col("dep_s")).alias("reanchored"), _tail_s(F.col("board_s")).cast("long").alias("tail_s"), "walk_s", "rides", "route")


def primary(access: DataFrame, template: DataFrame, purewalk: DataFrame) -> DataFrame:
    """(cell_id, raw_s, board_s, stop_id): the least exact total; then access walk, later boarding, stop; walking wins ties."""
    ride = access.join(template, "stop_id").select("cell_id", (F.col("tail_s") + F.col("walk_to_s")).alias("raw_s"), "walk_to_s", (-F.col("board_s")).alias("b"), "stop_id")
    none = F.lit(-1).cast("long")
    walk = purewalk.select("cell_id", F.col("walk_only_s").alias("raw_s"), none, F.lit(None).cast("long"), none)
    best = ride.union(walk).groupBy("cell_id").agg(F.min(F.struct("raw_s", "walk_to_s", "b", "stop_id")).alias("x"))
    return best.select("cell_id", "x.raw_s", (-F.col("x.b")).alias("board_s"), F.when(F.col("x.stop_id") >= 0, F.col("x.stop_id")).alias("stop_id"))


def probes(arrivals: DataFrame, tail: DataFrame, departures: list[int]) -> DataFrame:
    """(stop_id, dep_s, deadline_s, ok): every board minute, tested against the one trace of its stop and deadline."""
    asked = arrivals.where(F.col("dep_s").between(departures[0], departures[-1])).select("stop_id", "dep_s", F.col("arr_w_s").alias("deadline_s"))
    traces = asked.select("stop_id", "deadline_s").distinct().join(tail.select("stop_id", "deadline_s", "v"), ["stop_id", "deadline_s"])
    return asked.join(traces, ["stop_id", "deadline_s"]).select("stop_id", "dep_s", "deadline_s", (F.col("dep_s") <= F.col("v")).alias("ok"))


def stop_branches(probe: DataFrame, tail: DataFrame) -> DataFrame:
    """(stop_id, route, tail_s, board_s, deadline_s, walk_s, rides): each route's best instance from a stop over all board minutes."""
    rows = probe.where("ok").join(tail.where("rides > 0"), ["stop_id", "deadline_s"])
    best = rows.groupBy("stop_id", "route").agg(F.min(F.struct(_tail_s(F.col("dep_s")).alias("tail_s"), (-F.col("dep_s")).alias("b"), "deadline_s", "walk_s", "rides")).alias("x"))
    return best.select("stop_id", "route", "x.tail_s", (-F.col("x.b")).alias("board_s"), "x.deadline_s", "x.walk_s", "x.rides")


def branches(access: DataFrame, by_stop: DataFrame, base: DataFrame, window_s: int, cap_s: int = CAP_S) -> DataFrame:
    """(cell_id, route, total_s, stop_id, board_s, deadline_s, walk_s, transfers): the best instance of each route within the window of the base.

    access: cell_id, stop_id, walk_to_s. base: cell_id, raw_s. Ties: shorter access, later boarding, smaller stop.
    """
    rows = access.join(by_stop, "stop_id").join(base.select("cell_id", F.col("raw_s").alias("base_s")), "cell_id")
    total = F.col("tail_s") + F.col("walk_to_s")
    rows = rows.withColumn("total_s", total).where((F.ceil(total / 60) <= F.ceil(F.col("base_s") / 60) + window_s // 60) & (total < cap_s))
    key = F.struct("total_s", "walk_to_s", (-F.col("board_s")).alias("b"), "stop_id", "deadline_s", "walk_s", "rides")
    best = rows.groupBy("cell_id", "route").agg(F.min(key).alias("x"))
    return best.select("cell_id", "route", "x.total_s", "x.stop_id", (-F.col("x.b")).alias("board_s"), "x.deadline_s", (F.col("x.walk_s") + F.col("x.walk_to_s")).alias("walk_s"), (F.col("x.rides") - 1).alias("transfers"))


def coverage(access: DataFrame, template: DataFrame, base: DataFrame, window_s: int, cap_s: int = CAP_S) -> DataFrame:
    """(cell_id, stop_id): stops whose own best template, walk included, still lies in the window; no branch within it starts elsewhere."""
    rows = access.join(template, "stop_id").join(base.select("cell_id", F.col("raw_s").alias("base_s")), "cell_id")
    total = F.col("tail_s") + F.col("walk_to_s")
    return rows.where((F.ceil(total / 60) <= F.ceil(F.col("base_s") / 60) + window_s // 60) & (total < cap_s)).select("cell_id", "stop_id")


def station_closure(access: DataFrame, seeds: DataFrame, near: DataFrame) -> DataFrame:
    """(cell_id, stop_id): the seeds, and the cell's other stops within a station's radius of one of them.

    seeds: cell_id, stop_id. near: (stop_id, other_id), pairs within the radius.
    """
    own = access.select("cell_id", "stop_id")
    first = seeds.join(own, ["cell_id", "stop_id"], "left_semi")
    more = first.join(near, "stop_id").select("cell_id", F.col("other_id").alias("stop_id")).join(own, ["cell_id", "stop_id"], "left_semi")
    return first.union(more).distinct()


def line_alternatives(access: DataFrame, tail: DataFrame, window_min: int, cap_min: int = 75) -> DataFrame:
    """(cell_id, line_name, minutes, stop_id): each dominant line's best minute by one deadline, within the window of the cell's best."""
    own = access.join(tail.where("dominant is not null"), "stop_id")
    minutes = F.ceil((F.col("deadline_s") - F.col("v") + F.col("walk_to_s")) / 60).cast("long")
    best = own.withColumn("m", minutes).where(F.col("m") < cap_min).groupBy("cell_id", F.col("dominant").alias("line_name")).agg(F.min(F.struct("m", "stop_id")).alias("x"))
    best = best.select("cell_id", "line_name", F.col("x.m").alias("minutes"), "x.stop_id")
    return best.withColumn("lo", F.min("minutes").over(Window.partitionBy("cell_id"))).where(F.col("minutes") <= F.col("lo") + window_min).drop("lo")


def branches_by(access: DataFrame, tail: DataFrame, purewalk: DataFrame, deadline: int, window_min: int, cap_min: int = 75) -> tuple[DataFrame, DataFrame]:
    """Branches of arriving by one deadline, and the primary of every cell (cell_id, raw_s, stop_id; no stop where walking is quicker).

    tail: tails() of that deadline. A branch is (cell_id, shape, route, seg, last_seg, total_s, access_s, transfers, hop_s, out_s, ride_s, dep_s) and how it is begun
    (stop_id, board_s, foot_s, walk_to_s, pattern_id, bpos): the best of its shape, by seconds, then walk before boarding, then stop, within the window of the primary's minute.
    """
    own = access.join(tail.where("rides > 0").withColumnRenamed("v", "board_s"), "stop_id").withColumn("total_s", F.lit(deadline) - F.col("board_s") + F.col("walk_to_s"))
    own = own.withColumn("access_s", F.col("walk_to_s") + F.col("foot_s"))
    key = F.struct("total_s", "access_s", "stop_id", "route", "seg", "last_seg", (F.col("rides") - 1).alias("transfers"), "hop_s", "out_s", "ride_s", F.col("ride_dep_s").alias("dep_s"), "board_s", "foot_s", "walk_to_s", "pattern_id", "bpos")
    each = own.groupBy("cell_id", "shape").agg(F.min(key).alias("x")).select("cell_id", "shape", "x.*")
    ride = each.groupBy("cell_id").agg(F.min(F.struct("total_s", "access_s", "stop_id")).alias("y"))
    both = ride.join(purewalk, "cell_id", "full_outer")
    walks = F.col("walk_only_s").isNotNull() & (F.col("y.total_s").isNull() | (F.col("walk_only_s") < F.col("y.total_s")))
    base = both.select("cell_id", F.when(walks, F.col("walk_only_s")).otherwise(F.col("y.total_s")).alias("raw_s"), F.when(~walks, F.col("y.stop_id")).alias("stop_id"))
    minute = F.ceil(F.col("total_s") / 60)
    found = each.join(base.select("cell_id", F.ceil(F.col("raw_s") / 60).alias("lo")), "cell_id").where((minute < cap_min) & (minute <= F.col("lo") + window_min)).drop("lo")
    return found, base


def planned_window(access: DataFrame, template: DataFrame, tail: DataFrame, base: DataFrame, window_min: int, cap_min: int = 75) -> DataFrame:
    """(cell_id, route, minutes, stop_id): the routes of the stops in reach that lie within the window of the planned minute.

    template: one validated plan of each stop (stop_id, deadline_s, tail_s). base: cell_id, raw_s. Routes are told apart by shape while the best stop of each is found;
    of shapes with the same lines the quickest is shown, ties by shape.
    """
    plan = template.select("stop_id", "deadline_s", "tail_s").join(tail.where("rides > 0").select("stop_id", "deadline_s", "route", "shape"), ["stop_id", "deadline_s"])
    rows = access.join(plan, "stop_id").join(base.select("cell_id", F.ceil(F.col("raw_s") / 60).cast("long").alias("base")), "cell_id")
    rows = rows.withColumn("m", F.ceil((F.col("tail_s") + F.col("walk_to_s")) / 60).cast("long")).where((F.col("m") < cap_min) & (F.col("m") <= F.col("base") + window_min))
    each = rows.groupBy("cell_id", "route", "shape").agg(F.min(F.struct("m", "stop_id")).alias("x"))
    best = each.groupBy("cell_id", "route").agg(F.min(F.struct(F.col("x.m").alias("m"), "shape", F.col("x.stop_id").alias("stop_id"))).alias("y"))
    return best.select("cell_id", "route", F.col("y.m").alias("minutes"), "y.stop_id")


def committed_rides(legs: DataFrame, stop_time: DataFrame, egress: DataFrame) -> DataFrame:
    """(deadline_s, stop_id, pattern_id, bpos, apos, folded_pattern, tiny): the first ride behind each label, and the first one of at least TINY_HOP_S.

    tiny: the first ride is shorter than that, so a display that folds such hops into the walk commits to folded_pattern, or to none. A last ride lasts to where it is
    left, as in tails().
    """
    chain = chain_legs(legs, stop_time, egress).where("kind = 'ride'")
    drawn = legs.where("kind = 'ride'").select("deadline_s", F.col("origin").alias("stop_id"), "leg", "bpos", "apos")
    rows = chain.select("deadline_s", "stop_id", "leg", "pattern_id", (F.col("arr_s") - F.col("dep_s") >= TINY_HOP_S).alias("whole")).join(drawn, ["deadline_s", "stop_id", "leg"])
    ride = F.struct("leg", "pattern_id", "bpos", "apos")
    first = rows.groupBy("deadline_s", "stop_id").agg(F.min(ride).alias("f"), F.min(F.when(F.col("whole"), ride)).alias("w"))
    tiny = F.col("w").isNull() | (F.col("w.leg") != F.col("f.leg"))
    return first.select("deadline_s", "stop_id", "f.pattern_id", "f.bpos", "f.apos", F.col("w.pattern_id").alias("folded_pattern"), tiny.alias("tiny"))


def ride_geometry(legs: DataFrame, pattern_stop: DataFrame, stop: DataFrame, line: DataFrame) -> DataFrame:
    """(deadline_s, origin, leg, line_name, board, alight, toward, points): facts and drawn points of every ride.

    toward is the last stop of the pattern; points are the stops from boarding to alighting in order, as 'x y' pairs.
    """
    rides = legs.where("kind = 'ride'").select("deadline_s", "origin", "leg", "pattern_id", "bpos", "apos")
    placed = pattern_stop.join(stop, "stop_id")
    ends = placed.groupBy("pattern_id").agg(F.max_by("stop_id", "pos").alias("toward"))
    slices = rides.select("pattern_id", "bpos", "apos").distinct().join(placed, "pattern_id").where("pos between bpos and apos")
    x = F.sort_array(F.collect_list(F.struct("pos", "stop_id", "x_m", "y_m")))
    slices = slices.groupBy("pattern_id", "bpos", "apos").agg(x.alias("x")).select(
        "pattern_id", "bpos", "apos", F.col("x")[0]["stop_id"].alias("board"), F.element_at("x", -1)["stop_id"].alias("alight"),
        F.array_join(F.transform("x", lambda p: F.concat_ws(" ", p["x_m"], p["y_m"])), ",").alias("points"),
    )
    return rides.join(slices, ["pattern_id", "bpos", "apos"]).join(ends, "pattern_id").join(line.select("pattern_id", "line_name"), "pattern_id").select(
        "deadline_s", "origin", "leg", "line_name", "board", "alight", "toward", "points"
    )


def alternatives(found: DataFrame, base: DataFrame, cap: int = 6) -> DataFrame:
    """(cell_id, slot, route, minutes, walk_s, transfers): a cell's branches beside its primary route, ranked, none beaten in all respects.

    The primary is the route of the least total; others that a kept one matches in minutes, walk and transfers and beats in one go.
    """
    rows = found.withColumn("minutes", F.ceil(F.col("total_s") / 60).cast("long"))
    order = Window.partitionBy("cell_id").orderBy("total_s", "route")
    rows = rows.withColumn("k", F.row_number().over(order))
    points = rows.select("cell_id", "minutes", "walk_s", "transfers").distinct()
    other = points.toDF("cell_id", "m2", "w2", "t2")
    no_worse = (F.col("m2") <= F.col("minutes")) & (F.col("w2") <= F.col("walk_s")) & (F.col("t2") <= F.col("transfers"))
    better = (F.col("m2") < F.col("minutes")) | (F.col("w2") < F.col("walk_s")) | (F.col("t2") < F.col("transfers"))
    beaten = points.join(other, "cell_id").where(no_worse & better).select(*points.columns).distinct()
    kept = rows.where("k > 1").join(beaten, points.columns, "left_anti").join(base.select("cell_id"), "cell_id", "left_semi")
    slot = F.row_number().over(Window.partitionBy("cell_id").orderBy("minutes", "walk_s", "transfers", "route")).cast("long")
    return kept.withColumn("slot", slot).where(F.col("slot") <= cap).select("cell_id", "slot", "route", "minutes", "walk_s", "transfers", "stop_id", "deadline_s")


def itineraries(best: DataFrame, legs: DataFrame) -> DataFrame:
    """(cell_id, leg, kind, pattern_id, sec): the walk to the chosen stop and the legs behind it, each until the next one's latest time.

    best: cell_id, stop_id, access_s. A leg's seconds hold the wait behind it, so they add up to the cell's total.
    """
    journey = Window.partitionBy("deadline_s", "origin").orderBy("leg")
    spans = legs.withColumn("sec", F.coalesce(F.lead("v").over(journey), F.col("deadline_s")) - F.col("v"))
    first = best.select("cell_id", F.lit(0).cast("long").alias("leg"), F.lit("access").alias("kind"), F.lit(None).cast("long").alias("pattern_id"), F.col("access_s").alias("sec"))
    rest = best.join(spans, F.col("stop_id") == F.col("origin")).select("cell_id", (F.col("leg") + 1).alias("leg"), "kind", "pattern_id", "sec")
    return first.union(rest)


def chain_legs(legs: DataFrame, stop_time: DataFrame, egress: DataFrame) -> DataFrame:
    """(deadline_s, stop_id, leg, kind, pattern_id, dep_s, arr_s, walk_s): the legs behind every label as they are travelled.

    legs: as search.trace() gives them. The last ride is left where tails() leaves it, and one walk from there to the destination ends the chain.
    """
    journey = Window.partitionBy("deadline_s", "origin").orderBy("leg")
    own = Window.partitionBy("deadline_s", "origin")
    ahead, ride = F.lead("v").over(journey), F.col("kind") == "ride"
    rows = legs.withColumn("walk_s", F.when(F.col("kind") == "foot", ahead - F.col("v")).when(F.col("kind") == "egress", F.col("deadline_s") - F.col("v")).otherwise(0))
    rows = rows.withColumn("last_ride", F.max(F.when(ride, F.col("leg"))).over(own)).withColumn("n", F.max("leg").over(own))
    rows = rows.withColumn("behind_s", F.sum(F.when(F.col("leg") > F.col("last_ride"), F.col("walk_s"))).over(own)).where("last_ride is null or leg <= last_ride")
    ends = rows.where(ride & (F.col("leg") == F.col("last_ride"))).select("deadline_s", "origin", "leg", "n", "pattern_id", "trip_id", "bpos", "behind_s")
    later = ends.where("leg = n - 1").join(stop_time.select("pattern_id", "trip_id", "pos", "stop_id", F.col("arr_s").alias("at_s")), ["pattern_id", "trip_id"]).where("pos > bpos").join(egress.select("stop_id", F.col("walk_s").alias("out_s")), "stop_id")
    best = later.groupBy("deadline_s", "origin", "leg").agg(F.min(F.struct((F.col("at_s") + F.col("out_s")).alias("finish"), "out_s", (-F.col("pos")).alias("p"), "at_s")).alias("b"))
    rides = rows.join(best, ["deadline_s", "origin", "leg"], "left")
    cols = ("deadline_s", F.col("origin").alias("stop_id"), "leg", "kind", "pattern_id", "dep_s", F.coalesce("b.at_s", "arr_s").alias("arr_s"), "walk_s")
    none = F.lit(None).cast("long")
    final = ends.join(best, ["deadline_s", "origin", "leg"], "left").select("deadline_s", F.col("origin").alias("stop_id"), (F.col("leg") + 1).alias("leg"), F.lit("egress").alias("kind"), none.alias("pattern_id"), none.alias("dep_s"), none.alias("arr_s"), F.coalesce("b.out_s", "behind_s").alias("walk_s"))
    return rides.select(*cols).withColumn("dep_s", F.when(ride, F.col("dep_s"))).unionByName(final)


def forward_itineraries(chosen: DataFrame, chain: DataFrame) -> DataFrame:
    """(cell_id, leg, kind, pattern_id, sec, wait_s): what a cell does from leaving home on, by a forward clock over the chosen chain.

    chosen: cell_id, stop_id, deadline_s, board_s (when the stop is reached), access_s; without a stop (null), access_s is the walk to the
    destination. Rides wait for their departure, so seconds and waits add up to the arrival less the departure from home.
    """
    own = chosen.select("cell_id", F.lit(0).cast("long").alias("leg"), F.when(F.col("stop_id").isNull(), "walk").otherwise("access").alias("kind"), F.lit(None).cast("long").alias("pattern_id"), F.col("access_s").alias("sec"), F.lit(0).cast("long").alias("wait_s"))
    rows = chosen.where("stop_id is not null").select("cell_id", "stop_id", "deadline_s", "board_s").join(chain, ["stop_id", "deadline_s"])
    before = Window.partitionBy("cell_id").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    ride = F.col("kind") == "ride"
    walked = F.coalesce(F.sum("walk_s").over(before), F.lit(0))
    rows = rows.withColumn("walked", walked).withColumn("last", F.last(F.when(ride, F.struct("arr_s", "walked")), ignorenulls=True).over(before))
    clock = F.coalesce(F.col("last.arr_s") + F.col("walked") - F.col("last.walked"), F.col("board_s") + F.col("walked"))
    sec = F.when(ride, F.col("arr_s") - F.col("dep_s")).otherwise(F.col("walk_s"))
    wait = F.when(ride, F.col("dep_s") - clock).otherwise(0)
    rest = rows.select("cell_id", (F.col("leg") + 1).alias("leg"), "kind", "pattern_id", sec.alias("sec"), wait.alias("wait_s"))
    return own.unionByName(rest)


def first_rides(legs: DataFrame) -> DataFrame:
    """(deadline_s, stop_id, pattern_id, bpos, apos, foot_s): the first ride behind each label, and the walk from the stop to it."""
    journey = Window.partitionBy("deadline_s", "origin").orderBy("leg")
    walk = F.when(F.col("kind") == "foot", F.lead("v").over(journey) - F.col("v")).otherwise(0)
    rows = legs.withColumn("w", walk).withColumn("foot_s", F.sum("w").over(journey.rowsBetween(Window.unboundedPreceding, 0))).where("kind = 'ride'")
    best = rows.groupBy("deadline_s", F.col("origin").alias("stop_id")).agg(F.min(F.struct("leg", "pattern_id", "bpos", "apos", "foot_s")).alias("x"))
    return best.select("deadline_s", "stop_id", "x.pattern_id", "x.bpos", "x.apos", "x.foot_s")


def commits(chosen: DataFrame, access: DataFrame, first: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """(ids, home_s, walk_s, pattern_id, bpos, apos): when home is left and which ride is committed to.

    chosen: ids (cell_id among them), stop_id, board_s, deadline_s. access: cell_id, stop_id, walk_to_s.
    """
    rows = chosen.join(access, ["cell_id", "stop_id"]).join(first, ["deadline_s", "stop_id"])
    return rows.select(*ids, (F.col("board_s") - F.col("walk_to_s")).alias("home_s"), (F.col("walk_to_s") + F.col("foot_s")).alias("walk_s"), "pattern_id", "bpos", "apos")


def folded_walks(legs: DataFrame, target: DataFrame) -> DataFrame:
    """(journey, leg, kind, sec, physical_s, allowance_s, wait_s): the first ride's wait becomes allowance of the walk before it.

    legs: journey, leg, kind, dur_s, wait_s. target: journey, target_s. Where no walk comes before the first ride, a walk of
    allowance alone is put in front, as leg 0. What the journey then lacks of its target is allowance of the first walk before a ride
    too; what it exceeds is taken from the allowance, never from walking. Later waits stay.
    """
    own = Window.partitionBy("journey")
    rows = legs.withColumn("first_ride", F.min(F.when(F.col("kind") == "ride", F.col("leg"))).over(own))
    rows = rows.withColumn("fold_s", F.coalesce(F.max(F.when(F.col("leg") == F.col("first_ride"), F.col("wait_s"))).over(own), F.lit(0)))
    early = (F.col("kind") == "walk") & (F.col("leg") < F.coalesce("first_ride", F.lit(1 << 30)))
    rows = rows.withColumn("near", F.max(F.when(early, F.col("leg"))).over(own)).withColumn("front", F.min(F.when(early, F.col("leg"))).over(own))
    rows = rows.withColumn("total_s", F.sum(F.col("dur_s") + F.col("wait_s")).over(own)).join(target, "journey")
    gap = F.col("target_s") - F.col("total_s")
    # a surplus goes to the first walk, a lack comes out of the allowance that the fold has made
    fold = F.when(gap < 0, F.greatest(F.col("fold_s") + gap, F.lit(0))).otherwise(F.col("fold_s"))
    more = F.greatest(gap, F.lit(0))
    allowance = F.when(F.col("leg") == F.col("near"), fold).otherwise(0) + F.when(F.col("leg") == F.col("front"), more).otherwise(0)
    wait = F.when(F.col("leg") == F.col("first_ride"), 0).otherwise(F.col("wait_s"))
    whole = rows.select("journey", "leg", "kind", F.col("dur_s").alias("physical_s"), allowance.alias("allowance_s"), wait.alias("wait_s"))
    added = rows.where((F.col("near").isNull()) & (F.col("leg") == F.col("first_ride")) & (fold + more > 0))
    added = added.select("journey", F.lit(0).cast("long").alias("leg"), F.lit("walk").alias("kind"), F.lit(0).cast("long").alias("physical_s"), (fold + more).alias("allowance_s"), F.lit(0).cast("long").alias("wait_s"))
    return whole.union(added).select("journey", "leg", "kind", (F.col("physical_s") + F.col("allowance_s")).cast("long").alias("sec"), "physical_s", F.col("allowance_s").cast("long").alias("allowance_s"), F.col("wait_s").cast("long").alias("wait_s"))
