"""Legs and minutes of a journey."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconciled_minutes(legs: DataFrame) -> DataFrame:
    """(journey, leg, minutes) from (journey, leg, sec): whole minutes that add up to the journey's minutes, rounded up.

    Largest remainder: legs get their whole minutes, and those with the largest rest, earlier legs first, one more each.
    """
    every = Window.partitionBy("journey")
    total = F.ceil(F.sum("sec").over(every) / 60) - F.sum(F.floor(F.col("sec") / 60)).over(every)
    order = every.orderBy(F.desc(F.col("sec") % 60), "leg")
    more = F.when(F.row_number().over(order) <= F.col("need"), 1).otherwise(0)
    return legs.withColumn("need", total).withColumn("more", more).select("journey", "leg", (F.floor(F.col("sec") / 60) + F.col("more")).cast("long").alias("minutes"))


def clocked(legs: DataFrame) -> DataFrame:
    """(journey, leg, wait_s, arr_s): the clock along each journey's legs, which leave no earlier than their departure.

    legs: journey, leg, dep_s, dur_s; a leg waits until its departure, walks leave at once.
    """
    rows = legs.groupBy("journey").agg(F.sort_array(F.collect_list(F.struct("leg", "dep_s", "dur_s", "kind"))).alias("x"))
    first = F.struct(F.col("x")[0]["dep_s"].alias("clock"), F.array().cast("array<struct<leg:bigint,wait_s:bigint,arr_s:bigint>>").alias("out"))

    def step(acc, x):
        leave = F.when(x["kind"] == "walk", acc["clock"]).otherwise(F.greatest(acc["clock"], x["dep_s"]))
        arrive = leave + x["dur_s"]
        return F.struct(arrive.alias("clock"), F.concat(acc["out"], F.array(F.struct(x["leg"].alias("leg"), (leave - acc["clock"]).alias("wait_s"), arrive.alias("arr_s")))).alias("out"))

    return rows.select("journey", F.inline(F.aggregate("x", first, step, lambda acc: acc["out"])))


def boardable(legs: DataFrame) -> DataFrame:
    """(journey, ok): whether every ride leaves at or after the clock that the legs before it leave."""
    rows = legs.groupBy("journey").agg(F.sort_array(F.collect_list(F.struct("leg", "dep_s", "dur_s", "kind"))).alias("x"))
    first = F.struct(F.col("x")[0]["dep_s"].alias("clock"), F.lit(True).alias("ok"))

    def step(acc, x):
        ride = x["kind"] == "ride"
        leave = F.when(ride, x["dep_s"]).otherwise(acc["clock"])
        return F.struct((leave + x["dur_s"]).alias("clock"), (acc["ok"] & (~ride | (x["dep_s"] >= acc["clock"]))).alias("ok"))

    return rows.select("journey", F.aggregate("x", first, step, lambda acc: acc["ok"]).alias("ok"))


def best_alight(boarded: DataFrame, stop_time: DataFrame, egress: DataFrame) -> DataFrame:
    """(pattern_id, trip_id, pos, finish_s): where to leave a boarded trip: earliest finish, then shorter walk, later position."""
    later = boarded.join(stop_time, ["pattern_id", "trip_id"]).where("pos > bpos").join(egress, "stop_id")
    key = F.struct((F.col("arr_s") + F.col("walk_s")).alias("finish_s"), "walk_s", (-F.col("pos")).alias("p"))
    return later.groupBy("pattern_id", "trip_id").agg(F.min(key).alias("x")).select("pattern_id", "trip_id", (-F.col("x.p")).alias("pos"), F.col("x.finish_s").alias("finish_s"))


def leg_metrics(legs: DataFrame) -> DataFrame:
    """(journey, access_s, final_s, walk_s, rides, transfers, total_s) of each journey's legs."""
    rows = legs.groupBy("journey").agg(F.sort_array(F.collect_list(F.struct("leg", "kind", "dur_s"))).alias("x"))
    walk = lambda x: x["kind"] == "walk"
    end = F.element_at("x", -1)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["dur_s"])
    rides = F.size(F.filter("x", lambda x: x["kind"] == "ride")).cast("long")
    return rows.select(
        "journey", F.when(walk(F.col("x")[0]), F.col("x")[0]["dur_s"]).otherwise(0).alias("access_s"), F.when(walk(end), end["dur_s"]).otherwise(0).alias("final_s"),
        total(F.filter("x", walk)).alias("walk_s"), rides.alias("rides"), F.greatest(rides - 1, F.lit(0)).alias("transfers"), total(F.col("x")).alias("total_s"),
    )
