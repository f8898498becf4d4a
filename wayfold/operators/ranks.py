"""Ranks, running sums and exact percentiles over all rows or a few large groups, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.rounds import settle


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column], tag: str, within: tuple[str, ...] = ()) -> DataFrame:
    """df with inclusive running sums in a total order, over all rows or within groups.

    Rows are dealt to ranges of (within, order) and written, so that the ranges stay as they are; sums run inside each range, after
    the totals of the ranges before, a row per range and group in it.
    """
    dealt = settle(df.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()), tag)
    totals = dealt.groupBy("_range", *within).agg(*(F.sum(x).alias(f"_{c}") for c, x in sums.items()))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *within, *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums))
    inside = Window.partitionBy("_range", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(totals, ["_range", *within])
    return out.select(*df.columns, *((F.sum(x).over(inside) + F.col(f"_{c}")).alias(c) for c, x in sums.items()))


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, one column per share): exact linear percentiles.

    Equal values are counted first; a percentile lies between the values at two positions, found among the running counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    upto = settle(with_running(counts, [F.col(value)], {"upto": F.col("c")}, "ranks", (group,)), "upto")
    total = upto.groupBy(group).agg(F.sum("c").alias("n"))
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(p).alias("p")) for k, p in shares.items()))).alias("q")
    place = total.select(group, "n", asked).withColumn("x", (F.col("n") - 1) * F.col("q.p"))
    ends = place.select(group, "q.name", "x", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.floor("x").alias("k")), F.struct(F.lit("b").alias("side"), F.ceil("x").alias("k")))).alias("e")).select(group, "name", "x", "e.*")
    # a position k, from 0, holds the value whose counts reach beyond it
    hit = upto.join(ends, group).where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k")))  # two rows per share and group
    both = hit.groupBy(group, "name", "x").pivot("side", ["a", "b"]).agg(F.first(value))
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("x") - F.floor("x"))
    return both.withColumn("v", between).groupBy(group).pivot("name", list(shares)).agg(F.first("v"))
