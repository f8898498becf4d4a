"""Corridors of boarding: profiles of patterns' first metres, their overlap, signatures of arrival, and first-wins duplicates.

Points are in metres on a plane. Pairs meet by buckets of the boarding point; paths are short arrays, compared by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators import spatial
from wayfold.operators.rounds import settle

#: Points of a prefix, length that must be covered both ways, and the reaches and angles of the corridor test.
PREFIX, COVERED_M = 4, 200
SAME_LINE_M, SAME_LINE_DEG, OTHER_M, OTHER_DEG = 300, 100, 150, 40


def _points(pattern_stop: DataFrame, stop: DataFrame) -> DataFrame:
    x = F.sort_array(F.collect_list(F.struct("pos", "x_m", "y_m")))
    return pattern_stop.join(stop, "stop_id").groupBy("pattern_id").agg(x.alias("pts"))


def boarding_profiles(pattern_stop: DataFrame, stop: DataFrame, line: DataFrame) -> DataFrame:
    """(pattern_id, line_name, service, bx, by, hx, hy, prefix): boarding point, unit heading to the next point, first points."""
    rows = _points(pattern_stop, stop).where(F.size("pts") > 1).join(line.select("pattern_id", "line_name", F.col("mode").alias("service")), "pattern_id")
    a, b = F.col("pts")[0], F.col("pts")[1]
    dx, dy = b["x_m"] - a["x_m"], b["y_m"] - a["y_m"]
    norm = F.sqrt((dx * dx + dy * dy).cast("double"))
    rows = rows.where((dx != 0) | (dy != 0))
    return rows.select("pattern_id", "line_name", "service", a["x_m"].alias("bx"), a["y_m"].alias("by"), (dx / norm).alias("hx"), (dy / norm).alias("hy"), F.slice("pts", 1, PREFIX).alias("prefix"))


def _segments(path: Column) -> Column:
    """array<struct<a, b>> of consecutive points."""
    return F.zip_with(F.slice(path, 1, F.size(path) - 1), F.slice(path, 2, F.size(path) - 1), lambda p, q: F.struct(p.alias("a"), q.alias("b")))


def covered_m(path: Column, other: Column, radius: float) -> Column:
    """Length of the segments of a path whose middle is within radius of another path."""

    def length(s):
        mx, my = (s["a"]["x_m"] + s["b"]["x_m"]) / 2.0, (s["a"]["y_m"] + s["b"]["y_m"]) / 2.0
        near = F.array_min(F.transform(_segments(other), lambda o: spatial.segment_distance_sq(mx, my, o["a"]["x_m"], o["a"]["y_m"], o["b"]["x_m"], o["b"]["y_m"])))
        dx, dy = s["b"]["x_m"] - s["a"]["x_m"], s["b"]["y_m"] - s["a"]["y_m"]
        return F.when(near <= radius * radius, F.sqrt((dx * dx + dy * dy).cast("double"))).otherwise(0.0)

    return F.round(F.aggregate(F.transform(_segments(path), length), F.lit(0.0), lambda s, x: s + x), 3)


def _flat(path: str, x: str) -> list[Column]:
    """The points of a prefix as columns, null behind its end: pairs are many, and arrays in them are slow."""
    return [F.get(path, F.lit(k))[c].alias(f"{c[0]}{k}_{x}") for k in range(PREFIX) for c in ("x_m", "y_m")]


def _covered(x: str, other: str, radius: float) -> Column:
    """covered_m() of two flat prefixes."""
    at = lambda c, k, side: F.col(f"{c}{k}_{side}")
    total = F.lit(0.0)
    for k in range(PREFIX - 1):
        ax, ay, bx, by = at("x", k, x), at("y", k, x), at("x", k + 1, x), at("y", k + 1, x)
        mx, my, dx, dy = (ax + bx) / 2.0, (ay + by) / 2.0, bx - ax, by - ay
        near = F.lit(False)
        for j in range(PREFIX - 1):
            d2 = spatial.segment_distance_sq(mx, my, at("x", j, other), at("y", j, other), at("x", j + 1, other), at("y", j + 1, other))
            near = near | F.coalesce((d2 <= radius * radius) & at("x", j + 1, other).isNotNull(), F.lit(False))
        total = total + F.when(bx.isNotNull() & near, F.sqrt((dx * dx + dy * dy).cast("double"))).otherwise(0.0)
    return F.round(total, 3)


def overlaps(profiles: DataFrame, reach: float, radius: float) -> DataFrame:
    """Pairs of profiles of one service whose boarding points lie within reach, with what each covers of the other.

    (pattern_a, pattern_b, d2, dot, same_line, covered_a, covered_b, overlap); pattern_a is the smaller.
    """
    profiles = settle(profiles, "profiles")  # read for both sides
    side = lambda x: profiles.select("service", F.col("bx").alias("x_m"), F.col("by").alias("y_m"), F.col("pattern_id").alias(f"pattern_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("line_name", "hx", "hy")), *_flat("prefix", x))
    met = spatial.met(side("a"), side("b"), reach, ["service"]).where((F.col("d2") <= reach * reach) & (F.col("pattern_a") < F.col("pattern_b")))
    rows = met.withColumn("covered_a", _covered("a", "b", radius)).withColumn("covered_b", _covered("b", "a", radius))
    dot = F.round(F.col("hx_a") * F.col("hx_b") + F.col("hy_a") * F.col("hy_b"), 9)
    return rows.select("pattern_a", "pattern_b", "d2", dot.alias("dot"), (F.col("line_name_a") == F.col("line_name_b")).alias("same_line"), "covered_a", "covered_b", ((F.col("covered_a") >= COVERED_M) & (F.col("covered_b") >= COVERED_M)).alias("overlap"))


def same_corridor(pairs: DataFrame) -> DataFrame:
    """pairs plus `same`: one line leaving about the same way from near by, or two lines that leave together."""
    turn = lambda deg: F.cos(F.radians(F.lit(float(deg))))
    one = F.col("same_line") & (F.col("d2") <= SAME_LINE_M**2) & (F.col("dot") >= turn(SAME_LINE_DEG))
    two = (F.col("d2") <= OTHER_M**2) & (F.col("dot") >= turn(OTHER_DEG)) & F.col("overlap")
    return pairs.withColumn("same", one | two)


def arrival_signatures(pattern_stop: DataFrame, stop: DataFrame, line: DataFrame) -> DataFrame:
    """(pattern_id, signature): service, last point on a 10 m grid, and the heading into it in sixteenths from north."""
    rows = _points(pattern_stop, stop).where(F.size("pts") > 1).join(line.select("pattern_id", "mode"), "pattern_id")
    b, a = F.element_at("pts", -1), F.element_at("pts", -2)
    angle = F.atan2((b["x_m"] - a["x_m"]).cast("double"), (b["y_m"] - a["y_m"]).cast("double"))
    angle = F.when(angle < 0, angle + 2 * F.pi()).otherwise(angle)
    heading = F.bround(F.round(angle / (F.pi() / 8), 9)).cast("long") % 16
    grid = lambda c: F.bround(c / 10.0).cast("long").cast("string")
    return rows.select("pattern_id", F.concat("mode", F.lit("|arrive:"), grid(b["x_m"]), F.lit("_"), grid(b["y_m"]), F.lit("_h"), heading.cast("string")).alias("signature"))


def first_wins(hits: DataFrame, group: str, rank: str) -> DataFrame:
    """The hits that share neither id, place nor name with one kept before them, in rank order within each group.

    hits: group, rank, id (may be null), place, label. Which hit is kept depends on those kept before, so a group's hits, the
    answer to one search, are folded as one array; keys differ by hit, so this isn't three first-per-key filters.
    """
    name = F.rtrim(F.lower(F.regexp_replace(F.trim("label"), r"\s+", " ")), F.lit(" ,."))
    x = F.sort_array(F.collect_list(F.struct(rank, "id", "place", name.alias("name"))))
    rows = hits.groupBy(group).agg(x.alias("x"))
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast(f"array<{hits.schema[rank].dataType.simpleString()}>").alias("kept"), none.alias("ids"), none.alias("places"), none.alias("names"))

    def step(acc, h):
        seen = F.coalesce(F.array_contains(acc["ids"], h["id"]), F.lit(False)) | F.array_contains(acc["places"], h["place"]) | F.array_contains(acc["names"], h["name"])
        more = F.struct(
            F.concat(acc["kept"], F.array(h[rank])).alias("kept"), F.when(h["id"].isNotNull(), F.concat(acc["ids"], F.array(h["id"]))).otherwise(acc["ids"]).alias("ids"),
            F.concat(acc["places"], F.array(h["place"])).alias("places"), F.concat(acc["names"], F.array(h["name"])).alias("names"),
        )
        return F.when(seen, acc).otherwise(more)

    return rows.select(group, F.explode(F.aggregate("x", start, step, lambda acc: acc["kept"])).alias(rank))
