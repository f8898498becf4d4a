"""The walking graph: which ways count, edges in both directions, components, shortest paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayfold.functions import walking
from wayfold.operators.rounds import settle

#: Ways open to walkers by themselves.
WALKABLE = ("residential", "footway", "steps")


def pedestrian() -> Column:
    foot, access = F.coalesce("foot", F.lit("")), F.coalesce("access", F.lit(""))
    open_ = F.col("highway").isin(*WALKABLE) | ((F.col("highway") == "cycleway") & (foot == "yes"))
    return open_ & (foot != "no") & ((access != "private") | (foot == "yes"))


def edges_of(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w_s): consecutive nodes of each way, both directions, dearer uphill; parallel edges keep the cheapest."""
    pairs = F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("c").alias("q")))).alias("e")
    steps = ways.where(pedestrian()).select((F.col("highway") == "steps").alias("stairs"), pairs).select("stairs", "e.p", "e.q")
    both = steps.select("stairs", F.col("p").alias("src"), F.col("q").alias("dst")).union(steps.select("stairs", "q", "p"))
    at = lambda s, p: nodes.select(F.col("node_id").alias(s), F.col("x_m").alias(f"{p}x"), F.col("y_m").alias(f"{p}y"), F.col("elev_m").alias(f"{p}z"))
    flat = both.join(at("src", "s"), "src").join(at("dst", "d"), "dst")
    length = F.greatest(F.abs(F.col("sx") - F.col("dx")) + F.abs(F.col("sy") - F.col("dy")), F.lit(1)).cast("double")
    w = walking.edge_seconds(length, (F.col("dz") - F.col("sz")) / length, F.col("stairs"))
    return flat.select("src", "dst", F.floor(w + 0.5).cast("long").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w_s"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w_s")


def shortest(edges: DataFrame, roots: DataFrame, cap_s: int) -> DataFrame:
    """(root, node, sec): bounded shortest paths from every root at once, relaxing only from what improved last round.

    Rounds end when nothing improves; as edges cost at least a second, that is after cap_s rounds at the latest.
    """
    out = settle(edges.select(F.col("src").alias("node"), F.col("dst"), "w_s"), "paths-edges")
    best = settle(roots.groupBy("root", "node").agg(F.min("sec").cast("long").alias("sec"), F.lit(0).alias("round")), "paths")
    k = 0
    while True:
        k += 1
        step = best.where(F.col("round") == k - 1).join(out, "node").select("root", F.col("dst").alias("node"), (F.col("sec") + F.col("w_s")).alias("sec"), F.lit(k).alias("round"))
        every = best.union(step.where(F.col("sec") <= cap_s).select(*best.columns))
        least = F.min(F.struct("sec", "round")).alias("x")  # of equal ones the earlier, which has been relaxed
        seen = Observation()
        best = settle(every.groupBy("root", "node").agg(least).select("root", "node", "x.sec", "x.round").observe(seen, F.max("round").alias("last")), "paths", instead=best)
        if seen.get["last"] != k:  # counted while the round was written; null where there are no roots
            return best.drop("round")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): weak components by minimum labels with pointer jumping."""
    both = settle(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "wcc-edges")
    labels = settle(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")), "wcc")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component")
        low = seen.union(labels).groupBy("node").agg(F.min("component").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        new = settle(low.join(jump, "low").select("node", F.least("low", "next").alias("component")), "wcc")
        done, labels = new.join(labels, ["node", "component"], "left_anti").isEmpty(), new
        if done:
            return labels


def predecessors(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(root, node, sec, pred): the smallest node from which an edge completes the shortest path; roots have none."""
    back = edges.select(F.col("src").alias("pred"), F.col("dst").alias("node"), "w_s")
    before = paths.select("root", F.col("node").alias("pred"), F.col("sec").alias("had"))
    hit = paths.join(back, "node").join(before, ["root", "pred"]).where(F.col("had") + F.col("w_s") == F.col("sec"))
    return hit.groupBy("root", "node", "sec").agg(F.min("pred").alias("pred"))


def path_tree(edges: DataFrame, paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, pred): the predecessor of every node reached; null where the root's own connector is as short as any way over an edge.

    roots: root, node, sec, the snaps of every root with the seconds to them.
    """
    direct = roots.groupBy("root", "node").agg(F.min("sec").alias("own_s"))
    over = predecessors(edges, paths).select("root", "node", "pred")
    rows = paths.join(direct, ["root", "node"], "left").join(over, ["root", "node"], "left")
    return rows.select("root", "node", F.when(F.coalesce(F.col("own_s") > F.col("sec"), F.lit(True)), F.col("pred")).alias("pred"))


def node_paths(tree: DataFrame) -> DataFrame:
    """(root, node, path): the nodes from a root's snap to each node, in walking order.

    Pointer doubling: every node knows the last 2^k nodes of its way and who comes before them, so whole ways come out after as many rounds as the
    logarithm of the longest.
    """
    ways = settle(tree.select("root", "node", F.array("node").alias("path"), F.col("pred").alias("up")), "ways")
    while not ways.where("up is not null").isEmpty():
        ahead = ways.select("root", F.col("node").alias("up"), F.col("path").alias("before"), F.col("up").alias("next"))
        longer = ways.where("up is not null").join(ahead, ["root", "up"]).select("root", "node", F.concat("before", "path").alias("path"), F.col("next").alias("up"))
        ways = settle(ways.where("up is null").select("root", "node", "path", "up").unionByName(longer), "ways", instead=ways)
    return ways.select("root", "node", "path")


def drawn(ways: DataFrame, nodes: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(root, id, sec, points): ways as 'x y' points from the place at the start to the one at the end; a place on its snap node is drawn once.

    ways: root, id, sec, path. nodes: node_id, x_m, y_m; starts: root, x_m, y_m; ends: id, x_m, y_m.
    """
    point = F.concat_ws(" ", "x_m", "y_m")
    steps = ways.select("root", "id", F.posexplode("path").alias("k", "node_id")).join(nodes.select("node_id", point.alias("p")), "node_id")
    inner = steps.groupBy("root", "id").agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("x")).select("root", "id", F.transform("x", lambda q: q["p"]).alias("inner"))
    rows = ways.join(inner, ["root", "id"]).join(starts.select("root", point.alias("a")), "root").join(ends.select("id", point.alias("z")), "id")
    every = F.concat(F.array("a"), "inner", F.array("z"))
    once = F.filter(every, lambda p, k: (k == 0) | (F.get(every, k - 1) != p))
    return rows.select("root", "id", "sec", F.array_join(once, ",").alias("points"))


def to_targets(paths: DataFrame, snaps: DataFrame, cap_s: int) -> DataFrame:
    """(root, id, node, sec): the least way from each root to each place over any of the place's snaps; of equal ones the smaller node.

    paths: root, node, sec. snaps: id, node, conn_s.
    """
    hit = paths.join(snaps, "node").withColumn("total", (F.col("sec") + F.col("conn_s")).cast("long")).where(F.col("total") <= cap_s)
    return hit.groupBy("root", "id").agg(F.min(F.struct("total", "node")).alias("x")).select("root", "id", "x.node", F.col("x.total").alias("sec"))
