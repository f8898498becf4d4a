"""Queries of transfer rules with scopes, pathways, the transfers they leave, and walks drawn on the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import spatial, transfers, walkgraph
from wayfold.operators.rounds import settle
from wayfold.plans.base import baked, query
from wayfold.plans.journeys import edges
from wayfold.plans.places import CAP, GRAPH, snapped, stop_paths

_C = lambda c: f"nullif(trim({c}),'')"
_SECONDS = "CASE WHEN try_cast(trim({0}) AS BIGINT)>=0 THEN try_cast(trim({0}) AS BIGINT) END"
_SCOPE = ", ".join(transfers.SCOPE)
RULES = f"""gr AS MATERIALIZED (SELECT {_C('from_stop_id')} AS from_id, {_C('to_stop_id')} AS to_id, {_C('transfer_type')} AS type, {', '.join(f'{_C(c)} AS {c}' for c in transfers.SCOPE)}, {_SECONDS.format('min_transfer_time')} AS s FROM gt_transfers),
    gs AS MATERIALIZED (SELECT *, coalesce({_SCOPE}) IS NOT NULL AS scoped FROM gr WHERE from_id<>to_id AND type IN ('0','1','2','3','4','5')),
    ru AS MATERIALIZED (SELECT from_id, to_id, max(s) FILTER (type<>'3') AS min_s, bool_or(type='3') AS prohibited FROM gs WHERE NOT scoped AND type NOT IN ('4','5') AND (type='3' OR s IS NOT NULL) GROUP BY ALL),
    sr AS MATERIALIZED (SELECT from_id, to_id, {_SCOPE}, CAST(NULL AS VARCHAR) AS linked, max(s) FILTER (type<>'3') AS min_s, bool_or(type='3') AS prohibited FROM gs WHERE scoped AND type NOT IN ('4','5') AND (type='3' OR s IS NOT NULL) GROUP BY ALL
        UNION ALL SELECT DISTINCT from_id, to_id, {_SCOPE}, type, CAST(NULL AS BIGINT), false FROM gs WHERE type IN ('4','5') AND from_trip_id IS NOT NULL AND to_trip_id IS NOT NULL)"""
PATHWAYS = f"""gw AS (SELECT {_C('pathway_id')} AS pathway_id, {_C('from_stop_id')} AS from_id, {_C('to_stop_id')} AS to_id, trim(is_bidirectional) AS both_ways, {_SECONDS.format('traversal_time')} AS seconds, {_C('pathway_mode')} AS mode, CASE WHEN try_cast(trim(length) AS DOUBLE)>=0 THEN try_cast(trim(length) AS DOUBLE) END AS length_m FROM gt_pathways),
    gv AS (SELECT * FROM gw WHERE pathway_id IS NOT NULL AND from_id<>to_id AND both_ways IN ('0','1')),
    pe AS MATERIALIZED (SELECT pathway_id, from_id, to_id, back, seconds, mode, length_m FROM (SELECT pathway_id, from_id, to_id, false AS back, seconds, mode, length_m FROM gv UNION ALL SELECT pathway_id, to_id, from_id, true, seconds, mode, length_m FROM gv WHERE both_ways='1') u
        QUALIFY row_number() OVER (PARTITION BY pathway_id, from_id, to_id, back ORDER BY seconds IS NULL, seconds, length_m IS NULL, length_m, coalesce(mode,''))=1)"""
BAKED = f"""{GRAPH}, {RULES}, {PATHWAYS}, wl AS MATERIALIZED (SELECT CAST(d.root AS VARCHAR) AS from_id, CAST(s.id AS VARCHAR) AS to_id, min(d.sec+s.conn) AS walk_s FROM gd d JOIN ss s ON s.node=d.node WHERE d.root<>s.id AND d.sec+s.conn<={CAP} GROUP BY d.root, s.id),
    nr AS (SELECT CAST(from_id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id FROM tn_transfer), pw AS (SELECT from_id, to_id, min(seconds) AS path_s, count(*) AS known FROM pe GROUP BY ALL),
    kb AS (SELECT from_id, to_id FROM nr UNION SELECT from_id, to_id FROM ru UNION SELECT from_id, to_id FROM pw WHERE path_s IS NOT NULL),
    bk AS MATERIALIZED (SELECT * FROM (SELECT k.from_id, k.to_id, coalesce(path_s, CASE WHEN n.from_id IS NOT NULL OR min_s IS NOT NULL THEN walk_s END) AS physical_s, coalesce(min_s,0) AS fixed_s, path_s IS NOT NULL AS indoor FROM kb k LEFT JOIN wl USING (from_id, to_id) LEFT JOIN ru USING (from_id, to_id) LEFT JOIN pw USING (from_id, to_id) LEFT JOIN nr n ON n.from_id=k.from_id AND n.to_id=k.to_id
        WHERE NOT coalesce(prohibited,false)) q WHERE physical_s IS NOT NULL)"""


def known_stops(n, rows):
    """Rules and pathways of stops that the network has not got are dropped."""
    ids = n.stop.select(F.col("stop_id").cast("string").alias("id"))
    return rows.join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi")


_KNOWN = "from_id IN (SELECT CAST(stop_id AS VARCHAR) FROM tn_stop) AND to_id IN (SELECT CAST(stop_id AS VARCHAR) FROM tn_stop)"


@query("a07_pair_rules", f"WITH {RULES} SELECT from_id, to_id, min_s, prohibited FROM ru")
def _(n):
    return transfers.parsed_rules(n.view("gt_transfers"))[0]


@query("a07_scoped_rules", f"WITH {RULES} SELECT * FROM sr")
def _(n):
    return transfers.parsed_rules(n.view("gt_transfers"))[1]


@query("a08_pathway_edges", f"WITH {PATHWAYS} SELECT * FROM pe")
def _(n):
    return transfers.pathway_edges(n.view("gt_pathways"))


def bake(n):
    """Written: ways between places of stops over the graph, with whether they are near; the stops of each place; pathways and pair rules of known stops; and scoped rules."""
    return baked(n, ("transfers",), lambda: _bake(n))


def _bake(n):
    paths, snaps, stops = stop_paths(n)
    found = walkgraph.to_targets(paths, snaps, CAP).select(F.col("root").alias("from_at"), F.col("id").alias("to_at"), F.col("sec").alias("walk_s"))
    near = n.footpaths.pairs.select("from_at", "to_at", F.lit(True).alias("near"))
    found = settle(found.join(near, ["from_at", "to_at"], "left").withColumn("near", F.coalesce("near", F.lit(False))), "place-walks")
    ways = settle(known_stops(n, transfers.pathway_edges(n.view("gt_pathways"))), "pathways")
    pair, scoped = transfers.parsed_rules(n.view("gt_transfers"))
    stops = settle(stops.select(F.col("stop_id").cast("string").alias("id"), "at"), "text-stops")
    return found, stops, ways, settle(known_stops(n, pair), "pair-rules"), known_stops(n, scoped)


def ends(stops, c):
    return stops.select(F.col("id").alias(f"{c}_id"), F.col("at").alias(f"{c}_at"))


def of_pairs(n, pairs):
    """The transfers of pairs (from_id, to_id), and their walks."""
    found, stops, ways, pair, _ = bake(n)
    walks = pairs.distinct().join(ends(stops, "from"), "from_id").join(ends(stops, "to"), "to_id").join(found, ["from_at", "to_at"]).where("from_id <> to_id")
    walks = settle(walks.select("from_id", "to_id", "walk_s", "near"), "walks")
    return transfers.baked(walks.drop("near"), walks.where("near").select("from_id", "to_id"), pair, ways), walks.drop("near")


def told(n):
    """Pairs that a rule or a timed pathway speaks of."""
    _, _, ways, pair, _ = bake(n)
    return pair.select("from_id", "to_id").union(ways.where("seconds is not null").select("from_id", "to_id"))


_LIMITED = BAKED.replace("FROM gs WHERE NOT scoped", f"FROM gs WHERE {_KNOWN} AND NOT scoped").replace("FROM gv UNION", f"FROM gv WHERE {_KNOWN} UNION").replace("FROM gv WHERE both", f"FROM gv WHERE {_KNOWN} AND both")


@query("g06_transfers_with_pathways", f"{_LIMITED} SELECT from_id, to_id, physical_s, fixed_s, greatest(physical_s, fixed_s) AS eff_s, indoor FROM bk")
def _(n):
    """Pairs that neither a rule nor a timed pathway speaks of cost their walk, if near; a stop brings the others it has, so such pairs are never dealt out."""
    found, stops, *_ = bake(n)
    some = of_pairs(n, told(n))[0]
    others = told(n).groupBy("from_id").agg(F.collect_set("to_id").alias("told"))
    start = ends(stops, "from").join(others, "from_id", "left")
    rest = found.where("near").join(ends(stops, "to"), "to_at").join(start, "from_at").where("from_id <> to_id and not coalesce(array_contains(told, to_id), false)")
    return some.unionByName(rest.select("from_id", "to_id", F.col("walk_s").alias("physical_s"), F.lit(0).cast("long").alias("fixed_s"), F.col("walk_s").alias("eff_s"), F.lit(False).alias("indoor")))


@query("j18_scoped_enrichment", f"{_LIMITED} SELECT s.*, coalesce(b.physical_s, path_s, CASE WHEN known IS NULL THEN walk_s END) AS physical_s, CASE WHEN b.physical_s IS NOT NULL THEN b.indoor ELSE path_s IS NOT NULL END AS indoor FROM sr s LEFT JOIN bk b USING (from_id, to_id) LEFT JOIN pw USING (from_id, to_id) LEFT JOIN wl USING (from_id, to_id) WHERE {_KNOWN}")
def _(n):
    """Only the pairs that scoped rules name get their transfers and walks."""
    scoped = settle(bake(n)[4], "scoped")
    done, walks = of_pairs(n, told(n).union(scoped.select("from_id", "to_id")))
    return transfers.enriched(scoped, done, walks, bake(n)[2])


@query("g03_drawn_paths", f"""{GRAPH}, ch AS MATERIALIZED (SELECT c.id, d.root, c.node, d.sec+c.conn AS sec FROM gd d JOIN cs c ON c.node=d.node WHERE d.sec+c.conn<={CAP} QUALIFY row_number() OVER (PARTITION BY c.id, d.root ORDER BY d.sec+c.conn, c.node)=1),
    pd AS MATERIALIZED (SELECT b.root, b.node, CASE WHEN s.conn IS NOT NULL AND s.conn<=b.sec THEN NULL ELSE q.pred END AS pred FROM gd b LEFT JOIN ss s ON s.id=b.root AND s.node=b.node LEFT JOIN (SELECT b.root, b.node, min(a.node) AS pred FROM gd b JOIN ge e ON e.dst=b.node JOIN gd a ON a.root=b.root AND a.node=e.src AND a.sec+e.w_s=b.sec GROUP BY b.root, b.node) q ON q.root=b.root AND q.node=b.node),
    wy(root, id, k, node) AS (SELECT root, id, 0, node FROM ch UNION ALL SELECT w.root, w.id, w.k+1, p.pred FROM wy w JOIN pd p ON p.root=w.root AND p.node=w.node WHERE p.pred IS NOT NULL),
    pl AS (SELECT w.root, w.id, -k AS k, concat(x_m,' ',y_m) AS p FROM wy w JOIN wg_node n ON n.node_id=w.node UNION ALL SELECT root, id, -1000000, concat(x_m,' ',y_m) FROM ch JOIN tn_stop s ON s.stop_id=root UNION ALL SELECT root, id, 1, concat(x_m,' ',y_m) FROM ch JOIN tn_cell c ON c.cell_id=id),
    pp AS (SELECT *, lag(p) OVER (PARTITION BY root, id ORDER BY k) AS was FROM pl) SELECT root AS stop_id, id AS cell_id, any_value(c.sec) AS walk_s, string_agg(p, ',' ORDER BY k) FILTER (was IS NULL OR was<>p) AS points FROM pp JOIN ch c USING (root, id) GROUP BY root, id""")
def _(n):
    """Drawn once for each pair of places."""
    paths, snaps, stops = stop_paths(n)
    paths, cells = settle(paths, "stop-paths"), settle(spatial.placed(n.cell, "cell_id"), "cells")
    roots = snaps.select(F.col("id").alias("root"), "node", F.col("conn_s").alias("sec"))
    chosen = settle(walkgraph.to_targets(paths, snapped(n, cells.where("cell_id = at"), "cell_id"), CAP), "chosen")
    ways = walkgraph.node_paths(walkgraph.path_tree(edges(n), paths, roots))
    ways = chosen.join(ways, ["root", "node"]).select("root", "id", "sec", "path")
    out = walkgraph.drawn(ways, n.view("wg_node"), n.stop.withColumnRenamed("stop_id", "root"), n.cell.withColumnRenamed("cell_id", "id"))
    out = out.join(stops.withColumnRenamed("at", "root"), "root").join(cells.select("cell_id", F.col("at").alias("id")), "id")
    return out.select("stop_id", "cell_id", F.col("sec").alias("walk_s"), "points")
