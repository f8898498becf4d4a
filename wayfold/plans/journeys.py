"""Queries of journeys, route options and reliability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.operators import assemble, choice, journeys, reliability, search, spatial, walkgraph
from wayfold.plans.base import query
from wayfold.plans.search import ROUNDS, search_sql
from wayfold.sources.network import DRAWS

CLOCK = """WITH c AS (SELECT *, sum(dur_s) OVER (PARTITION BY journey ORDER BY leg)-dur_s AS before, first_value(dep_s) OVER (PARTITION BY journey ORDER BY leg) AS d0 FROM ch_leg),
    m AS (SELECT *, greatest(d0, max(CASE WHEN kind='ride' THEN dep_s-before END) OVER (PARTITION BY journey ORDER BY leg)) AS base, coalesce(greatest(d0, max(CASE WHEN kind='ride' THEN dep_s-before END) OVER (PARTITION BY journey ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), d0) AS prior FROM c)
    SELECT journey, leg, CAST(coalesce(base,d0)-prior AS BIGINT) AS wait_s, CAST(coalesce(base,d0)+before+dur_s AS BIGINT) AS arr_s FROM m"""


@query("k04_clock", CLOCK)
def _(n):
    return journeys.clocked(n.view("ch_leg"))


@query("p09_boardable", """WITH c AS (SELECT *, coalesce(sum(CASE WHEN kind='walk' THEN dur_s END) OVER (PARTITION BY journey ORDER BY leg),0) AS wc, first_value(dep_s) OVER (PARTITION BY journey ORDER BY leg) AS d0 FROM ch_leg),
    p AS (SELECT *, coalesce(last_value(CASE WHEN kind='ride' THEN dep_s+dur_s-wc END IGNORE NULLS) OVER (PARTITION BY journey ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d0)+wc AS clock FROM c) SELECT journey, bool_and(kind='walk' OR dep_s>=clock) AS ok FROM p GROUP BY journey""")
def _(n):
    return journeys.boardable(n.view("ch_leg"))


@query("k03_best_alight", """SELECT pattern_id, trip_id, pos, CAST(arr_s+walk_s AS BIGINT) AS finish_s FROM tn_stop_time JOIN tn_egress USING (stop_id) WHERE pos>0 QUALIFY row_number() OVER (PARTITION BY pattern_id, trip_id ORDER BY arr_s+walk_s, walk_s, pos DESC)=1""")
def _(n):
    return journeys.best_alight(n.trip.select("pattern_id", "trip_id", F.lit(0).cast("long").alias("bpos")), n.stop_time, n.egress)


@query("k10_committed_leg", "SELECT journey, leg, line_id, dep_s FROM ch_leg WHERE kind='ride' QUALIFY row_number() OVER (PARTITION BY journey ORDER BY leg)=1")
def _(n):
    first = F.min(F.struct("leg", "line_id", "dep_s")).alias("x")
    return n.view("ch_leg").where("kind='ride'").groupBy("journey").agg(first).select("journey", "x.leg", "x.line_id", "x.dep_s")


@query("n06_leg_metrics", """SELECT journey, CAST(coalesce(max(CASE WHEN leg=1 AND kind='walk' THEN dur_s END),0) AS BIGINT) AS access_s, CAST(coalesce(max(CASE WHEN leg=n AND kind='walk' THEN dur_s END),0) AS BIGINT) AS final_s,
    CAST(coalesce(sum(CASE WHEN kind='walk' THEN dur_s END),0) AS BIGINT) AS walk_s, count(*) FILTER (kind='ride') AS rides, CAST(greatest(count(*) FILTER (kind='ride')-1,0) AS BIGINT) AS transfers, CAST(sum(dur_s) AS BIGINT) AS total_s
    FROM (SELECT *, max(leg) OVER (PARTITION BY journey) AS n FROM ch_leg) t GROUP BY journey""")
def _(n):
    return journeys.leg_metrics(n.view("ch_leg"))


@query("k17_route_identity", "SELECT journey, coalesce(string_agg(CASE WHEN kind='ride' THEN CAST(line_id AS VARCHAR) END, '>' ORDER BY leg),'walk') AS identity FROM ch_leg GROUP BY journey")
def _(n):
    rows = n.view("ch_leg").groupBy("journey").agg(F.sort_array(F.collect_list(F.struct("leg", "kind", "line_id"))).alias("x"))
    rides = F.transform(F.filter("x", lambda x: x["kind"] == "ride"), lambda x: x["line_id"].cast("string"))
    return rows.select("journey", F.when(F.size(rides) == 0, "walk").otherwise(F.array_join(rides, ">")).alias("identity"))


ORDER, PLANNED = ", ".join(choice.RANK), ", ".join(choice.PLANNED_RANK)
NO_WORSE = " AND ".join(f"b.{c}<=a.{c}" for c in choice.CRITERIA)
BETTER = " OR ".join(f"b.{c}<a.{c}" for c in choice.CRITERIA)


@query("t01_quality_rank", f"SELECT cell_id, option_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY {ORDER}) AS BIGINT) AS rank FROM ch_option")
def _(n):
    return choice.ranked(n.view("ch_option")).select("cell_id", "option_id", "rank")


def _best(metric: str) -> str:
    order = ", ".join([metric, *choice.RECOMMENDATION])
    return f"first_value(option_id) OVER (PARTITION BY cell_id ORDER BY {order})"


@query("t02_recommendation", f"SELECT DISTINCT cell_id, {_best('minutes+frag_min')} AS typical, {_best('minutes')} AS best FROM ch_option")
def _(n):
    return choice.recommended(n.view("ch_option"))


@query("t03_planned_rank", f"SELECT cell_id, family, option_id FROM ch_option QUALIFY row_number() OVER (PARTITION BY cell_id, family ORDER BY {PLANNED})=1")
def _(n):
    return n.view("ch_option").groupBy("cell_id", "family").agg(F.min_by("option_id", F.struct(*choice.PLANNED_RANK)).alias("option_id"))


@query("t04_pareto", f"SELECT cell_id, option_id FROM ch_option a WHERE NOT EXISTS (SELECT 1 FROM ch_option b WHERE a.cell_id=b.cell_id AND a.family=b.family AND a.branch=b.branch AND {NO_WORSE} AND ({BETTER}))")
def _(n):
    return choice.pareto(n.view("ch_option")).select("cell_id", "option_id")


@query("t06_diverse_options")
def _(n):
    return choice.diverse(n.view("ch_option"))


@query("n03_families")
def _(n):
    return choice.families(n.view("ch_option"))


@query("t07_chips", "SELECT cell_id, line_id, minutes, CAST(k-1 AS BIGINT) AS chip FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY minutes, line_id) AS k FROM (SELECT cell_id, line_id, min(minutes) AS minutes FROM ch_option GROUP BY ALL) l) t WHERE k BETWEEN 2 AND 7")
def _(n):
    return choice.chips(n.view("ch_option"))


@query("t09_family_name", """SELECT cell_id, family, concat(string_agg(CASE WHEN k<=3 THEN concat('L',CAST(line_id AS VARCHAR)) END,' / ' ORDER BY k), CASE WHEN max(k)>3 THEN concat(' +',CAST(max(k)-3 AS VARCHAR)) ELSE '' END) AS name
    FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, family ORDER BY m, line_id) AS k FROM (SELECT cell_id, family, line_id, min(minutes) AS m FROM ch_option GROUP BY ALL) l) t GROUP BY cell_id, family""")
def _(n):
    return choice.family_names(n.view("ch_option"))


@query("a14_best_per_line", "SELECT cell_id, line_id, min(minutes) AS minutes, arg_min(option_id, minutes*1000+option_id) AS option_id FROM ch_option GROUP BY cell_id, line_id")
def _(n):
    return n.view("ch_option").groupBy("cell_id", "line_id").agg(F.min(F.struct("minutes", "option_id")).alias("x")).select("cell_id", "line_id", "x.minutes", "x.option_id")


@query("a15_best_route_then_label", """SELECT cell_id, line_id, option_id FROM (SELECT * FROM ch_option QUALIFY row_number() OVER (PARTITION BY cell_id, line_id, transfers ORDER BY minutes, option_id)=1) r QUALIFY row_number() OVER (PARTITION BY cell_id, line_id ORDER BY minutes, transfers, option_id)=1""")
def _(n):
    one = Window.partitionBy("cell_id", "line_id", "transfers").orderBy("minutes", "option_id")
    two = Window.partitionBy("cell_id", "line_id").orderBy("minutes", "transfers", "option_id")
    best = n.view("ch_option").withColumn("k", F.row_number().over(one)).where("k=1")
    return best.withColumn("k", F.row_number().over(two)).where("k=1").select("cell_id", "line_id", "option_id")


@query("p10_eps_window", "SELECT cell_id, option_id FROM (SELECT *, min(minutes) OVER (PARTITION BY cell_id) AS lo FROM ch_option) t WHERE minutes<=lo+5")
def _(n):
    return n.view("ch_option").withColumn("lo", F.min("minutes").over(Window.partitionBy("cell_id"))).where("minutes <= lo + 5").select("cell_id", "option_id")


@query("p11_alternatives_window", "SELECT cell_id, option_id, minutes-lo AS extra FROM (SELECT *, min(minutes) OVER (PARTITION BY cell_id) AS lo FROM ch_option) t WHERE minutes<=lo+10 AND minutes<75 AND minutes>lo")
def _(n):
    lo = n.view("ch_option").withColumn("lo", F.min("minutes").over(Window.partitionBy("cell_id")))
    return lo.where("minutes <= lo + 10 and minutes < 75 and minutes > lo").select("cell_id", "option_id", (F.col("minutes") - F.col("lo")).alias("extra"))


@query("n01_service_key", "SELECT pattern_id, concat(feed,'/',mode,'/',line_name) AS service FROM tn_line")
def _(n):
    return n.line.select("pattern_id", F.concat_ws("/", "feed", "mode", "line_name").alias("service"))


@query("n04_branch_key", "SELECT cell_id, option_id, CASE WHEN transfers=0 AND minutes<5 THEN 'walk:only' WHEN transfers=0 THEN concat('walk:',CAST(final_walk AS VARCHAR)) ELSE concat('tail:',CAST(branch AS VARCHAR)) END AS branch_key FROM ch_option")
def _(n):
    key = F.when((F.col("transfers") == 0) & (F.col("minutes") < 5), "walk:only").when(F.col("transfers") == 0, F.concat(F.lit("walk:"), F.col("final_walk").cast("string"))).otherwise(F.concat(F.lit("tail:"), F.col("branch").cast("string")))
    return n.view("ch_option").select("cell_id", "option_id", key.alias("branch_key"))


@query("n11_primary_minimum", "SELECT count(*) AS violations FROM ch_option o JOIN (SELECT cell_id, minutes AS primary_min FROM ch_option QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY minutes, option_id)=1) p ON o.cell_id=p.cell_id WHERE o.minutes<p.primary_min")
def _(n):
    best = choice.ranked(n.view("ch_option")).where("rank = 1").select("cell_id", F.col("minutes").alias("primary_min"))
    return n.view("ch_option").join(best, "cell_id").where("minutes < primary_min").agg(F.count(F.lit(1)).alias("violations"))


# the walking graph

EDGES = """SELECT src, dst, CAST(min(floor(len/(4.8/3.6)*exp(3.5*(abs(greatest(-0.5,least(0.5,(dz-sz)/len))+0.05)-0.05))*CASE WHEN stairs THEN 2.5 ELSE 1.0 END+0.5)) AS BIGINT) AS w_s FROM (
    SELECT e.src, e.dst, e.stairs, a.elev_m AS sz, b.elev_m AS dz, CAST(greatest(abs(a.x_m-b.x_m)+abs(a.y_m-b.y_m),1) AS DOUBLE) AS len FROM (
      SELECT highway='steps' AS stairs, unnest([a,b,b,c]) AS src, unnest([b,c,a,b]) AS dst FROM wg_way WHERE (highway IN ('residential','footway','steps') OR (highway='cycleway' AND foot='yes')) AND coalesce(foot,'')<>'no' AND (coalesce(access,'')<>'private' OR coalesce(foot,'')='yes')) e
    JOIN wg_node a ON a.node_id=e.src JOIN wg_node b ON b.node_id=e.dst) t GROUP BY src, dst"""


def edges(n):
    return walkgraph.edges_of(n.view("wg_way"), n.view("wg_node"))


@query("f12_edge_costs", EDGES)
def _(n):
    return edges(n)


@query("g02_reverse_edges", f"SELECT dst AS src, src AS dst, w_s FROM ({EDGES}) e")
def _(n):
    return walkgraph.reverse(edges(n))


@query("g01_bounded_paths", f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES}), p(root, node, sec) AS (SELECT node_id, node_id, CAST(0 AS BIGINT) FROM wg_node UNION SELECT p.root, e.dst, p.sec+e.w_s FROM p JOIN e ON e.src=p.node WHERE p.sec+e.w_s<=3600)
    SELECT root, node, min(sec) AS sec FROM p GROUP BY root, node""")
def _(n):
    roots = n.view("wg_node").select(F.col("node_id").alias("root"), F.col("node_id").alias("node"), F.lit(0).cast("long").alias("sec"))
    return walkgraph.shortest(edges(n), roots, 3600)


REACH = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM ({EDGES}) x UNION SELECT dst, src FROM ({EDGES}) y), r(node, seen) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, r.seen FROM r JOIN e ON e.src=r.node), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)"""


@query("a06_components", f"{REACH} SELECT node, component FROM c")
def _(n):
    return walkgraph.components(edges(n))


@query("g05_giant_component", f"{REACH} SELECT node FROM c WHERE component=(SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)")
def _(n):
    every = walkgraph.components(edges(n))
    best = every.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).orderBy(F.desc("nodes"), "component").limit(1)
    return every.join(best, "component", "left_semi").select("node")


@query("p06_supported_area", f"""WITH w AS MATERIALIZED (SELECT * FROM wg_node WHERE node_id IN (SELECT src FROM ({EDGES}) e)) SELECT s.stop_id, count(n.node_id)>0 AS supported FROM tn_stop s LEFT JOIN w n ON (s.x_m-n.x_m)*(s.x_m-n.x_m)+(s.y_m-n.y_m)*(s.y_m-n.y_m)<=90000 GROUP BY s.stop_id""")
def _(n):
    walked = n.view("wg_node").join(edges(n).select(F.col("src").alias("node_id")), "node_id", "left_semi")
    near = spatial.euclid_join(n.stop, walked, 300, "stop_id", "node_id", ("stop_id", "node_id")).select("stop_id").distinct().withColumn("hit", F.lit(True))
    return n.stop.select("stop_id").join(near, "stop_id", "left").select("stop_id", F.coalesce("hit", F.lit(False)).alias("supported"))


# reliability

CHAINS = "SELECT pattern_id, trip_id, run_s AS chain, row_number() OVER (PARTITION BY pattern_id, run_s ORDER BY start_s, trip_id) AS rank FROM tn_trip"
DELAYED = f"""SELECT draw_id, pattern_id, trip_id, pos, stop_id, CAST(max(a) OVER w AS BIGINT) AS arr_s, CAST(max(d) OVER w AS BIGINT) AS dep_s FROM (
    SELECT m.draw_id, s.*, c.chain, c.rank, arr_s+CAST(floor(delta0+slope*el+1e-9) AS BIGINT) AS a, dep_s+CAST(floor(delta0+slope*el+1e-9) AS BIGINT) AS d
    FROM (SELECT *, dep_s-first_value(dep_s) OVER (PARTITION BY pattern_id, trip_id ORDER BY pos) AS el FROM tn_stop_time) s JOIN mc_draw m ON m.pattern_id=s.pattern_id AND m.trip_id=s.trip_id JOIN ({CHAINS}) c ON c.pattern_id=s.pattern_id AND c.trip_id=s.trip_id) t
    WINDOW w AS (PARTITION BY draw_id, pattern_id, chain, pos ORDER BY rank ROWS UNBOUNDED PRECEDING)"""
LATE = search.grid(31800, 34200, 600)
SEED = f"SELECT x.draw_id, d AS deadline_s, stop_id, d-walk_s AS v FROM tn_egress, (SELECT unnest({LATE!r}) AS d) g, (SELECT unnest(range({DRAWS})) AS draw_id) x"
DRAWN = f"WITH dl AS MATERIALIZED ({DELAYED}), {search_sql(SEED, 'draw_id, deadline_s', ROUNDS, 'dl', 'draw_id')}, mp AS MATERIALIZED (SELECT draw_id, deadline_s, stop_id, max(v) OVER (PARTITION BY draw_id, stop_id ORDER BY deadline_s ROWS UNBOUNDED PRECEDING) AS latest_s FROM b{ROUNDS})"
SCORED = """cm AS (SELECT a.cell_id, 28800 AS home_s, a.walk_s, p.pattern_id, p.pos AS bpos, p.pos+2 AS apos FROM tn_access a JOIN tn_pattern_stop p ON p.stop_id=a.stop_id WHERE p.pos<=5 QUALIFY row_number() OVER (PARTITION BY a.cell_id ORDER BY a.walk_s, a.stop_id, p.pattern_id)=1),
    nx AS MATERIALIZED (SELECT t.draw_id, c.cell_id, c.home_s, c.pattern_id, c.apos, t.trip_id FROM cm c JOIN dl t ON t.pattern_id=c.pattern_id AND t.pos=c.bpos AND t.dep_s>=c.home_s+c.walk_s QUALIFY row_number() OVER (PARTITION BY t.draw_id, c.cell_id ORDER BY t.dep_s, t.trip_id)=1),
    av AS MATERIALIZED (SELECT nx.draw_id, nx.cell_id, nx.home_s, t.stop_id, t.arr_s FROM nx JOIN dl t ON t.draw_id=nx.draw_id AND t.pattern_id=nx.pattern_id AND t.trip_id=nx.trip_id AND t.pos=nx.apos),
    sc AS (SELECT av.draw_id, av.cell_id, coalesce(least(greatest((min(CASE WHEN latest_s>=arr_s+60 THEN deadline_s END)-any_value(home_s))/60.0,0.0),75.0),75.0) AS minutes FROM av LEFT JOIN mp ON mp.draw_id=av.draw_id AND mp.stop_id=av.stop_id GROUP BY av.draw_id, av.cell_id)"""


def chains(n):
    w = Window.partitionBy("pattern_id", "run_s").orderBy("start_s", "trip_id")
    return n.trip.select("pattern_id", "trip_id", F.col("run_s").alias("chain"), F.row_number().over(w).alias("rank"))


def late_times(n):
    return reliability.delayed(n.stop_time, n.view("mc_draw"), chains(n))


def late_profile(n, times):
    start = search.seed(n.egress, LATE).withColumn("draw_id", F.explode(F.array(*(F.lit(d).cast("long") for d in range(DRAWS)))))
    found = search.reverse_search(search.lanes(times, chains(n), ("draw_id",)), n.transfer, start, ("draw_id", "deadline_s"), time_keys=("draw_id",))
    return search.monotone(found, ("draw_id",))


def commits(n):
    rows = n.access.join(n.pattern_stop.where("pos <= 5"), "stop_id")
    best = rows.groupBy("cell_id").agg(F.min(F.struct("walk_s", "stop_id", "pattern_id", "pos")).alias("x"))
    return best.select("cell_id", F.lit(28800).cast("long").alias("home_s"), "x.walk_s", "x.pattern_id", F.col("x.pos").alias("bpos"), (F.col("x.pos") + 2).alias("apos"))


def scores(n):
    from wayfold.operators.rounds import settle

    times = settle(late_times(n), "delayed")
    return reliability.scored(reliability.next_committed(commits(n), times), late_profile(n, times))


@query("m01_delay_draws", "SELECT pattern_id, trip_id, draw_id, delta0, slope FROM mc_draw")
def _(n):
    return n.view("mc_draw").select("pattern_id", "trip_id", "draw_id", "delta0", "slope")


@query("m02_delayed_times", DELAYED)
def _(n):
    return late_times(n)


@query("m03_profile_per_draw", f"{DRAWN} SELECT CAST(draw_id AS BIGINT) AS draw_id, CAST(deadline_s AS BIGINT) AS deadline_s, stop_id, CAST(latest_s AS BIGINT) AS latest_s FROM mp")
def _(n):
    return late_profile(n, late_times(n)).select("draw_id", "deadline_s", "stop_id", "latest_s")


@query("m04_committed_scores", f"{DRAWN}, {SCORED} SELECT CAST(draw_id AS BIGINT) AS draw_id, cell_id, CAST(round(minutes,6) AS DOUBLE) AS minutes FROM sc")
def _(n):
    return scores(n).select("draw_id", "cell_id", F.round("minutes", 6).alias("minutes"))


@query("m07_summary", f"""{DRAWN}, {SCORED} SELECT cell_id, CAST(round(quantile_cont(m,0.5),4) AS DOUBLE) AS p50, CAST(round(quantile_cont(m,0.5),4) AS DOUBLE) AS p50_floored, CAST(round(quantile_cont(m,0.9),4) AS DOUBLE) AS p90, CAST(round(greatest(quantile_cont(m,0.9)-quantile_cont(m,0.5),0),4) AS DOUBLE) AS frag,
    CAST(round(stddev_pop(m),4) AS DOUBLE) AS spread, CAST(round(avg(CASE WHEN m>=75 THEN 1.0 ELSE 0.0 END),6) AS DOUBLE) AS stuck FROM (SELECT cell_id, CAST(minutes AS DOUBLE) AS m FROM sc) t GROUP BY cell_id""")
def _(n):
    return reliability.summary(scores(n), ["cell_id"])
