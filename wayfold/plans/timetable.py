"""Queries over feed tables, stop times and windows over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions import feeds
from wayfold.operators import ranks, timetable
from wayfold.plans.base import query
from wayfold.plans.columns import SEC

DAY = "20240306"
ACTIVE = f"""SELECT DISTINCT service_id FROM (SELECT service_id FROM gt_calendar WHERE wednesday='1' AND start_date<='{DAY}' AND end_date>='{DAY}'
    UNION SELECT service_id FROM gt_calendar_dates WHERE date='{DAY}' AND exception_type='1') b
    WHERE service_id NOT IN (SELECT service_id FROM gt_calendar_dates WHERE date='{DAY}' AND exception_type='2')"""
CLEAN = f"""SELECT route_id, trip_id, try_cast(stop_sequence AS BIGINT) AS seq, stop_id, coalesce({SEC.format('arrival_time')},{SEC.format('departure_time')}) AS arr_s, coalesce({SEC.format('departure_time')},{SEC.format('arrival_time')}) AS dep_s FROM gt_stop_times"""
CLEAN = f"SELECT * FROM ({CLEAN}) c QUALIFY NOT bool_or(arr_s IS NULL) OVER (PARTITION BY trip_id)"


def active(n):
    return timetable.active_services(n.view("gt_calendar"), n.view("gt_calendar_dates"), DAY, "wednesday")


@query("p01_active_services", ACTIVE)
def _(n):
    return active(n)


@query("p02_active_trips", f"SELECT trip_id, route_id FROM gt_trips WHERE service_id IN ({ACTIVE})")
def _(n):
    return n.view("gt_trips").join(active(n), "service_id", "left_semi").select("trip_id", "route_id")


@query("p03_complete_trips", CLEAN)
def _(n):
    return timetable.clean_times(n.view("gt_stop_times")).select("route_id", "trip_id", "seq", "stop_id", "arr_s", "dep_s")


@query("p04_band_trips", """SELECT pattern_id, trip_id FROM tn_stop_time GROUP BY pattern_id, trip_id HAVING arg_min(dep_s,pos)<=30600 AND arg_max(arr_s,pos)>=28800""")
def _(n):
    return timetable.in_band(n.stop_time, 28800, 30600, ["pattern_id", "trip_id"])


@query("s02_feed_scan", "SELECT route_id, count(*) AS n_rows, count(DISTINCT trip_id) AS trips, count(*) FILTER (trim(arrival_time)='') AS blank FROM gt_stop_times GROUP BY route_id")
def _(n):
    blank = F.trim("arrival_time") == ""
    return n.view("gt_stop_times").groupBy("route_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("trip_id").alias("trips"), F.count(F.when(blank, 1)).alias("blank"))


@query("s03_stream_validate", f"""SELECT count(*) AS n_rows, count(*) FILTER (trim(arrival_time)='' AND trim(departure_time)='') AS no_time, count(*) FILTER ({SEC.format('departure_time')} IS NULL AND trim(departure_time)<>'') AS bad_time,
    count(*) FILTER (stop_id IS NULL) AS no_stop FROM gt_stop_times""")
def _(n):
    blank = lambda c: F.trim(c) == ""
    bad = feeds.seconds(F.col("departure_time")).isNull() & ~blank("departure_time")
    return n.view("gt_stop_times").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(blank("arrival_time") & blank("departure_time"), 1)).alias("no_time"),
        F.count(F.when(bad, 1)).alias("bad_time"), F.count(F.when(F.col("stop_id").isNull(), 1)).alias("no_stop"),
    )


@query("s15_route_shapes", """WITH n AS (SELECT route_id, shape_id, count(*) AS points FROM gt_shapes GROUP BY ALL),
    b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY points DESC, shape_id)=1)
    SELECT route_id, shape_id, points, string_agg(concat(CAST(x_m AS VARCHAR),' ',CAST(y_m AS VARCHAR)), ',' ORDER BY seq, x_m, y_m) AS line FROM gt_shapes JOIN b USING (route_id, shape_id) GROUP BY ALL""")
def _(n):
    return timetable.route_shapes(n.view("gt_shapes"))


@query("s16_origins_json", "SELECT cell_id, concat('{\"id\":',CAST(cell_id AS VARCHAR),',\"x\":',CAST(x_m AS VARCHAR),',\"y\":',CAST(y_m AS VARCHAR),'}') AS json FROM tn_cell")
def _(n):
    return n.cell.select("cell_id", F.to_json(F.struct(F.col("cell_id").alias("id"), F.col("x_m").alias("x"), F.col("y_m").alias("y"))).alias("json"))


@query("s17_hood_csv", """SELECT hood, concat('"', replace(n_name,'"','""'), '",', CAST(CAST(ceil(min(walk)/60.0) AS BIGINT) AS VARCHAR)) AS line FROM (SELECT hood, abs(x_m-3000)+abs(y_m-3000) AS walk FROM tn_cell) c
    JOIN nation ON n_nationkey=hood GROUP BY hood, n_name HAVING min(walk)<4500""")
def _(n):
    walk = F.abs(F.col("x_m") - 3000) + F.abs(F.col("y_m") - 3000)
    best = n.cell.groupBy("hood").agg(F.min(walk).alias("walk")).where("walk < 4500")
    names = n.table("nation").select(F.col("n_nationkey").cast("long").alias("hood"), "n_name")
    quoted = F.concat(F.lit('"'), F.replace("n_name", F.lit('"'), F.lit('""')), F.lit('",'), F.ceil(F.col("walk") / 60).cast("string"))
    return best.join(names, "hood").select("hood", quoted.alias("line"))


@query("j01_dimension_lookup", "SELECT s.pattern_id, s.trip_id, s.pos, l.line_name, l.mode, p.x_m FROM tn_stop_time s LEFT JOIN tn_line l ON s.pattern_id=l.pattern_id LEFT JOIN tn_stop p ON s.stop_id=p.stop_id")
def _(n):
    return n.stop_time.join(n.line, "pattern_id", "left").join(n.stop, "stop_id", "left").select("pattern_id", "trip_id", "pos", "line_name", "mode", "x_m")


@query("a01_stop_patterns", f"""SELECT route_id, stops, count(*) AS trips FROM (SELECT route_id, trip_id, string_agg(stop_id,'>' ORDER BY seq, stop_id) AS stops FROM ({CLEAN}) c GROUP BY ALL) t GROUP BY ALL""")
def _(n):
    return timetable.stop_patterns(timetable.clean_times(n.view("gt_stop_times")))


@query("a02_fifo_split")
def _(n):
    return timetable.fifo_chains(n.stop_time)


@query("a03_feed_counts", "SELECT feed, count(DISTINCT trip_id) AS trips, count(*) AS stop_rows FROM tn_stop_time JOIN tn_line USING (pattern_id) GROUP BY feed")
def _(n):
    return n.stop_time.join(n.line, "pattern_id").groupBy("feed").agg(F.countDistinct("trip_id").alias("trips"), F.count(F.lit(1)).alias("stop_rows"))


@query("a04_csr_offsets", "SELECT pattern_id, n_stops, CAST(sum(n_stops) OVER (ORDER BY pattern_id)-n_stops AS BIGINT) AS off FROM (SELECT pattern_id, count(*) AS n_stops FROM tn_pattern_stop GROUP BY pattern_id) t")
def _(n):
    per = n.pattern_stop.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_stops"))
    out = ranks.with_running(per, [F.col("pattern_id")], {"upto": F.col("n_stops")}, "csr")
    return out.select("pattern_id", "n_stops", (F.col("upto") - F.col("n_stops")).cast("long").alias("off"))


@query("a07_rule_dedupe", """SELECT from_id, to_id, bool_or(transfer_type='3') AS prohibited, CAST(max(CASE WHEN transfer_type='2' AND try_cast(min_transfer_time AS BIGINT)>=0 THEN CAST(try_cast(min_transfer_time AS BIGINT) AS BIGINT) END) AS BIGINT) AS min_s
    FROM gt_transfer_rules GROUP BY from_id, to_id""")
def _(n):
    least = F.when(F.col("transfer_type") == "2", feeds.tolerant_count(F.col("min_transfer_time")))
    return n.view("gt_transfer_rules").groupBy("from_id", "to_id").agg(F.bool_or(F.col("transfer_type") == "3").alias("prohibited"), F.max(least).alias("min_s"))


@query("a08_pathway_dedupe", "SELECT from_id, to_id, CAST(min(t*10+m)//10 AS BIGINT) AS traversal_s, CAST(min(t*10+m)%10 AS BIGINT) AS mode FROM (SELECT l_partkey%400 AS from_id, l_suppkey AS to_id, (l_orderkey*17)%240 AS t, l_linenumber AS m FROM lineitem) p GROUP BY from_id, to_id")
def _(n):
    p = n.table("lineitem").select((F.col("l_partkey") % 400).alias("from_id"), F.col("l_suppkey").alias("to_id"), (F.col("l_orderkey") * 17 % 240).alias("t"), F.col("l_linenumber").cast("long").alias("m"))
    return p.groupBy("from_id", "to_id").agg(F.min(F.struct("t", "m")).alias("x")).select("from_id", "to_id", F.col("x.t").alias("traversal_s"), F.col("x.m").alias("mode"))


@query("a10_best_label", "SELECT stop_id, max(dep_s) AS best FROM tn_stop_time WHERE arr_s<=32340 GROUP BY stop_id")
def _(n):
    return n.stop_time.where("arr_s <= 32340").groupBy("stop_id").agg(F.max("dep_s").alias("best"))


@query("a11_percentile_lower", """SELECT pattern_id, v[CAST(floor((len(v)-1)*5/100.0) AS INT)+1] AS p5, v[CAST(floor((len(v)-1)*50/100.0) AS INT)+1] AS p50, v[CAST(floor((len(v)-1)*95/100.0) AS INT)+1] AS p95
    FROM (SELECT pattern_id, list_sort(list(dep_s)) AS v FROM tn_stop_time GROUP BY pattern_id) t""")
def _(n):
    from wayfold.operators.search import percentile_lower

    return n.stop_time.groupBy("pattern_id").agg(*(percentile_lower("dep_s", p).alias(f"p{p}") for p in (5, 50, 95)))


@query("a12_percentile_linear", "SELECT pattern_id, CAST(round(quantile_cont(dep_s, 0.9),6) AS DOUBLE) AS p90, CAST(round(quantile_cont(dep_s, 0.5),6) AS DOUBLE) AS p50 FROM tn_stop_time GROUP BY pattern_id")
def _(n):
    return n.stop_time.groupBy("pattern_id").agg(F.round(F.percentile("dep_s", 0.9), 6).alias("p90"), F.round(F.percentile("dep_s", 0.5), 6).alias("p50"))


@query("a13_delay_summary", """SELECT pattern_id, CAST(round(quantile_cont(x,0.5),4) AS DOUBLE) AS p50, CAST(round(greatest(quantile_cont(x,0.5),30.0),4) AS DOUBLE) AS p50_floored, CAST(round(greatest(quantile_cont(x,0.9)-quantile_cont(x,0.5),0),4) AS DOUBLE) AS frag,
    CAST(round(stddev_pop(x),4) AS DOUBLE) AS spread, CAST(round(avg(CASE WHEN x>=75 THEN 1.0 ELSE 0.0 END),6) AS DOUBLE) AS stuck FROM (SELECT pattern_id, CAST(dep_s%97 AS DOUBLE) AS x FROM tn_stop_time) t GROUP BY pattern_id""")
def _(n):
    x = (F.col("dep_s") % 97).cast("double")
    p50, p90 = F.percentile(x, 0.5), F.percentile(x, 0.9)
    return n.stop_time.groupBy("pattern_id").agg(
        F.round(p50, 4).alias("p50"), F.round(F.greatest(p50, F.lit(30.0)), 4).alias("p50_floored"), F.round(F.greatest(p90 - p50, F.lit(0.0)), 4).alias("frag"),
        F.round(F.stddev_pop(x), 4).alias("spread"), F.round(F.avg(F.when(x >= 75, 1.0).otherwise(0.0)), 6).alias("stuck"),
    )


@query("a16_dominant_line", "SELECT o_orderkey, arg_max(line, len*1000-line) AS line FROM (SELECT l_orderkey AS o_orderkey, l_suppkey%50 AS line, CAST(l_quantity AS BIGINT) AS len FROM lineitem) t GROUP BY o_orderkey")
def _(n):
    rows = n.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 50).alias("line"), F.col("l_quantity").cast("long").alias("len"))
    return rows.groupBy("o_orderkey").agg(F.max_by("line", F.struct("len", -F.col("line"))).alias("line"))


@query("a19_family_catalog", "SELECT line_id, mode, string_agg(DISTINCT CAST(stop_id AS VARCHAR), ',' ORDER BY CAST(stop_id AS VARCHAR)) AS tails FROM tn_line JOIN tn_pattern_stop USING (pattern_id) WHERE pos=7 GROUP BY line_id, mode")
def _(n):
    tails = n.line.join(n.pattern_stop.where("pos = 7"), "pattern_id")
    return tails.groupBy("line_id", "mode").agg(F.array_join(F.array_sort(F.collect_set(F.col("stop_id").cast("string"))), ",").alias("tails"))


@query("a20_hood_rollup", "SELECT hood, CAST(min(w) AS BIGINT) AS best, CAST(round(avg(w),4) AS DOUBLE) AS mean, count(*) AS cells FROM (SELECT hood, abs(x_m-3000)+abs(y_m-3000) AS w FROM tn_cell) t GROUP BY hood")
def _(n):
    w = F.abs(F.col("x_m") - 3000) + F.abs(F.col("y_m") - 3000)
    return n.cell.groupBy("hood").agg(F.min(w).cast("long").alias("best"), F.round(F.avg(w), 4).alias("mean"), F.count(F.lit(1)).alias("cells"))


@query("a21_distribution", """SELECT event_type, count(*) AS n, CAST(round(min(value),6) AS DOUBLE) AS lo, CAST(round(quantile_cont(value,0.5),6) AS DOUBLE) AS p50, CAST(round(quantile_cont(value,0.9),6) AS DOUBLE) AS p90,
    CAST(round(quantile_cont(value,0.95),6) AS DOUBLE) AS p95, CAST(round(max(value),6) AS DOUBLE) AS hi, CAST(round(avg(value),4) AS DOUBLE) AS mean, CAST(round(stddev_pop(value),4) AS DOUBLE) AS sd FROM events GROUP BY event_type""")
def _(n):
    rows = n.table("events").select("event_type", "value")
    shape = rows.groupBy("event_type").agg(F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("sd"), F.count(F.lit(1)).alias("n"))
    found = ranks.percentiles(rows, "event_type", "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    return shape.join(found, "event_type").select("event_type", "n", "lo", *(F.round(p, 6).alias(p) for p in ("p50", "p90", "p95")), "hi", "mean", "sd")


@query("a22_service_date", """WITH d AS (SELECT CAST(s_suppkey%4 AS BIGINT) AS feed, CAST(o_orderdate AS DATE) AS day FROM (SELECT o_orderdate, o_custkey AS s_suppkey FROM orders) t WHERE extract(isodow from o_orderdate)=3),
    lo AS (SELECT max(s)+INTERVAL 7 DAY AS s FROM (SELECT feed, min(day) AS s FROM d GROUP BY feed) f)
    SELECT CAST(min(day) AS VARCHAR) AS service_date FROM (SELECT day FROM d, lo WHERE day>=s GROUP BY day HAVING count(DISTINCT feed)=4) g""")
def _(n):
    d = n.table("orders").where("weekday(o_orderdate)+1 = 3").select((F.col("o_custkey") % 4).alias("feed"), F.to_date("o_orderdate").alias("day"))
    first = d.groupBy("feed").agg(F.min("day").alias("s")).agg(F.date_add(F.max("s"), 7)).first()[0]
    return d.where(F.col("day") >= F.lit(first)).groupBy("day").agg(F.countDistinct("feed").alias("n")).where("n = 4").agg(F.min("day").cast("string").alias("service_date"))


@query("w01_monotone_profile", "SELECT stop_id, pattern_id, trip_id, dep_s, max(arr_s) OVER (PARTITION BY stop_id, pattern_id ORDER BY dep_s, trip_id ROWS UNBOUNDED PRECEDING) AS high FROM tn_stop_time")
def _(n):
    w = Window.partitionBy("stop_id", "pattern_id").orderBy("dep_s", "trip_id").rowsBetween(Window.unboundedPreceding, 0)
    return n.stop_time.select("stop_id", "pattern_id", "trip_id", "dep_s", F.max("arr_s").over(w).alias("high"))


@query("w03_elapsed", "SELECT pattern_id, trip_id, pos, dep_s-first_value(dep_s) OVER (PARTITION BY pattern_id, trip_id ORDER BY pos) AS elapsed_s FROM tn_stop_time")
def _(n):
    w = Window.partitionBy("pattern_id", "trip_id").orderBy("pos")
    return n.stop_time.select("pattern_id", "trip_id", "pos", (F.col("dep_s") - F.first("dep_s").over(w)).alias("elapsed_s"))


@query("w04_consecutive_stops", "SELECT pattern_id, pos, stop_id, next_id FROM (SELECT *, lead(stop_id) OVER (PARTITION BY pattern_id ORDER BY pos) AS next_id FROM tn_pattern_stop) t WHERE next_id IS NOT NULL")
def _(n):
    w = Window.partitionBy("pattern_id").orderBy("pos")
    return n.pattern_stop.withColumn("next_id", F.lead("stop_id").over(w)).where("next_id is not null").select("pattern_id", "pos", "stop_id", "next_id")


@query("w05_first_argmin", "SELECT cell_id, stop_id, walk_s FROM tn_access QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY walk_s, stop_id)=1")
def _(n):
    return n.reach.spread(n.reach.nearest()).select("cell_id", "stop_id", "walk_s")


@query("w06_trip_order", "SELECT pattern_id, trip_id, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY start_s, trip_id) AS BIGINT) AS trip_ix FROM tn_trip")
def _(n):
    return n.trip.select("pattern_id", "trip_id", F.row_number().over(Window.partitionBy("pattern_id").orderBy("start_s", "trip_id")).cast("long").alias("trip_ix"))


LEGS = "SELECT l_orderkey AS journey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS leg, CAST(l_quantity*37 AS BIGINT) AS sec FROM lineitem"


@query("w08_largest_remainder", f"""WITH l AS ({LEGS}), t AS (SELECT *, sec//60 AS base, sec%60 AS frac, CAST(ceil(sum(sec) OVER (PARTITION BY journey)/60.0) AS BIGINT)-CAST(sum(sec//60) OVER (PARTITION BY journey) AS BIGINT) AS need FROM l)
    SELECT journey, leg, CAST(base+CASE WHEN row_number() OVER (PARTITION BY journey ORDER BY frac DESC, leg)<=need THEN 1 ELSE 0 END AS BIGINT) AS minutes FROM t""")
def _(n):
    from wayfold.operators.journeys import reconciled_minutes

    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    legs = n.table("lineitem").select(F.col("l_orderkey").alias("journey"), F.row_number().over(order).cast("long").alias("leg"), (F.col("l_quantity") * 37).cast("long").alias("sec"))
    return reconciled_minutes(legs)


@query("u01_calendar_union", f"SELECT service_id FROM gt_calendar WHERE wednesday='1' UNION SELECT service_id FROM gt_calendar_dates WHERE exception_type='1' EXCEPT SELECT service_id FROM gt_calendar_dates WHERE exception_type='2'")
def _(n):
    c, d = n.view("gt_calendar"), n.view("gt_calendar_dates")
    return c.where("wednesday='1'").select("service_id").union(d.where("exception_type='1'").select("service_id")).distinct().subtract(d.where("exception_type='2'").select("service_id"))


@query("u02_pair_union", "SELECT from_id, to_id FROM tn_transfer UNION SELECT from_id, to_id FROM gt_transfer_rules WHERE transfer_type='2'")
def _(n):
    return n.transfer.select("from_id", "to_id").union(n.view("gt_transfer_rules").where("transfer_type='2'").select("from_id", "to_id")).distinct()


@query("u03_trip_intersect", f"SELECT trip_id FROM gt_trips WHERE service_id IN ({ACTIVE}) INTERSECT SELECT trip_id FROM ({CLEAN}) c")
def _(n):
    own = n.view("gt_trips").join(active(n), "service_id", "left_semi").select("trip_id")
    return own.intersect(timetable.clean_times(n.view("gt_stop_times")).select("trip_id"))


@query("j04_transfer_rules_join", """WITH r AS (SELECT from_id, to_id, bool_or(transfer_type='3') AS prohibited, max(CASE WHEN transfer_type='2' AND try_cast(min_transfer_time AS BIGINT)>=0 THEN try_cast(min_transfer_time AS BIGINT) END) AS min_s FROM gt_transfer_rules GROUP BY ALL),
    p AS (SELECT from_id, to_id FROM tn_transfer UNION SELECT from_id, to_id FROM r WHERE min_s IS NOT NULL)
    SELECT p.from_id, p.to_id, t.walk_s, CAST(r.min_s AS BIGINT) AS min_s, CAST(greatest(coalesce(t.walk_s,0), coalesce(r.min_s,0)) AS BIGINT) AS eff_s FROM p LEFT JOIN tn_transfer t ON p.from_id=t.from_id AND p.to_id=t.to_id LEFT JOIN r ON p.from_id=r.from_id AND p.to_id=r.to_id WHERE NOT coalesce(r.prohibited,false)""")
def _(n):
    from wayfold.operators.transfers import ruled_transfers

    return ruled_transfers(n.transfer, n.view("gt_transfer_rules"))


@query("j16_referenced_nodes", "SELECT node_id FROM wg_node WHERE node_id IN (SELECT a FROM wg_way UNION SELECT b FROM wg_way UNION SELECT c FROM wg_way)")
def _(n):
    w = n.view("wg_way")
    refs = w.select(F.explode(F.array("a", "b", "c")).alias("node_id"))
    return n.view("wg_node").join(refs, "node_id", "left_semi").select("node_id")


@query("j17_unique_edge", "SELECT from_id, to_id, min(walk_s) AS walk_s FROM tn_transfer GROUP BY from_id, to_id HAVING count(*)=1")
def _(n):
    return n.transfer.groupBy("from_id", "to_id").agg(F.min("walk_s").alias("walk_s"), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")


@query("v01_feed_integrity", f"""SELECT 'unknown_stop' AS code, count(*) AS violations FROM gt_stop_times WHERE CAST(stop_id AS BIGINT) NOT IN (SELECT stop_id FROM tn_stop)
    UNION ALL SELECT 'short_trip', count(*) FROM (SELECT trip_id FROM gt_stop_times GROUP BY trip_id HAVING count(*)<2) s
    UNION ALL SELECT 'time_travel', count(*) FROM (SELECT arr_s, lag(dep_s) OVER (PARTITION BY route_id, trip_id ORDER BY seq) AS before FROM ({CLEAN}) c) t WHERE arr_s<before
    UNION ALL SELECT 'duplicate_sequence', count(*) FROM (SELECT 1 FROM gt_stop_times GROUP BY route_id, trip_id, stop_sequence HAVING count(*)>1) d""")
def _(n):
    from wayfold.operators.validate import feed_integrity

    return feed_integrity(n.view("gt_stop_times"), n.stop.select(F.col("stop_id").cast("string").alias("stop_id")))


@query("v02_calendar_checks", """SELECT service_id, bool_or(exception_type='1') AND bool_or(exception_type='2') AS contradictory, CAST(count(*) AS BIGINT) AS exceptions FROM gt_calendar_dates GROUP BY service_id""")
def _(n):
    kind = lambda k: F.bool_or(F.col("exception_type") == k)
    return n.view("gt_calendar_dates").groupBy("service_id").agg((kind("1") & kind("2")).alias("contradictory"), F.count(F.lit(1)).alias("exceptions"))


@query("v03_modeled_wednesday", "SELECT event_id, CAST(CAST(d+CAST(((3-isodow(d)+7)%7) AS INT) AS DATE) AS VARCHAR) AS wednesday FROM (SELECT event_id, CAST(ts-INTERVAL 8 HOUR AS DATE) AS d FROM events) t")
def _(n):
    local = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Los_Angeles"))
    return n.table("events").select("event_id", F.next_day(F.date_sub(local, 1), "Wed").cast("string").alias("wednesday"))


@query("v04_timetable_invariants", """SELECT 'negative' AS code, count(*) AS violations FROM tn_stop_time WHERE arr_s<0 OR dep_s<arr_s
    UNION ALL SELECT 'not_monotone', count(*) FROM (SELECT arr_s, lag(dep_s) OVER (PARTITION BY pattern_id, trip_id ORDER BY pos) AS b FROM tn_stop_time) t WHERE arr_s<b
    UNION ALL SELECT 'gap_in_positions', count(*) FROM (SELECT 1 FROM tn_pattern_stop GROUP BY pattern_id HAVING max(pos)+1<>count(*)) g""")
def _(n):
    from wayfold.operators.validate import timetable_invariants

    return timetable_invariants(n.stop_time, n.pattern_stop)


@query("v06_transfer_parity", "SELECT count(*) AS violations FROM (SELECT from_id, to_id, walk_s FROM tn_transfer EXCEPT SELECT to_id, from_id, walk_s FROM tn_transfer) t")
def _(n):
    t = n.transfer
    return t.select("from_id", "to_id", "walk_s").exceptAll(t.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "walk_s")).agg(F.count(F.lit(1)).alias("violations"))
