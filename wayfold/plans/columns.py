"""Queries of column functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import feeds, walking
from wayfold.operators import spatial
from wayfold.plans.base import query

SEC = "try_cast(split_part(trim({0}),':',1) AS BIGINT)*3600+try_cast(split_part(trim({0}),':',2) AS BIGINT)*60+try_cast(split_part(trim({0}),':',3) AS BIGINT)"
ROW = "trip_id, stop_sequence"


@query("f01_gtfs_seconds", f"SELECT {ROW}, {SEC.format('arrival_time')} AS arr_s, {SEC.format('departure_time')} AS dep_s FROM gt_stop_times")
def _(n):
    return n.view("gt_stop_times").select("trip_id", "stop_sequence", feeds.seconds(F.col("arrival_time")).alias("arr_s"), feeds.seconds(F.col("departure_time")).alias("dep_s"))


@query("f02_strict_time", rf"SELECT {ROW}, CASE WHEN regexp_full_match(trim(departure_time), '\d+:\d+:\d+') AND try_cast(split_part(trim(departure_time),':',2) AS BIGINT)<60 AND try_cast(split_part(trim(departure_time),':',3) AS BIGINT)<60 THEN {SEC.format('departure_time')} END AS dep_s FROM gt_stop_times")
def _(n):
    return n.view("gt_stop_times").select("trip_id", "stop_sequence", feeds.strict_seconds(F.col("departure_time")).alias("dep_s"))


@query("f03_cross_patch", f"SELECT {ROW}, coalesce({SEC.format('arrival_time')}, {SEC.format('departure_time')}) AS arr_s, coalesce({SEC.format('departure_time')}, {SEC.format('arrival_time')}) AS dep_s FROM gt_stop_times")
def _(n):
    a, d = feeds.patched(feeds.seconds(F.col("arrival_time")), feeds.seconds(F.col("departure_time")))
    return n.view("gt_stop_times").select("trip_id", "stop_sequence", a.alias("arr_s"), d.alias("dep_s"))


@query("f04_display_name", "SELECT route_id, coalesce(nullif(trim(route_short_name),''), nullif(trim(route_long_name),''), route_id) AS name FROM gt_routes")
def _(n):
    return n.view("gt_routes").select("route_id", feeds.display_name(F.col("route_short_name"), F.col("route_long_name"), F.col("route_id")).alias("name"))


@query("f05_float_id_lookup", """SELECT r.ref_id, coalesce(n.route_short_name, n.route_long_name, r.ref_id) AS name FROM gt_routes r
    LEFT JOIN gt_routes n ON CAST(CAST(r.ref_id AS DOUBLE) AS BIGINT) = CAST(n.route_id AS BIGINT)""")
def _(n):
    r = n.view("gt_routes")
    names = r.select(F.col("route_id").alias("key"), F.coalesce("route_short_name", "route_long_name").alias("found"))
    return r.select("ref_id", feeds.plain_ref(F.col("ref_id")).alias("key")).join(names, "key", "left").select("ref_id", F.coalesce("found", "ref_id").alias("name"))


@query("f06_mode_bucket", """SELECT route_id, CASE WHEN route_type='0' THEN 'metro' WHEN route_type IN ('1','2') THEN 'bart' WHEN route_type='5' THEN 'cable' ELSE 'bus' END AS mode FROM gt_routes""")
def _(n):
    return n.view("gt_routes").select("route_id", feeds.mode_of(F.col("route_type")).alias("mode"))


@query("f07_weekday_name", "SELECT o_orderkey, lower(dayname(o_orderdate)) AS weekday FROM orders")
def _(n):
    return n.table("orders").select("o_orderkey", feeds.weekday_name(F.col("o_orderdate")).alias("weekday"))


DEG = "{0}/111320.0"


def _latlon(df):
    return df.withColumn("lat", 37.7 + F.col("y_m") / 111320.0).withColumn("lon", -122.5 + F.col("x_m") / 88000.0)


@query("f08_equirectangular", """SELECT cell_id, CAST(round(sqrt(pow((lon+122.45)*111320.0*cos(radians(37.75)),2)+pow((lat-37.75)*111320.0,2)),3) AS DOUBLE) AS dist_m
    FROM (SELECT cell_id, 37.7+y_m/111320.0 AS lat, -122.5+x_m/88000.0 AS lon FROM tn_cell) t""")
def _(n):
    d = spatial.equirectangular_m(F.lit(37.75), F.lit(-122.45), F.col("lat"), F.col("lon"), 37.75)
    return _latlon(n.cell).select("cell_id", F.round(d, 3).alias("dist_m"))


@query("f09_haversine", """SELECT cell_id, CAST(round(2*6371008.8*asin(sqrt(least(1.0, pow(sin(radians(lat-37.75)/2),2)+cos(radians(37.75))*cos(radians(lat))*pow(sin(radians(lon+122.45)/2),2)))),3) AS DOUBLE) AS dist_m
    FROM (SELECT cell_id, 37.7+y_m/111320.0 AS lat, -122.5+x_m/88000.0 AS lon FROM tn_cell) t""")
def _(n):
    return _latlon(n.cell).select("cell_id", F.round(spatial.haversine_m(F.lit(37.75), F.lit(-122.45), F.col("lat"), F.col("lon")), 3).alias("dist_m"))


@query("f10_segment_distance", """SELECT cell_id, CAST(round((x_m-(1000+u*4000))*(x_m-(1000+u*4000))+(y_m-(2000+u*1000))*(y_m-(2000+u*1000)),3) AS DOUBLE) AS d2
    FROM (SELECT *, greatest(0.0, least(1.0, ((x_m-1000)*4000.0+(y_m-2000)*1000.0)/17000000.0)) AS u FROM tn_cell) t""")
def _(n):
    ends = [F.lit(float(v)) for v in (1000, 2000, 5000, 3000)]
    return n.cell.select("cell_id", F.round(spatial.segment_distance_sq(F.col("x_m"), F.col("y_m"), *ends), 3).alias("d2"))


@query("f11_tobler", """SELECT a.node_id, CAST(round(exp(3.5*(abs(greatest(-0.5,least(0.5,(b.elev_m-a.elev_m)/100.0))+0.05)-0.05)),9) AS DOUBLE) AS factor
    FROM wg_node a JOIN wg_node b ON b.node_id=a.node_id+1""")
def _(n):
    a, b = n.view("wg_node"), n.view("wg_node").select((F.col("node_id") - 1).alias("node_id"), F.col("elev_m").alias("next_m"))
    return a.join(b, "node_id").select("node_id", F.round(walking.tobler((F.col("next_m") - F.col("elev_m")) / 100.0), 9).alias("factor"))


@query("f13_walk_rescale", "SELECT cell_id, stop_id, CAST(round_even(walk_s*(4.8/4.2),0) AS BIGINT) AS walk_s FROM tn_access")
def _(n):
    return n.access.select("cell_id", "stop_id", walking.scaled_rint(F.col("walk_s"), 4.8 / 4.2).alias("walk_s"))


@query("f14_transfer_rescale", """SELECT from_id, to_id, CAST(floor(greatest(CASE WHEN (from_id+to_id)%5=0 THEN walk_s ELSE walk_s*(4.8/3.4) END, (from_id%4)*90)+0.5) AS BIGINT) AS eff_s FROM tn_transfer""")
def _(n):
    eff = walking.scaled_transfer(F.col("walk_s"), F.col("from_id") % 4 * 90, 4.8 / 3.4, (F.col("from_id") + F.col("to_id")) % 5 == 0)
    return n.transfer.select("from_id", "to_id", eff.alias("eff_s"))


@query("f15_legacy_rescale", "SELECT from_id, to_id, CAST(CASE WHEN w>0 THEN greatest(round_even(w*0.01,0),1) ELSE w END AS BIGINT) AS walk_s FROM (SELECT *, walk_s-walk_s%50 AS w FROM tn_transfer) t")
def _(n):
    w = F.col("walk_s") - F.col("walk_s") % 50
    return n.transfer.select("from_id", "to_id", walking.scaled_never_zero(w, 0.01).alias("walk_s"))


@query("f16_deadline_grid", """SELECT CAST(s_suppkey AS BIGINT) AS dest_id, CAST(unnest(range(28800+s_suppkey%7*60, 32400+1, 180)) AS BIGINT) AS deadline_s FROM supplier""")
def _(n):
    first = 28800 + F.col("s_suppkey") % 7 * 60
    return n.table("supplier").select(F.col("s_suppkey").cast("long").alias("dest_id"), F.explode(F.sequence(first, F.lit(32400).cast("long"), F.lit(180).cast("long"))).alias("deadline_s"))


@query("f17_request_clamps", """SELECT c_custkey, CAST(greatest(1, least(8, c_custkey%12-1)) AS BIGINT) AS rides, CASE WHEN c_mktsegment IN ('slow','med','fast') THEN c_mktsegment ELSE 'med' END AS pace,
    c_acctbal BETWEEN 0 AND 5000 AS inside FROM customer""")
def _(n):
    rides = F.greatest(F.lit(1), F.least(F.lit(8), F.col("c_custkey") % 12 - 1)).cast("long")
    pace = F.when(F.col("c_mktsegment").isin(*walking.PRESETS_KMH), F.col("c_mktsegment")).otherwise("med")
    return n.table("customer").select("c_custkey", rides.alias("rides"), pace.alias("pace"), (~F.isnan("c_acctbal") & F.col("c_acctbal").between(0, 5000)).alias("inside"))


@query("f18_octant", "SELECT cell_id, CAST(((round_even(degrees(atan2(y_m-3000, x_m-3000))/45.0,0)::BIGINT % 8)+8)%8 AS BIGINT) AS octant, CAST(((round_even(degrees(atan2(y_m-3000, x_m-3000))/22.5,0)::BIGINT % 16)+16)%16 AS BIGINT) AS heading FROM tn_cell")
def _(n):
    dx, dy = F.col("x_m") - 3000, F.col("y_m") - 3000
    return n.cell.select("cell_id", walking.octant(dx, dy).alias("octant"), walking.octant(dx, dy, 16).alias("heading"))


@query("f22_route_signature", """SELECT o_orderkey, coalesce(nullif(string_agg(CASE WHEN l_quantity>10 THEN 'L' || (l_suppkey%50) END, ' > ' ORDER BY l_partkey, l_suppkey, l_quantity),''),'walk only') AS signature
    FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY o_orderkey""")
def _(n):
    legs = n.table("lineitem").select("l_orderkey", F.struct("l_partkey", "l_suppkey", "l_quantity").alias("leg")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("leg")).alias("legs"))
    rides = F.transform(F.filter("legs", lambda x: x["l_quantity"] > 10), lambda x: F.concat(F.lit("L"), (x["l_suppkey"] % 50).cast("string")))
    return legs.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.size(rides) == 0, "walk only").otherwise(F.array_join(rides, " > ")).alias("signature"))


#: Minutes and red levels of the colour ramp.
RAMP = ((0, 26), (15, 80), (25, 140), (35, 200), (45, 240), (55, 220), (65, 160), (75, 90))


def _ramp_sql(v: str) -> str:
    parts = " ".join(f"WHEN {v}<={b[0]} THEN {a[1]}+({v}-{a[0]})*{(b[1] - a[1]) / (b[0] - a[0])!r}" for a, b in zip(RAMP, RAMP[1:], strict=False))
    return f"CASE WHEN {v}<={RAMP[0][0]} THEN {RAMP[0][1]} {parts} ELSE {RAMP[-1][1]} END"


@query("f23_colour_ramp", f"SELECT c_custkey, CAST(floor(({_ramp_sql('(c_custkey%90)')})+0.5) AS BIGINT) AS red FROM customer")
def _(n):
    v = F.col("c_custkey") % 90
    out = F.when(v <= RAMP[0][0], F.lit(float(RAMP[0][1])))
    for a, b in zip(RAMP, RAMP[1:], strict=False):
        out = out.when(v <= b[0], a[1] + (v - a[0]) * F.lit((b[1] - a[1]) / (b[0] - a[0])))
    return n.table("customer").select("c_custkey", F.floor(out.otherwise(float(RAMP[-1][1])) + 0.5).alias("red"))


@query("f24_cell_style", "SELECT cell_id, CASE WHEN y_m%90>60 THEN 'hidden' WHEN hood%2=0 THEN 'line' ELSE 'fill' END AS style FROM tn_cell")
def _(n):
    return n.cell.select("cell_id", F.when(F.col("y_m") % 90 > 60, "hidden").when(F.col("hood") % 2 == 0, "line").otherwise("fill").alias("style"))


@query("f25_minute_label", "SELECT cell_id, CASE WHEN walk_s>=3600 THEN concat(CAST(walk_s//3600 AS VARCHAR),' h ',CAST(walk_s%3600//60 AS VARCHAR),' min') ELSE concat(CAST(CAST(ceil(walk_s/60.0) AS BIGINT) AS VARCHAR),' min') END AS label FROM (SELECT cell_id, x_m AS walk_s FROM tn_cell) t")
def _(n):
    s = F.col("x_m")
    return n.cell.select("cell_id", F.when(s >= 3600, F.concat((s / 3600).cast("long"), F.lit(" h "), (s % 3600 / 60).cast("long"), F.lit(" min"))).otherwise(F.concat(walking.minutes_up(s), F.lit(" min"))).alias("label"))


@query("f26_query_text", r"SELECT event_id, lower(regexp_replace(trim(concat('  ', event_type, '   ', upper(event_type), ' ')), '\s+', ' ', 'g')) AS q FROM events")
def _(n):
    raw = F.concat(F.lit("  "), F.col("event_type"), F.lit("   "), F.upper("event_type"), F.lit(" "))
    return n.table("events").select("event_id", feeds.plain_query(raw).alias("q"))


@query("f27_whole_second_mtime", "SELECT event_id, CAST(floor(epoch_us(ts)/1000000) AS BIGINT) AS mtime_s FROM events")
def _(n):
    return n.table("events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("mtime_s"))


@query("f28_lag_encode", "SELECT pattern_id, trip_id, pos, CASE WHEN 32400-dep_s BETWEEN 0 AND 65534 THEN CAST(32400-dep_s AS BIGINT) ELSE 65535 END AS lag_u16, 32400-dep_s BETWEEN 0 AND 65534 AS valid FROM tn_stop_time")
def _(n):
    lag = F.lit(32400) - F.col("dep_s")
    return n.stop_time.select("pattern_id", "trip_id", "pos", F.when(lag.between(0, 65534), lag).otherwise(65535).cast("long").alias("lag_u16"), lag.between(0, 65534).alias("valid"))


#: Mean initial delay in seconds and its drift per second of ride, by mode.
DELAY_MEAN = {"bus": 70, "metro": 45, "cable": 40, "bart": 25, "caltrain": 40}
DELAY_DRIFT = {"bus": 0.035, "metro": 0.025, "cable": 0.03, "bart": 0.012, "caltrain": 0.02}


def by_mode(mode, feed, values: dict):
    """A value by mode, that of bart or caltrain where the feed's name says so."""
    out = F.lit(values["bus"])
    for k in ("metro", "cable", "bart"):
        out = F.when(mode == k, values[k]).otherwise(out)
    for k in ("bart", "caltrain"):
        out = F.when(F.lower(feed).contains(k), values[k]).otherwise(out)
    return out


def by_mode_sql(values: dict) -> str:
    return "CASE WHEN contains(lower(feed),'caltrain') THEN {caltrain} WHEN contains(lower(feed),'bart') THEN {bart} WHEN mode='bart' THEN {bart} WHEN mode='cable' THEN {cable} WHEN mode='metro' THEN {metro} ELSE {bus} END".format(**values)


@query("f30_delay_parameters", f"SELECT pattern_id, CAST({by_mode_sql(DELAY_MEAN)} AS BIGINT) AS mean_s, CAST({by_mode_sql(DELAY_DRIFT)} AS DOUBLE) AS drift FROM tn_line")
def _(n):
    return n.line.select("pattern_id", by_mode(F.col("mode"), F.col("feed"), DELAY_MEAN).cast("long").alias("mean_s"), by_mode(F.col("mode"), F.col("feed"), DELAY_DRIFT).cast("double").alias("drift"))


@query("p05_valid_coordinates", "SELECT cell_id FROM (SELECT cell_id, CASE WHEN cell_id%13=0 THEN 'NaN'::DOUBLE ELSE 37.7+y_m/111320.0 END AS lat FROM tn_cell) t WHERE NOT isnan(lat) AND lat BETWEEN 37.71 AND 37.75")
def _(n):
    lat = F.when(F.col("cell_id") % 13 == 0, F.lit(float("nan"))).otherwise(37.7 + F.col("y_m") / 111320.0)
    return n.cell.where(~F.isnan(lat) & lat.between(37.71, 37.75)).select("cell_id")


@query("p07_pedestrian_ways", """SELECT way_id, highway='steps' AS stairs FROM wg_way WHERE (highway IN ('residential','footway','steps') OR (highway='cycleway' AND foot='yes'))
    AND coalesce(foot,'')<>'no' AND (coalesce(access,'')<>'private' OR coalesce(foot,'')='yes')""")
def _(n):
    from wayfold.operators.walkgraph import pedestrian

    return n.view("wg_way").where(pedestrian()).select("way_id", (F.col("highway") == "steps").alias("stairs"))


@query("p12_token_transit", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity<=2 AND l_partkey%20>=8 AS token FROM lineitem")
def _(n):
    return n.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_quantity") <= 2) & (F.col("l_partkey") % 20 >= 8)).alias("token"))


@query("j15_nearest_cell", """SELECT s.stop_id, arg_min(c.cell_id, (c.x_m-s.x_m)*(c.x_m-s.x_m)+(c.y_m-s.y_m)*(c.y_m-s.y_m)+c.cell_id*1e-9) AS cell_id
    FROM tn_stop s JOIN tn_cell c ON (c.x_m-s.x_m)*(c.x_m-s.x_m)+(c.y_m-s.y_m)*(c.y_m-s.y_m)<=640000 GROUP BY s.stop_id""")
def _(n):
    return spatial.nearest(n.stop, n.cell, 1, 800, "stop_id", "cell_id", ("stop_id", "cell_id")).select("stop_id", "cell_id")


@query("j02_radius_join", "SELECT from_id, to_id, walk_s FROM tn_transfer")
def _(n):
    return n.transfer


@query("j03_haversine_candidates", """SELECT a.stop_id AS from_id, b.stop_id AS to_id FROM tn_stop a JOIN tn_stop b ON a.stop_id<>b.stop_id
    WHERE 2*6371008.8*asin(sqrt(least(1.0, pow(sin(radians((b.y_m-a.y_m)/111320.0)/2),2)+cos(radians(37.7+a.y_m/111320.0))*cos(radians(37.7+b.y_m/111320.0))*pow(sin(radians((b.x_m-a.x_m)/88000.0)/2),2))))<=400""")
def _(n):
    """Buckets find the candidates on the plane, five per cent further than asked; the great circle decides."""
    near = spatial.euclid_join(n.stop, n.stop, 420, "stop_id", "stop_id", ("from_id", "to_id")).where("from_id<>to_id").select("from_id", "to_id")
    at = lambda k: _latlon(n.stop).select(F.col("stop_id").alias(f"{k}_id"), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    both = near.join(at("from"), "from_id").join(at("to"), "to_id")
    return both.where(spatial.haversine_m(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")) <= 400).select("from_id", "to_id")


@query("j09_knn_snap", """SELECT cell_id, node_id, CAST(rank AS BIGINT) AS rank, CAST(floor(sqrt(d2)*0.75+0.5) AS BIGINT) AS connect_s FROM (
    SELECT c.cell_id, n.node_id, row_number() OVER (PARTITION BY c.cell_id ORDER BY (c.x_m-n.x_m)*(c.x_m-n.x_m)+(c.y_m-n.y_m)*(c.y_m-n.y_m), n.node_id) AS rank,
      (c.x_m-n.x_m)*(c.x_m-n.x_m)+(c.y_m-n.y_m)*(c.y_m-n.y_m) AS d2
    FROM tn_cell c JOIN wg_node n ON (c.x_m-n.x_m)*(c.x_m-n.x_m)+(c.y_m-n.y_m)*(c.y_m-n.y_m)<=90000) t WHERE rank<=4""")
def _(n):
    near = spatial.nearest(n.cell, n.view("wg_node"), 4, 300, "cell_id", "node_id", ("cell_id", "node_id"))
    return near.select("cell_id", "node_id", F.col("rank").cast("long").alias("rank"), F.floor(F.sqrt("d2") * 0.75 + 0.5).cast("long").alias("connect_s"))
