"""A transit network, its feed files and a walking lattice, derived from the star-schema tables.

The definitions are plain SQL that Spark and other engines read alike. Integer arithmetic throughout. Spatial joins are
not part of this text: Spark runs them by buckets (operators.spatial), an oracle may run them as it likes.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from wayfold.operators import spatial

WEDNESDAY, DEST_X, DEST_Y = 3, 3000, 3000
TRANSFER_M, ACCESS_M, PACE = 600, 1200, 0.75

#: How many delay draws, and their numbers as rows.
DRAWS = 24
DRAW_IDS = " UNION ALL ".join(["SELECT CAST(0 AS BIGINT) AS d", *(f"SELECT {k}" for k in range(1, DRAWS))])

#: Views over the driver's tables. {dow} is the engine's ISO weekday of an order's date.
VIEWS = {
    "tn_stop": """SELECT stop_id, (stop_id*2741+517)%6000 AS x_m, (stop_id*4513+911)%6000 AS y_m
        FROM (SELECT DISTINCT CAST(floor(p_partkey/5) AS BIGINT) AS stop_id FROM part) t""",
    "tn_pattern_stop": """SELECT pattern_id, stop_id, CAST(rn-1 AS BIGINT) AS pos FROM (
        SELECT pattern_id, stop_id, row_number() OVER (PARTITION BY pattern_id
               ORDER BY (stop_id*7919+pattern_id*104729)%1000003, stop_id) AS rn
        FROM (SELECT DISTINCT l_suppkey AS pattern_id, CAST(floor(l_partkey/5) AS BIGINT) AS stop_id FROM lineitem) d) r
        WHERE rn<=8""",
    "tn_trip": """SELECT DISTINCT l_suppkey AS pattern_id, o_orderkey AS trip_id,
        18000+(o_orderkey*7919)%18600 AS start_s, 150+30*(o_orderkey%3) AS run_s
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE {dow}=3""",
    "tn_stop_time": """SELECT t.pattern_id, t.trip_id, p.pos, p.stop_id,
        start_s+p.pos*(run_s+20)-CASE WHEN p.pos>0 THEN 20 ELSE 0 END AS arr_s, start_s+p.pos*(run_s+20) AS dep_s
        FROM tn_trip t JOIN tn_pattern_stop p ON t.pattern_id=p.pattern_id""",
    "tn_cell": """SELECT c_custkey AS cell_id, CAST(c_nationkey AS BIGINT) AS hood, (c_custkey*1237+131)%6000 AS x_m, (c_custkey*3571+733)%6000 AS y_m FROM customer""",
    "tn_line": """SELECT s_suppkey AS pattern_id, s_suppkey%50 AS line_id, CASE WHEN s_suppkey%50%4=0 THEN 'metro' WHEN s_suppkey%50%4=1 THEN 'bart' WHEN s_suppkey%50%4=2 THEN 'cable' ELSE 'bus' END AS mode,
        CASE WHEN s_suppkey%50%4=1 THEN 'bart.zip' ELSE 'muni.zip' END AS feed, concat('L', CAST(s_suppkey%50 AS VARCHAR(20))) AS line_name FROM supplier""",
    # feed files, all strings, with the faults that ingestion has to face
    "gt_stop_times": """SELECT CAST(trip_id AS VARCHAR(20)) AS trip_id, CAST(pos AS VARCHAR(20)) AS stop_sequence, CAST(stop_id AS VARCHAR(20)) AS stop_id, CAST(pattern_id AS VARCHAR(20)) AS route_id,
        CASE WHEN (trip_id+pos)%17=0 THEN '' ELSE concat(lpad(CAST(CAST(floor((arr_s+43200)/3600) AS BIGINT) AS VARCHAR(20)),2,'0'),':',lpad(CAST(CAST(floor(arr_s/60) AS BIGINT)%60 AS VARCHAR(20)),2,'0'),':',lpad(CAST(arr_s%60 AS VARCHAR(20)),2,'0')) END AS arrival_time,
        CASE WHEN (trip_id+pos)%34=0 THEN ' ' WHEN trip_id%101=0 AND pos=1 THEN '7:61:00' ELSE concat(lpad(CAST(CAST(floor((dep_s+43200)/3600) AS BIGINT) AS VARCHAR(20)),2,'0'),':',lpad(CAST(CAST(floor(dep_s/60) AS BIGINT)%60 AS VARCHAR(20)),2,'0'),':',lpad(CAST(dep_s%60 AS VARCHAR(20)),2,'0')) END AS departure_time
        FROM tn_stop_time""",
    "gt_routes": """SELECT CAST(p_partkey AS VARCHAR(20)) AS route_id, CASE WHEN p_partkey%5=0 THEN ' ' WHEN p_partkey%5=1 THEN NULL ELSE p_brand END AS route_short_name,
        CASE WHEN p_partkey%15=0 THEN '' ELSE p_name END AS route_long_name, CAST(p_size%8 AS VARCHAR(20)) AS route_type,
        CASE WHEN p_partkey%2=0 THEN concat(CAST(p_partkey AS VARCHAR(20)),'.0') ELSE CAST(p_partkey AS VARCHAR(20)) END AS ref_id FROM part""",
    "gt_trips": """SELECT CAST(o_orderkey AS VARCHAR(20)) AS trip_id, CAST(o_orderkey%40 AS VARCHAR(20)) AS service_id, CAST(o_custkey%25 AS VARCHAR(20)) AS route_id FROM orders""",
    "gt_calendar": """SELECT CAST(s AS VARCHAR(20)) AS service_id, CASE WHEN s%7=2 OR s%3=0 THEN '1' ELSE '0' END AS wednesday, CASE WHEN s%2=0 THEN '1' ELSE '0' END AS saturday,
        CASE WHEN s%11=0 THEN '20240401' ELSE '20240101' END AS start_date, CASE WHEN s%13=0 THEN '20240131' ELSE '20241231' END AS end_date FROM (SELECT DISTINCT o_orderkey%40 AS s FROM orders) t""",
    "gt_calendar_dates": """SELECT CAST(s AS VARCHAR(20)) AS service_id, '20240306' AS date, CASE WHEN s%4=0 THEN '2' ELSE '1' END AS exception_type FROM (SELECT DISTINCT o_orderkey%40 AS s FROM orders) t WHERE s%5<2""",
    "gt_shapes": """SELECT CAST(l_suppkey%20 AS VARCHAR(20)) AS route_id, CAST(l_orderkey%97 AS VARCHAR(20)) AS shape_id, l_orderkey*8+l_linenumber AS seq, (l_partkey*37)%6000 AS x_m, (l_orderkey*41)%6000 AS y_m FROM lineitem""",
    "gt_transfer_rules": """SELECT l_partkey%400 AS from_id, l_suppkey%400 AS to_id, CASE WHEN l_linenumber=7 THEN '3' ELSE '2' END AS transfer_type,
        CASE WHEN l_linenumber=6 THEN 'x' WHEN l_linenumber=5 THEN '-5' ELSE CAST((l_orderkey*13)%300 AS VARCHAR(20)) END AS min_transfer_time FROM lineitem""",
    "gt_transfers": """SELECT CAST(l_partkey%400 AS VARCHAR(20)) AS from_stop_id, CASE WHEN l_quantity=50 THEN ' ' ELSE concat(' ',CAST((l_partkey*31+l_suppkey*7+l_orderkey)%400 AS VARCHAR(20))) END AS to_stop_id,
        CASE l_linenumber WHEN 1 THEN '2' WHEN 2 THEN '0' WHEN 3 THEN '3' WHEN 4 THEN '4' WHEN 5 THEN ' 5 ' WHEN 6 THEN '9' ELSE '2' END AS transfer_type,
        CASE WHEN l_quantity<5 THEN '' WHEN l_quantity<8 THEN 'x' WHEN l_quantity<10 THEN '-5' ELSE CAST((l_orderkey*13)%600 AS VARCHAR(20)) END AS min_transfer_time,
        CASE WHEN l_orderkey%4=0 THEN concat('R',CAST(l_suppkey%5 AS VARCHAR(20))) END AS from_route_id, CASE WHEN l_orderkey%8=0 THEN concat('R',CAST(l_partkey%5 AS VARCHAR(20))) ELSE ' ' END AS to_route_id,
        CASE WHEN l_orderkey%3=0 THEN concat('T',CAST(l_orderkey%50 AS VARCHAR(20))) END AS from_trip_id, CASE WHEN l_orderkey%6=0 THEN concat('T',CAST(l_partkey%50 AS VARCHAR(20))) ELSE '' END AS to_trip_id FROM lineitem""",
    "gt_pathways": """SELECT CASE WHEN l_quantity=49 THEN ' ' ELSE concat('p',CAST(l_suppkey%7 AS VARCHAR(20))) END AS pathway_id, CAST(l_partkey%400 AS VARCHAR(20)) AS from_stop_id, CAST((l_partkey*31+l_suppkey*7+l_orderkey%5)%400 AS VARCHAR(20)) AS to_stop_id,
        CAST(l_linenumber AS VARCHAR(20)) AS pathway_mode, CASE WHEN l_quantity<20 THEN '0' WHEN l_quantity<40 THEN ' 1' WHEN l_quantity<45 THEN '2' ELSE '' END AS is_bidirectional,
        CASE WHEN l_orderkey%3=0 THEN '' ELSE CAST((l_orderkey*7)%90-5 AS VARCHAR(20)) END AS length, CASE WHEN l_orderkey%4=0 THEN '' WHEN l_orderkey%4=1 THEN '-3' ELSE CAST((l_orderkey*17)%240 AS VARCHAR(20)) END AS traversal_time FROM lineitem WHERE l_linenumber<4""",
    # a walking lattice: each cell's node, edges to the next ids, a height for the slope
    "wg_node": """SELECT c_custkey AS node_id, (c_custkey*1237+131)%6000 AS x_m, (c_custkey*3571+733)%6000 AS y_m, (c_custkey*31)%120 AS elev_m FROM customer""",
    "wg_way": """SELECT o_orderkey AS way_id, o_custkey AS a, o_custkey+1 AS b, o_custkey+7 AS c,
        CASE WHEN o_orderkey%9=0 THEN 'motorway' WHEN o_orderkey%9=1 THEN 'steps' WHEN o_orderkey%9=2 THEN 'footway' WHEN o_orderkey%9=3 THEN 'cycleway' ELSE 'residential' END AS highway,
        CASE WHEN o_orderkey%10=0 THEN 'no' WHEN o_orderkey%9=3 AND o_orderkey%2=0 THEN 'yes' ELSE NULL END AS foot,
        CASE WHEN o_orderkey%23=0 THEN 'private' ELSE NULL END AS access FROM orders""",
    # journeys, route options and legs: an order is a cell's choice, its lines are options or legs
    "ch_leg": """SELECT l_orderkey AS journey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS leg,
        CAST(l_quantity*37 AS BIGINT) AS dur_s, 28800+(l_partkey*97)%5400 AS dep_s, CASE WHEN l_quantity<=10 THEN 'walk' ELSE 'ride' END AS kind, l_suppkey%50 AS line_id FROM lineitem""",
    "ch_option": """SELECT l_orderkey AS cell_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS option_id,
        CAST(l_quantity AS BIGINT) AS minutes, l_partkey%20 AS walk_min, CAST(l_linenumber%4 AS BIGINT) AS transfers, CAST(l_discount*100 AS BIGINT) AS frag_min,
        l_suppkey%5 AS family, l_suppkey%3 AS branch, l_suppkey%50 AS line_id, l_partkey%6 AS final_walk, l_suppkey%4 AS access_walk, CAST(l_quantity AS BIGINT)*60-l_partkey%60 AS exact_s, -(28800+(l_partkey*53)%1800) AS anchor_neg,
        CASE WHEN CAST(l_quantity AS BIGINT)-l_partkey%20<=2 AND l_partkey%6>=4 THEN 1 ELSE 0 END AS token_ride FROM lineitem""",
    # delay draws: four uniforms a trip and draw from its numbers; late start and drift are sums of two exponentials, by mode
    "mc_draw": f"""SELECT t.pattern_id, t.trip_id, t.draw_id, round(-(m.mean_s/2e0)*ln(u1*u2),6) AS delta0, round(-(m.drift/2e0)*ln(u3*u4),9) AS slope FROM (
        SELECT trip.*, d AS draw_id, (((trip_id*7919+pattern_id*31+d*104729+13)%1000003)+0.5e0)/1000003e0 AS u1, (((trip_id*15485863+pattern_id*17+d*32452843+29)%1000003)+0.5e0)/1000003e0 AS u2,
        (((trip_id*49979687+pattern_id*61+d*86028121+47)%1000003)+0.5e0)/1000003e0 AS u3, (((trip_id*67867967+pattern_id*89+d*122949823+71)%1000003)+0.5e0)/1000003e0 AS u4
        FROM tn_trip trip CROSS JOIN ({DRAW_IDS}) x) t
        JOIN (SELECT pattern_id, CASE WHEN feed LIKE '%bart%' THEN 25e0 WHEN mode='cable' THEN 40e0 WHEN mode='metro' THEN 45e0 ELSE 70e0 END AS mean_s,
            CASE WHEN feed LIKE '%bart%' THEN 0.012e0 WHEN mode='cable' THEN 0.03e0 WHEN mode='metro' THEN 0.025e0 ELSE 0.035e0 END AS drift FROM tn_line) m ON m.pattern_id=t.pattern_id""",
}
ORACLE_SPATIAL = {
    "tn_transfer": f"""SELECT a.stop_id AS from_id, b.stop_id AS to_id, CAST(floor((abs(a.x_m-b.x_m)+abs(a.y_m-b.y_m))*{PACE}+0.5) AS BIGINT) AS walk_s
        FROM tn_stop a JOIN tn_stop b ON a.stop_id<>b.stop_id AND abs(a.x_m-b.x_m)+abs(a.y_m-b.y_m)<={TRANSFER_M}""",
    "tn_access": f"""SELECT c.cell_id, s.stop_id, CAST(floor((abs(c.x_m-s.x_m)+abs(c.y_m-s.y_m))*{PACE}+0.5) AS BIGINT) AS walk_s
        FROM tn_cell c JOIN tn_stop s ON abs(c.x_m-s.x_m)+abs(c.y_m-s.y_m)<={ACCESS_M}""",
    "tn_egress": f"""SELECT s.stop_id, CAST(floor((abs({DEST_X}-s.x_m)+abs({DEST_Y}-s.y_m))*{PACE}+0.5) AS BIGINT) AS walk_s
        FROM tn_stop s WHERE abs({DEST_X}-s.x_m)+abs({DEST_Y}-s.y_m)<={ACCESS_M}""",
}
TABLES = "region nation customer supplier part orders lineitem events".split()


def oracle_with(sql: str) -> str:
    """The SQL with the views it mentions, directly or through others, as common table expressions."""
    every = {k: v.replace("{dow}", "extract(isodow from o_orderdate)") for k, v in (VIEWS | ORACLE_SPATIAL).items()}
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        new = {k for k in every if k in text and k not in need}
        need |= new
        todo += [every[k] for k in new]
    views = [f"{k} AS MATERIALIZED ({every[k]})" for k in every if k in need]
    if not views:
        return sql
    head = "WITH RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    body = sql.lstrip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(lead):
            return head + ",\n".join(views) + ",\n" + body[len(lead) :]
    return head + ",\n".join(views) + "\n" + body


class Network:
    """The views as DataFrames, named without their prefix where it is tn_."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """A view's frame; the views and tables its text names are registered under those names."""
        if name not in self._views:
            text = VIEWS[name].replace("{dow}", "(weekday(o_orderdate)+1)")
            for t in TABLES:
                if t in text:
                    self.table(t).createOrReplaceTempView(t)
            for v in VIEWS:
                if v in text:
                    self.view(v).createOrReplaceTempView(v)
            self._views[name] = self.spark.sql(text)
        return self._views[name]

    stop = property(lambda self: self.view("tn_stop"))
    pattern_stop = property(lambda self: self.view("tn_pattern_stop"))
    trip = property(lambda self: self.view("tn_trip"))
    stop_time = property(lambda self: self.view("tn_stop_time"))
    cell = property(lambda self: self.view("tn_cell"))
    line = property(lambda self: self.view("tn_line"))

    @cached_property
    def transfer(self) -> DataFrame:
        near = spatial.manhattan_join(self.stop, self.stop, TRANSFER_M, "stop_id", "stop_id", ("from_id", "to_id"))
        return near.where("from_id <> to_id").select("from_id", "to_id", spatial.walk_seconds("dist_m", PACE).alias("walk_s"))

    @cached_property
    def access(self) -> DataFrame:
        near = spatial.manhattan_join(self.cell, self.stop, ACCESS_M, "cell_id", "stop_id", ("cell_id", "stop_id"))
        return near.select("cell_id", "stop_id", spatial.walk_seconds("dist_m", PACE).alias("walk_s"))

    @cached_property
    def reach(self) -> spatial.Reach:
        """access by points: cells and stops that share theirs are one place."""
        return spatial.Reach(self.cell, "cell_id", self.stop, "stop_id", ACCESS_M, PACE)

    @cached_property
    def footpaths(self) -> spatial.Reach:
        """transfer by points, with the way of no metres between stops on one point, and from a stop to itself."""
        return spatial.Reach(self.stop, "stop_id", self.stop, "stop_id", TRANSFER_M, PACE)

    @cached_property
    def egress(self) -> DataFrame:
        dist = f"abs({DEST_X}-x_m)+abs({DEST_Y}-y_m)"
        return self.stop.where(f"{dist} <= {ACCESS_M}").selectExpr("stop_id", f"{dist} AS dist_m").select("stop_id", spatial.walk_seconds("dist_m", PACE).alias("walk_s"))
