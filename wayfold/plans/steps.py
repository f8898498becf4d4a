"""Queries of single steps: one boarding round, primary selection, typical minutes, annotated options."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.operators import choice
from wayfold.plans.base import query
from wayfold.plans.search import BY


@query("f29_deep_link", "SELECT cell_id, concat('/itinerary?id=',CAST(cell_id AS VARCHAR),'&x=',CAST(x_m AS VARCHAR),'&y=',CAST(y_m AS VARCHAR)) AS url FROM tn_cell")
def _(n):
    return n.cell.select("cell_id", F.concat(F.lit("/itinerary?id="), F.col("cell_id").cast("string"), F.lit("&x="), F.col("x_m").cast("string"), F.lit("&y="), F.col("y_m").cast("string")).alias("url"))


@query("j06_board_alight", f"""SELECT b.stop_id, CAST(max(b.dep_s) AS BIGINT) AS v FROM tn_egress e JOIN tn_stop_time a ON a.stop_id=e.stop_id AND a.arr_s<={BY}-e.walk_s-60 JOIN tn_stop_time b ON b.pattern_id=a.pattern_id AND b.trip_id=a.trip_id AND b.pos<a.pos GROUP BY b.stop_id""")
def _(n):
    reach = n.egress.join(n.stop_time, "stop_id").where(F.col("arr_s") <= BY - 60 - F.col("walk_s"))
    last = reach.groupBy("pattern_id", "trip_id").agg(F.max("pos").alias("last"))
    return last.join(n.stop_time, ["pattern_id", "trip_id"]).where("pos < last").groupBy("stop_id").agg(F.max("dep_s").alias("v"))


@query("n08_family_annotation", """SELECT o.cell_id, o.option_id, o.family, CAST(count(*) OVER (PARTITION BY o.cell_id, o.family) AS BIGINT) AS siblings, CAST(dense_rank() OVER (PARTITION BY o.cell_id, o.family ORDER BY o.branch) AS BIGINT) AS branch_no FROM ch_option o""")
def _(n):
    own = Window.partitionBy("cell_id", "family")
    return n.view("ch_option").select("cell_id", "option_id", "family", F.count(F.lit(1)).over(own).alias("siblings"), F.dense_rank().over(own.orderBy("branch")).cast("long").alias("branch_no"))


@query("n09_recommendation_publication", """SELECT r.cell_id, r.option_id, o.minutes, o.walk_min, o.line_id FROM (SELECT cell_id, option_id FROM ch_option QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY minutes, walk_min, transfers, frag_min, exact_s, anchor_neg, line_id, option_id)=1) r JOIN ch_option o ON o.cell_id=r.cell_id AND o.option_id=r.option_id""")
def _(n):
    o = n.view("ch_option")
    picked = choice.recommended(o).select("cell_id", F.col("best").alias("option_id"))
    return picked.join(o.select("cell_id", "option_id", "minutes", "walk_min", "line_id"), ["cell_id", "option_id"])
