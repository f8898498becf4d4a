"""Queries of what is shown over the map: committed rides, reliability of either semantic, alternatives that count it, recommendations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wayfold.operators import planned, reliability, selection
from wayfold.operators.rounds import settle
from wayfold.plans.base import baked, query
from wayfold.plans.choices import CLOSURE, FAMILIES, OPTIONS, PRUNED, closed, selected_sql
from wayfold.plans.montecarlo import MC, SHOWN, _plan, published_sql, score_sql
from wayfold.plans.planned import DEADLINES, PLAN, PRIMARY, TEMPLATE, WINDOW, access, longs, primaries, reached, tails, templates, traced
from wayfold.plans.search import BY, ROUNDS, purewalk
from wayfold.sources.network import DRAWS


# alternatives of the planned semantic


@query("k12_planned_window", f"""{PLAN}, {TEMPLATE}, {PRIMARY}, kr AS (SELECT a.cell_id, t.route, x.shape, CAST(ceil((t.tail_s+a.walk_s)/60.0) AS BIGINT) AS minutes, a.stop_id, CAST(ceil(raw_s/60.0) AS BIGINT) AS base FROM tn_access a JOIN tp t ON t.stop_id=a.stop_id JOIN ta x ON x.stop_id=t.stop_id AND x.deadline_s=t.deadline_s JOIN pv ON pv.cell_id=a.cell_id WHERE x.rides>0),
    ks AS (SELECT * FROM kr WHERE minutes<75 AND minutes<=base+{WINDOW // 60} QUALIFY row_number() OVER (PARTITION BY cell_id, shape ORDER BY minutes, stop_id)=1)
    SELECT cell_id, route, minutes, stop_id FROM ks QUALIFY row_number() OVER (PARTITION BY cell_id, route ORDER BY minutes, shape)=1""")
def _(n):
    """Routes within ten minutes of the planned minute, by the same templates as that minute; where walking wins, too."""
    template, base = templates(n, reached(n), tails(n)), primaries(n)
    return planned.planned_window(access(n), template, tails(n), base, WINDOW // 60)


# the ride that is committed to


@query("k10_committed_rides", f"""{PLAN}, {TEMPLATE}, {PRIMARY}, rr AS (SELECT deadline_s, origin, leg, pattern_id, bpos, apos, arrive-dep_s>=120 AS whole FROM ad WHERE kind='ride'),
    rf AS (SELECT deadline_s, origin, arg_min(struct_pack(p:=pattern_id, b:=bpos, a:=apos), leg) AS f, arg_min(struct_pack(p:=pattern_id, b:=bpos, a:=apos), leg) FILTER (whole) AS w FROM rr GROUP BY ALL),
    ch AS (SELECT 'best' AS via, p.cell_id, p.stop_id, t.deadline_s FROM pv p JOIN tp t ON t.stop_id=p.stop_id UNION ALL SELECT * FROM (SELECT 'nearest', a.cell_id, a.stop_id, t.deadline_s FROM tn_access a JOIN tp t ON t.stop_id=a.stop_id QUALIFY row_number() OVER (PARTITION BY a.cell_id ORDER BY a.walk_s, a.stop_id)=1) q)
    SELECT via, cell_id, ch.stop_id, CAST(f.p AS BIGINT) AS pattern_id, CAST(f.b AS BIGINT) AS bpos, CAST(f.a AS BIGINT) AS apos, CAST(w.p AS BIGINT) AS folded_pattern, w IS NULL OR f<>w AS tiny FROM ch JOIN rf ON rf.deadline_s=ch.deadline_s AND rf.origin=ch.stop_id""")
def _(n):
    """The first ride of each cell's plan, by its best stop and by its nearest one. Rides under two minutes count in the planned display; folded_pattern is the first ride where they don't."""
    template = templates(n, reached(n), tails(n))
    first = settle(planned.committed_rides(traced(n, DEADLINES)[1], n.stop_time, n.egress), "committed-rides")
    best = primaries(n).where("stop_id is not null").select("cell_id", "stop_id")
    nearest = access(n).join(template.select("stop_id"), "stop_id").groupBy("cell_id").agg(F.min(F.struct("walk_to_s", "stop_id")).alias("x")).select("cell_id", "x.stop_id")
    chosen = best.withColumn("via", F.lit("best")).unionByName(nearest.withColumn("via", F.lit("nearest"))).join(template.select("stop_id", "deadline_s"), "stop_id")
    rows = chosen.join(first, ["stop_id", "deadline_s"])
    return longs(rows, "via", "cell_id", "stop_id", "pattern_id", "bpos", "apos", "folded_pattern", "tiny")


# reliability of arriving by


_BY_BEST = f"ab AS MATERIALIZED (SELECT a.cell_id, a.stop_id, v-a.walk_s AS home_s, a.walk_s, ceil(({BY}-v+a.walk_s)/60.0) AS m FROM tn_access a JOIN tb{ROUNDS} b ON b.stop_id=a.stop_id AND b.deadline_s={BY} QUALIFY row_number() OVER (PARTITION BY a.cell_id ORDER BY v-a.walk_s DESC, a.stop_id)=1)"
_BY_COMMITS = f"SELECT ab.cell_id, ab.home_s, ab.walk_s+fr.foot_s AS walk_s, fr.pattern_id, fr.bpos, fr.apos FROM ab JOIN fr ON fr.deadline_s={BY} AND fr.origin=ab.stop_id LEFT JOIN pw ON pw.cell_id=ab.cell_id WHERE m<75 AND coalesce(walk_only_s>={BY}-home_s, true)"


@query("m10_arrive_by_overlay", f"{MC}, {_BY_BEST}, {score_sql(_BY_COMMITS, 'cell_id')}, {published_sql('SELECT cm.cell_id, CAST(m AS BIGINT) AS perfect FROM cm JOIN ab ON ab.cell_id=cm.cell_id', 'cell_id')} SELECT cell_id, perfect, real, frag, spread, stuck FROM sm")
def _(n):
    """Arriving by the deadline: the headline is the committed median, and a bad day adds what lies between it and the ninth decile. Cells where walking is quicker have no overlay."""
    plan = _plan(n)
    found = traced(n, DEADLINES)[0].where(F.col("deadline_s") == BY).select("stop_id", "v")
    home = F.max(F.struct((F.col("v") - F.col("walk_to_s")).alias("home"), (-F.col("stop_id")).alias("s"))).alias("x")
    best = access(n).join(found, "stop_id").groupBy("cell_id").agg(home).join(purewalk(n), "cell_id", "left")
    best = best.where(F.coalesce(F.col("walk_only_s") >= BY - F.col("x.home"), F.lit(True))).withColumn("perfect", F.ceil((BY - F.col("x.home")) / 60).cast("long")).where("perfect < 75")
    best = settle(best.select("cell_id", (-F.col("x.s")).alias("stop_id"), "x.home", "perfect"), "best-by")
    chosen = best.select("cell_id", "stop_id", F.lit(BY).cast("long").alias("deadline_s")).join(found.withColumnRenamed("v", "board_s"), "stop_id")
    commits = settle(planned.commits(chosen, access(n), plan.first, ("cell_id",)), "commits-by")
    floors = commits.select("cell_id").join(best.select("cell_id", "perfect"), "cell_id")
    shown = reliability.published(plan.replayed(commits, ("cell_id",)), floors, ["cell_id"], DRAWS)
    return floors.join(shown, "cell_id").select("cell_id", "perfect", "real", "frag", "spread", "stuck")


# alternatives that count reliability


def _x(sql: str) -> str:
    """Names of the closure that the Monte-Carlo part has already."""
    return re.sub(r"\bsc\b", "sx", sql)


_SHAPE_COMMITS = "SELECT cell_id, shape, board_s-walk_to_s AS home_s, walk_to_s+foot_s AS walk_s, pattern_id, bpos, CAST(regexp_extract(seg,'-([0-9]+)$',1) AS BIGINT) AS apos FROM cl"
_FRAG = f"""{score_sql(_SHAPE_COMMITS, 'cell_id, shape')}, {published_sql('SELECT cell_id, shape, CAST(ceil(total_s/60.0) AS BIGINT) AS perfect FROM cl', 'cell_id, shape')}, fg AS MATERIALIZED (SELECT cell_id, shape, real, greatest(p90-perfect,0) AS frag FROM sm)"""
_ORDER = "b.walk_s<=a.walk_s", "b.walk_s<a.walk_s"
RELIABLE = f"{MC}, {_x(CLOSURE)}, {_FRAG}, " + PRUNED.replace(OPTIONS, OPTIONS.replace("SELECT *, CAST(ceil(total_s/60.0) AS BIGINT) AS minutes, 0 AS frag_min FROM oq", "SELECT oq.*, CAST(ceil(total_s/60.0) AS BIGINT) AS minutes, coalesce(fg.frag,0) AS frag_min, coalesce(fg.real,CAST(ceil(total_s/60.0) AS BIGINT)) AS real FROM oq LEFT JOIN fg USING (cell_id, shape)")).replace(_ORDER[0], f"{_ORDER[0]} AND b.frag_min<=a.frag_min").replace(_ORDER[1], f"{_ORDER[1]} OR b.frag_min<a.frag_min")


def reliable(n):
    """Described options with what a bad day adds (frag_min) and the typical minute (real), pruned; written."""
    return baked(n, ("reliable",), lambda: _reliable(n))


def _reliable(n):
    rows, base = closed(n)
    frag = fragility(n, rows, lambda _: F.greatest(F.col("p90") - F.col("perfect"), F.lit(0)))
    return counted(n, rows, base, frag)


def fragility(n, rows, added):
    """(cell_id, shape, real, frag) of branches, written: what their own draws say of each, joined by shape, never by position."""
    plan = _plan(n)
    apos = F.regexp_extract("seg", "-([0-9]+)$", 1).cast("long")
    commits = rows.select("cell_id", "shape", (F.col("board_s") - F.col("walk_to_s")).alias("home_s"), (F.col("walk_to_s") + F.col("foot_s")).alias("walk_s"), "pattern_id", "bpos", apos.alias("apos"))
    floors = rows.select("cell_id", "shape", F.ceil(F.col("total_s") / 60).cast("long").alias("perfect"))
    minutes = reliability.replayed_once(commits, plan.times, plan.retained, ("cell_id", "shape"))
    shown = reliability.published(minutes, floors, ["cell_id", "shape"], DRAWS).join(floors, ["cell_id", "shape"])
    return settle(shown.select("cell_id", "shape", "real", added(shown).cast("long").alias("frag")), "fragility")


def counted(n, rows, base, frag):
    """Described options with frag_min and real, pruned; written."""
    options = selection.described(selection.options(rows, base, frag), n.pattern_stop, n.stop, n.line)
    options = options.join(frag.select("cell_id", "shape", "real"), ["cell_id", "shape"], "left").withColumn("real", F.coalesce("real", "minutes"))
    return settle(selection.pruned(settle(options, "options-frag")), "reliable")


ALTERNATIVE = ("cell_id", "slot", "shape", "route", "family", "branch", "minutes", "real", "frag_min", "transfers", "walk_s")
_SLOTS = "SELECT cell_id, {slot} AS slot, shape, route, family, branch, minutes, CAST(real AS BIGINT) AS real, CAST(frag_min AS BIGINT) AS frag_min, CAST(transfers AS BIGINT) AS transfers, CAST(walk_s AS BIGINT) AS walk_s"
_ALTS = f"{_SLOTS.format(slot='CAST(0 AS BIGINT)')} FROM up WHERE main UNION ALL {_SLOTS.format(slot='slot')} FROM tz"


def alternatives(rows):
    """The primary, slot 0, and up to six alternatives of every cell."""
    slots = selection.select(rows, 6).unionByName(rows.where("primary").select("cell_id", "shape", F.lit(0).cast("long").alias("slot")))
    return slots.join(rows, ["cell_id", "shape"])


@query("n10_reliable_alternatives", f"{RELIABLE}, {selected_sql(6, False)} {_ALTS}")
def _(n):
    """Alternatives ranked, pruned and chosen with their own fragility, each joined to its draws by its shape, never by position."""
    return alternatives(reliable(n)).select(*ALTERNATIVE)


_RANK = "walk_s, transfers, frag_min, total_s, dep_neg, shape"


@query("n09_recommended_choices", f"""{RELIABLE}, {selected_sql(6, False)}, nr AS (SELECT * FROM up WHERE main UNION ALL SELECT u.* FROM up u JOIN tz USING (cell_id, shape)),
    nk AS (SELECT *, concat('choice:{{{{"direction":"',CASE WHEN hx IS NULL THEN '' ELSE concat('h',CAST(round_even(round(CASE WHEN atan2(hx,hy)<0 THEN atan2(hx,hy)+2*pi() ELSE atan2(hx,hy) END/(pi()/4),9),0) AS BIGINT)%8) END,'","lines":[',CASE WHEN seg IS NULL THEN '' ELSE concat('"',replace(route,' > ','","'),'"') END,'],"branch":"',branch,'"}}}}') AS choice_key FROM nr)
    SELECT cell_id, arg_min(choice_key, shape) FILTER (main) AS map_choice_key, max(r) AS typical_choice_key, max(b) AS scheduled_choice_key FROM (SELECT *, first_value(choice_key) OVER (PARTITION BY cell_id ORDER BY minutes+frag_min, {_RANK}) AS r, first_value(choice_key) OVER (PARTITION BY cell_id ORDER BY minutes, {_RANK}) AS b FROM nk) q GROUP BY cell_id""".replace("{{", "{").replace("}}", "}"))
def _(n):
    """What a cell's list recommends, by public key: the choice on the map, and the practical one if delays count and if they don't."""
    return selection.recommended(alternatives(reliable(n)))


BY_WINDOW_MIN = 5
_BY_CLOSED = f"""by0 AS MATERIALIZED (SELECT a.cell_id, shape, route, seg, last_seg, {BY}-v+a.walk_s AS total_s, a.walk_s+foot_s AS access_s, rides-1 AS transfers, hop_s, out_s, ride_s, ride_dep_s AS dep_s, a.stop_id, v AS board_s, foot_s, a.walk_s AS walk_to_s, pattern_id, bpos FROM tn_access a JOIN ta ON ta.stop_id=a.stop_id AND ta.deadline_s={BY} WHERE rides>0
        QUALIFY row_number() OVER (PARTITION BY a.cell_id, shape ORDER BY {BY}-v+a.walk_s, a.walk_s+foot_s, a.stop_id)=1), by1 AS (SELECT * FROM by0 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY total_s, access_s, stop_id)=1),
    pz AS MATERIALIZED (SELECT cell_id, CASE WHEN w THEN walk_only_s ELSE total_s END AS raw_s, CASE WHEN NOT w THEN stop_id END AS stop_id FROM (SELECT coalesce(b.cell_id, p.cell_id) AS cell_id, total_s, stop_id, walk_only_s, walk_only_s IS NOT NULL AND (total_s IS NULL OR walk_only_s<total_s) AS w FROM by1 b FULL JOIN pw p ON p.cell_id=b.cell_id) q),
    cl AS MATERIALIZED (SELECT b.* FROM by0 b JOIN pz ON pz.cell_id=b.cell_id WHERE ceil(total_s/60.0)<75 AND ceil(total_s/60.0)<=ceil(raw_s/60.0)+{BY_WINDOW_MIN})"""
RELIABLE_BY = RELIABLE.replace(_x(CLOSURE), _BY_CLOSED).replace("FROM pv WHERE stop_id IS NULL", "FROM pz WHERE stop_id IS NULL").replace("real, greatest(p90-perfect,0) AS frag FROM sm", "real, frag FROM sm")


@query("n10_arrive_by_alternatives", f"{RELIABLE_BY}, {selected_sql(6, False)} {_ALTS}")
def _(n):
    """The same for arriving by the deadline: branches within five minutes of the primary; a bad day adds what lies between the median of a branch and its ninth decile."""
    tail = tails(n).where(F.col("deadline_s") == BY).drop("deadline_s")
    rows, base = planned.branches_by(access(n), tail, purewalk(n), BY, BY_WINDOW_MIN)
    rows, base = settle(rows, "branches-by"), settle(base, "primary-by")
    return alternatives(counted(n, rows, base, fragility(n, rows, lambda _: F.col("frag")))).select(*ALTERNATIVE)
