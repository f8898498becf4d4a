"""Queries of traced searches, planned journeys, their branches and alternatives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.operators import assemble, journeys, planned, search, spatial
from wayfold.operators.rounds import settle
from wayfold.plans.base import baked, query
from wayfold.plans.search import ARRIVAL, BY, DEADLINES, DEP_ROWS, DEPARTURES, PROFILE, PURE, ROUNDS, SEED_ALL, SEED_ONE, arrivals, profile, purewalk, search_sql

VIA = "kind, to_stop, to_rd, to_layer, pattern_id, trip_id, bpos, apos, dep_s, arr_s"
NONE = "CAST(NULL AS BIGINT)"


def traced_sql(seed: str, rounds: int = ROUNDS) -> str:
    """CTEs of the traced search, unrolled: tb{rounds} holds the labels, hi every improvement, lg the legs."""
    all_ = f"deadline_s, stop_id, v, {VIA}, rd"
    strict = lambda a, b: f"SELECT a.* FROM {a} a LEFT JOIN {b} b ON b.deadline_s=a.deadline_s AND b.stop_id=a.stop_id WHERE b.v IS NULL OR a.v>b.v"
    over = lambda a, b: f"SELECT {all_} FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE b.deadline_s=a.deadline_s AND b.stop_id=a.stop_id) UNION ALL SELECT {all_} FROM {b}"
    foot = lambda a, k: f"""SELECT f.deadline_s, t.from_id AS stop_id, f.v-t.walk_s AS v, 'foot' AS kind, f.stop_id AS to_stop, {k} AS to_rd, 0 AS to_layer, {NONE} AS pattern_id, {NONE} AS trip_id, {NONE} AS bpos, {NONE} AS apos, {NONE} AS dep_s, {NONE} AS arr_s, {k} AS rd
        FROM {a} f JOIN tn_transfer t ON t.to_id=f.stop_id QUALIFY row_number() OVER (PARTITION BY f.deadline_s, t.from_id ORDER BY f.v-t.walk_s DESC, f.stop_id)=1"""  # noqa: E731
    out = [
        f"te AS MATERIALIZED (SELECT deadline_s, stop_id, v, 'egress' AS kind, {NONE} AS to_stop, {NONE} AS to_rd, {NONE} AS to_layer, {NONE} AS pattern_id, {NONE} AS trip_id, {NONE} AS bpos, {NONE} AS apos, v AS dep_s, {NONE} AS arr_s, 0 AS rd FROM (SELECT deadline_s, stop_id, max(v) AS v FROM ({seed}) s GROUP BY ALL) g)",
        f"th AS MATERIALIZED ({foot('te', 0)})",
        f"tw0 AS MATERIALIZED ({strict('th', 'te')})",
        f"tb0 AS MATERIALIZED ({over('te', 'tw0')})",
        "tf0 AS MATERIALIZED (SELECT * FROM tb0)",
    ]
    for r in range(1, rounds + 1):
        p = r - 1
        out += [
            f"""tt{r} AS MATERIALIZED (SELECT f.deadline_s, x.pattern_id, x.trip_id, x.pos AS apos, x.arr_s, x.stop_id AS to_stop, CASE WHEN f.kind='foot' THEN 1 ELSE 0 END AS to_layer, f.rd AS to_rd
                FROM tf{p} f JOIN tn_stop_time x ON x.stop_id=f.stop_id AND x.arr_s<=f.v-60 QUALIFY row_number() OVER (PARTITION BY f.deadline_s, x.pattern_id, x.trip_id ORDER BY x.pos DESC)=1)""",
            f"""tc{r} AS MATERIALIZED (SELECT t.deadline_s, y.stop_id, y.dep_s AS v, 'ride' AS kind, t.to_stop, t.to_rd, t.to_layer, t.pattern_id, t.trip_id, y.pos AS bpos, t.apos, y.dep_s, t.arr_s, {r} AS rd
                FROM tt{r} t JOIN tn_stop_time y ON y.pattern_id=t.pattern_id AND y.trip_id=t.trip_id AND y.pos<t.apos QUALIFY row_number() OVER (PARTITION BY t.deadline_s, y.stop_id ORDER BY y.dep_s DESC, t.pattern_id, y.pos DESC, t.trip_id)=1)""",
            f"tn{r} AS MATERIALIZED ({strict(f'tc{r}', f'tb{p}')})",
            f"tm{r} AS MATERIALIZED ({over(f'tb{p}', f'tn{r}')})",
            f"tg{r} AS MATERIALIZED ({foot(f'tn{r}', r)})",
            f"tw{r} AS MATERIALIZED ({strict(f'tg{r}', f'tm{r}')})",
            f"tf{r} AS MATERIALIZED ({over(f'tn{r}', f'tw{r}')})",
            f"tb{r} AS MATERIALIZED ({over(f'tb{p}', f'tf{r}')})",
        ]
    every = " UNION ALL ".join([f"SELECT {all_}, 0 AS layer FROM te", f"SELECT {all_}, 1 AS layer FROM tw0"] + [f"SELECT {all_}, {layer} AS layer FROM {t}{r}" for r in range(1, rounds + 1) for t, layer in (("tn", 0), ("tw", 1))])
    out += [
        f"hi AS MATERIALIZED ({every})",
        f"""lg AS (SELECT h.deadline_s, b.stop_id AS origin, 0 AS leg, h.* EXCLUDE (deadline_s) FROM tb{rounds} b JOIN hi h ON h.deadline_s=b.deadline_s AND h.stop_id=b.stop_id AND h.rd=b.rd AND h.layer=CASE WHEN b.kind='foot' THEN 1 ELSE 0 END
            UNION ALL SELECT h.deadline_s, g.origin, g.leg+1, h.* EXCLUDE (deadline_s) FROM lg g JOIN hi h ON h.deadline_s=g.deadline_s AND h.stop_id=g.to_stop AND h.rd=g.to_rd AND h.layer=g.to_layer)""",
    ]
    return ",\n".join(out)


TRACED_ONE, TRACED_ALL = f"WITH RECURSIVE {traced_sql(SEED_ONE)}", f"WITH RECURSIVE {traced_sql(SEED_ALL)}"
TAILS = """nx AS MATERIALIZED (SELECT *, lead(kind) OVER j AS next_kind, CASE kind WHEN 'foot' THEN lead(v) OVER j-v WHEN 'egress' THEN deadline_s-v ELSE 0 END AS w, max(CASE WHEN kind='ride' THEN leg END) OVER (PARTITION BY deadline_s, origin) AS last_ride, min(CASE WHEN kind='ride' THEN leg END) OVER (PARTITION BY deadline_s, origin) AS first_ride FROM lg WINDOW j AS (PARTITION BY deadline_s, origin ORDER BY leg)),
    al AS MATERIALIZED (SELECT x.deadline_s, x.origin, x.leg, s.arr_s AS at_s, s.pos AS at_pos, e.walk_s AS out_s FROM nx x JOIN tn_stop_time s ON s.pattern_id=x.pattern_id AND s.trip_id=x.trip_id AND s.pos>x.bpos JOIN tn_egress e ON e.stop_id=s.stop_id WHERE x.kind='ride' AND x.next_kind='egress'
        QUALIFY row_number() OVER (PARTITION BY x.deadline_s, x.origin, x.leg ORDER BY s.arr_s+e.walk_s, e.walk_s, s.pos DESC)=1),
    ad AS (SELECT x.*, a.at_s, a.out_s AS shorter, coalesce(a.at_s, x.arr_s) AS arrive, l.line_name, concat(x.pattern_id,':',x.bpos,'-',coalesce(a.at_pos,x.apos)) AS seg FROM nx x LEFT JOIN al a ON a.deadline_s=x.deadline_s AND a.origin=x.origin AND a.leg=x.leg LEFT JOIN tn_line l ON l.pattern_id=x.pattern_id),
    ta AS MATERIALIZED (SELECT deadline_s, stop_id, v, rides, arrived+out_s AS finish_s, before_s+out_s AS walk_s, route, dominant, shape, pattern_id, trip_id, bpos, ride_dep_s, seg, last_seg, foot_s, before_s-foot_s AS hop_s, out_s, ride_s, depth FROM (SELECT deadline_s, origin AS stop_id, arg_min(v, leg) AS v, count(*) FILTER (kind='ride') AS rides, max(CASE WHEN leg=last_ride THEN arrive END) AS arrived,
        coalesce(max(shorter), sum(CASE WHEN leg>coalesce(last_ride,-1) THEN w ELSE 0 END)) AS out_s, sum(CASE WHEN leg>coalesce(last_ride,-1) THEN 0 ELSE w END) AS before_s, coalesce(string_agg(line_name, ' > ' ORDER BY leg) FILTER (kind='ride'),'') AS route,
        arg_min(line_name, (dep_s-arrive, line_name)) FILTER (kind='ride' AND arrive-dep_s>=120) AS dominant,
        coalesce(string_agg(seg, '>' ORDER BY leg) FILTER (kind='ride'),'') AS shape, sum(CASE WHEN leg<first_ride THEN w ELSE 0 END) AS foot_s, sum(CASE WHEN kind='ride' THEN arrive-dep_s ELSE 0 END) AS ride_s, count(*) FILTER (kind='ride' AND arrive-dep_s>=120) AS depth,
        max(CASE WHEN leg=first_ride THEN pattern_id END) AS pattern_id, max(CASE WHEN leg=first_ride THEN trip_id END) AS trip_id, max(CASE WHEN leg=first_ride THEN bpos END) AS bpos,
        max(CASE WHEN leg=first_ride THEN dep_s END) AS ride_dep_s, max(CASE WHEN leg=first_ride THEN seg END) AS seg, max(CASE WHEN leg=last_ride THEN seg END) AS last_seg FROM ad GROUP BY deadline_s, origin) q)"""
PLAN = f"{TRACED_ALL}, {search_sql(SEED_ALL)}, {PROFILE}, {ARRIVAL}, {PURE}, {TAILS}"
ANCHOR = f"an AS (SELECT stop_id, dep_s, arr_w_s AS deadline_s FROM ar WHERE dep_s BETWEEN {DEPARTURES[0]} AND {DEPARTURES[-1]} QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY arr_w_s-dep_s, dep_s DESC)=1)"
TEMPLATE = f"""{ANCHOR}, tp AS MATERIALIZED (SELECT stop_id, board_s, deadline_s, board_s<>dep_s AS reanchored, CASE WHEN rides>0 THEN finish_s-board_s ELSE walk_s END AS tail_s, walk_s, rides, route
    FROM (SELECT an.*, v, rides, finish_s, walk_s, route, CASE WHEN an.dep_s<=v THEN an.dep_s WHEN v>={DEPARTURES[0]} THEN v END AS board_s FROM an JOIN ta ON ta.stop_id=an.stop_id AND ta.deadline_s=an.deadline_s) q WHERE board_s IS NOT NULL)"""
PRIMARY = """pv AS MATERIALIZED (SELECT cell_id, raw_s, board_s, CASE WHEN stop_id>=0 THEN stop_id END AS stop_id FROM (SELECT a.cell_id, tail_s+a.walk_s AS raw_s, a.walk_s AS access_s, board_s, a.stop_id FROM tn_access a JOIN tp ON tp.stop_id=a.stop_id UNION ALL SELECT cell_id, walk_only_s, -1, NULL, -1 FROM pw) o
    QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY raw_s, access_s, board_s DESC, stop_id)=1)"""
PROBES = f"pb AS MATERIALIZED (SELECT ar.stop_id, ar.dep_s, ar.arr_w_s AS deadline_s, ar.dep_s<=ta.v AS ok FROM ar JOIN ta ON ta.stop_id=ar.stop_id AND ta.deadline_s=ar.arr_w_s WHERE ar.dep_s BETWEEN {DEPARTURES[0]} AND {DEPARTURES[-1]})"
WINDOW = 600
BRANCHES = f"""{PROBES}, sb AS MATERIALIZED (SELECT p.stop_id, route, finish_s-p.dep_s AS tail_s, p.dep_s AS board_s, p.deadline_s, walk_s, rides FROM pb p JOIN ta ON ta.stop_id=p.stop_id AND ta.deadline_s=p.deadline_s WHERE ok AND rides>0 QUALIFY row_number() OVER (PARTITION BY p.stop_id, route ORDER BY finish_s-p.dep_s, p.dep_s DESC, p.deadline_s)=1),
    br AS MATERIALIZED (SELECT a.cell_id, route, tail_s+a.walk_s AS total_s, a.stop_id, sb.board_s, deadline_s, sb.walk_s+a.walk_s AS walk_s, rides-1 AS transfers FROM tn_access a JOIN sb ON sb.stop_id=a.stop_id JOIN pv ON pv.cell_id=a.cell_id
        WHERE ceil((tail_s+a.walk_s)/60.0)<=ceil(raw_s/60.0)+{WINDOW // 60} AND tail_s+a.walk_s<4500 QUALIFY row_number() OVER (PARTITION BY a.cell_id, route ORDER BY tail_s+a.walk_s, a.walk_s, sb.board_s DESC, a.stop_id)=1)"""


def traced(n, deadlines):
    """Labels and legs, both written: everything below reads them more than once."""

    def build():
        found, history = search.traced_search(n.stop_time, n.footpaths, search.seed(n.egress, deadlines), rounds=ROUNDS)
        return found, settle(search.trace(found, history, rounds=ROUNDS), "legs")

    return baked(n, ("traced", *deadlines), build)


def tails(n, deadlines=DEADLINES):
    return baked(n, ("tails", *deadlines), lambda: settle(planned.tails(traced(n, deadlines)[1], n.stop_time, n.egress, n.line), "tails"))


def access(n):
    return n.access.withColumnRenamed("walk_s", "walk_to_s")


def reached(n):
    return baked(n, ("arrivals",), lambda: settle(arrivals(n), "arrivals"))


def templates(n, arrived, tail):
    return baked(n, ("templates",), lambda: settle(planned.templates(assemble.stop_anchor(arrived, DEPARTURES), tail, DEPARTURES[0]), "templates"))


def longs(df, *columns):
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.select(*columns).dtypes))


@query("r03_traced_search", f"{TRACED_ONE} SELECT CAST(deadline_s AS BIGINT) AS deadline_s, stop_id, CAST(v AS BIGINT) AS v, CAST(rd AS BIGINT) AS rides, kind, to_stop FROM tb{ROUNDS}")
def _(n):
    found, _ = search.traced_search(n.stop_time, n.footpaths, search.seed(n.egress, [BY]), rounds=ROUNDS)
    return found.select("deadline_s", "stop_id", "v", F.col("rides").cast("long").alias("rides"), F.col("via.kind").alias("kind"), F.col("via.to_stop").alias("to_stop"))


LEG = ("deadline_s", "origin", "leg", "kind", "from_stop", "to_stop", "v", "dep_s", "arr_s", "pattern_id", "trip_id", "bpos", "apos")


@query("k02_trace_legs", f"{TRACED_ONE} SELECT " + ", ".join("kind" if c == "kind" else f"CAST({'stop_id' if c == 'from_stop' else c} AS BIGINT) AS {c}" for c in LEG) + " FROM lg")
def _(n):
    return longs(traced(n, [BY])[1], *LEG)


@query("a17_dominant_line", f"{TRACED_ONE}, {TAILS} SELECT stop_id, CAST(rides AS BIGINT) AS rides, dominant FROM ta")
def _(n):
    return tails(n, [BY]).select("stop_id", F.col("rides").cast("long").alias("rides"), "dominant")


@query("k11_line_alternatives", f"""{TRACED_ONE}, {TAILS}, m AS (SELECT a.cell_id, dominant AS line_name, CAST(ceil((deadline_s-v+a.walk_s)/60.0) AS BIGINT) AS minutes, a.stop_id FROM tn_access a JOIN ta ON ta.stop_id=a.stop_id WHERE dominant IS NOT NULL),
    b AS (SELECT * FROM m WHERE minutes<75 QUALIFY row_number() OVER (PARTITION BY cell_id, line_name ORDER BY minutes, stop_id)=1) SELECT cell_id, line_name, minutes, stop_id FROM b QUALIFY minutes<=min(minutes) OVER (PARTITION BY cell_id)+5""")
def _(n):
    return planned.line_alternatives(access(n), tails(n, [BY]), 5)


@query("k09_ride_geometry", f"""{TRACED_ONE} SELECT CAST(g.deadline_s AS BIGINT) AS deadline_s, g.origin, CAST(g.leg AS BIGINT) AS leg, l.line_name, arg_min(p.stop_id, p.pos) AS board, arg_max(p.stop_id, p.pos) AS alight, any_value(z.stop_id) AS toward, string_agg(concat(CAST(s.x_m AS VARCHAR),' ',CAST(s.y_m AS VARCHAR)), ',' ORDER BY p.pos) AS points
    FROM lg g JOIN tn_pattern_stop p ON p.pattern_id=g.pattern_id AND p.pos BETWEEN g.bpos AND g.apos JOIN tn_stop s ON s.stop_id=p.stop_id JOIN tn_line l ON l.pattern_id=g.pattern_id JOIN (SELECT pattern_id, arg_max(stop_id, pos) AS stop_id FROM tn_pattern_stop GROUP BY pattern_id) z ON z.pattern_id=g.pattern_id WHERE g.kind='ride' GROUP BY g.deadline_s, g.origin, g.leg, l.line_name""")
def _(n):
    return planned.ride_geometry(traced(n, [BY])[1], n.pattern_stop, n.stop, n.line)


@query("r13_stop_templates", f"{PLAN}, {TEMPLATE} SELECT stop_id, CAST(board_s AS BIGINT) AS board_s, CAST(deadline_s AS BIGINT) AS deadline_s, reanchored, CAST(tail_s AS BIGINT) AS tail_s, CAST(walk_s AS BIGINT) AS walk_s, CAST(rides AS BIGINT) AS rides, route FROM tp")
def _(n):
    return longs(templates(n, reached(n), tails(n)), "stop_id", "board_s", "deadline_s", "reanchored", "tail_s", "walk_s", "rides", "route")


@query("r12_primary_selection", f"{PLAN}, {TEMPLATE}, {PRIMARY} SELECT cell_id, CAST(raw_s AS BIGINT) AS raw_s, CAST(board_s AS BIGINT) AS board_s, stop_id FROM pv")
def _(n):
    return primaries(n)


@query("k15_probe_collapse", f"{PLAN}, {PROBES} SELECT stop_id, CAST(dep_s AS BIGINT) AS dep_s, CAST(deadline_s AS BIGINT) AS deadline_s, ok FROM pb")
def _(n):
    return planned.probes(reached(n), tails(n), DEPARTURES)


def primaries(n):
    return baked(n, ("primaries",), lambda: settle(planned.primary(access(n), templates(n, reached(n), tails(n)), purewalk(n)), "primary"))


def branched(n):
    """Branches of every cell, its primary, and the tails they come from."""
    arrived, tail, base = reached(n), tails(n), primaries(n)
    by_stop = settle(planned.stop_branches(planned.probes(arrived, tail, DEPARTURES), tail), "stop-branches")
    return planned.branches(access(n), by_stop, base, WINDOW), base


BRANCH = ("cell_id", "route", "total_s", "stop_id", "board_s", "deadline_s", "walk_s", "transfers")


@query("k13_branches", f"{PLAN}, {TEMPLATE}, {PRIMARY}, {BRANCHES} SELECT " + ", ".join(c if c == "route" else f"CAST({c} AS BIGINT) AS {c}" for c in BRANCH) + " FROM br")
def _(n):
    return longs(branched(n)[0], *BRANCH)


@query("k16_coverage", f"{PLAN}, {TEMPLATE}, {PRIMARY} SELECT a.cell_id, a.stop_id FROM tn_access a JOIN tp ON tp.stop_id=a.stop_id JOIN pv ON pv.cell_id=a.cell_id WHERE ceil((tail_s+a.walk_s)/60.0)<=ceil(raw_s/60.0)+{WINDOW // 60} AND tail_s+a.walk_s<4500")
def _(n):
    template = templates(n, reached(n), tails(n))
    return planned.coverage(access(n), template, planned.primary(access(n), template, purewalk(n)), WINDOW)


@query("k16_station_closure", """WITH f AS MATERIALIZED (SELECT cell_id, stop_id FROM tn_access QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY walk_s, stop_id)<=2)
    SELECT cell_id, stop_id FROM f UNION SELECT a.cell_id, a.stop_id FROM f JOIN tn_stop s ON s.stop_id=f.stop_id JOIN tn_stop o ON (s.x_m-o.x_m)*(s.x_m-o.x_m)+(s.y_m-o.y_m)*(s.y_m-o.y_m)<=90000 JOIN tn_access a ON a.cell_id=f.cell_id AND a.stop_id=o.stop_id""")
def _(n):
    """By places: stops on one point are in a closure together, and cells on one point have the same."""
    r = n.reach
    own = settle(r.pairs.select(F.col("from_at").alias("cell_id"), F.col("to_at").alias("stop_id"), "walk_s"), "access")
    few = r.tos.withColumn("k", F.row_number().over(Window.partitionBy("to_at").orderBy("stop_id"))).where("k <= 2").select(F.col("to_at").alias("stop_id"), F.col("stop_id").alias("seed_id"))
    first = Window.partitionBy("cell_id").orderBy("walk_s", "seed_id")
    seeds = own.join(few, "stop_id").withColumn("k", F.row_number().over(first)).where("k <= 2").select("cell_id", "stop_id").distinct()
    places = n.stop.join(r.tos.where("stop_id = to_at"), "stop_id", "left_semi")
    near = spatial.euclid_join(places, places, 300, "stop_id", "stop_id", ("stop_id", "other_id"))
    found = planned.station_closure(own, seeds, near.select("stop_id", "other_id"))
    return r.rows(found.select(F.col("cell_id").alias("from_at"), F.col("stop_id").alias("to_at"))).select("cell_id", "stop_id")


ASSEMBLED = """rk AS MATERIALIZED (SELECT *, CAST(ceil(total_s/60.0) AS BIGINT) AS minutes, row_number() OVER (PARTITION BY cell_id ORDER BY total_s, route) AS k FROM br),
    ok AS (SELECT a.* FROM rk a WHERE k>1 AND NOT EXISTS (SELECT 1 FROM rk b WHERE b.cell_id=a.cell_id AND b.minutes<=a.minutes AND b.walk_s<=a.walk_s AND b.transfers<=a.transfers AND (b.minutes<a.minutes OR b.walk_s<a.walk_s OR b.transfers<a.transfers))),
    aa AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY minutes, walk_s, transfers, route) AS slot FROM ok QUALIFY slot<=6)"""


@query("n10_alternatives", f"{PLAN}, {TEMPLATE}, {PRIMARY}, {BRANCHES}, {ASSEMBLED} SELECT cell_id, CAST(slot AS BIGINT) AS slot, route, minutes, CAST(walk_s AS BIGINT) AS walk_s, CAST(transfers AS BIGINT) AS transfers FROM aa")
def _(n):
    found, base = branched(n)
    return longs(planned.alternatives(settle(found, "branches"), base), "cell_id", "slot", "route", "minutes", "walk_s", "transfers")


@query("n07_hydrated_alternatives", f"""{PLAN}, {TEMPLATE}, {PRIMARY}, {BRANCHES}, {ASSEMBLED}, gm AS (SELECT g.deadline_s, g.origin, string_agg(concat(l.line_name,' ',CAST(b.stop_id AS VARCHAR),'-',CAST(e.stop_id AS VARCHAR)), '; ' ORDER BY g.leg) AS rides FROM lg g JOIN tn_line l ON l.pattern_id=g.pattern_id
    JOIN tn_pattern_stop b ON b.pattern_id=g.pattern_id AND b.pos=g.bpos JOIN tn_pattern_stop e ON e.pattern_id=g.pattern_id AND e.pos=g.apos WHERE g.kind='ride' GROUP BY g.deadline_s, g.origin) SELECT cell_id, CAST(slot AS BIGINT) AS slot, route, rides FROM aa JOIN gm ON gm.deadline_s=aa.deadline_s AND gm.origin=aa.stop_id""")
def _(n):
    legs = traced(n, DEADLINES)[1]
    found, base = branched(n)
    kept = planned.alternatives(settle(found, "branches"), base)
    # geometry only of what was kept, once per stop and deadline
    need = kept.select("deadline_s", F.col("stop_id").alias("origin")).distinct()
    drawn = planned.ride_geometry(legs.join(need, ["deadline_s", "origin"], "left_semi"), n.pattern_stop, n.stop, n.line)
    fact = F.concat("line_name", F.lit(" "), F.col("board").cast("string"), F.lit("-"), F.col("alight").cast("string"))
    facts = drawn.groupBy("deadline_s", "origin").agg(F.sort_array(F.collect_list(F.struct("leg", fact.alias("f")))).alias("x"))
    facts = facts.select("deadline_s", F.col("origin").alias("stop_id"), F.array_join("x.f", "; ").alias("rides"))
    return kept.join(facts, ["deadline_s", "stop_id"]).select("cell_id", "slot", "route", "rides")


DEP_PICK = DEP_ROWS.replace("SELECT a.cell_id, a.walk_s, d,", "SELECT a.cell_id, a.stop_id, a.walk_s, d,").replace("SELECT cell_id, d, round(arr_w_s-d+0.15*walk_s,6) AS score, arr_w_s-d AS tt FROM e", "SELECT cell_id, d, stop_id, arr_w_s, round(arr_w_s-d+0.15*walk_s,6) AS score, arr_w_s-d AS tt FROM e")
DEP_PICK = DEP_PICK.replace("SELECT cell_id, d, score, tt FROM s QUALIFY row_number() OVER (PARTITION BY cell_id, d ORDER BY score, tt)=1", "SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY cell_id, d ORDER BY score, tt, stop_id)=1")
DEP_PICK = DEP_PICK.replace("SELECT c.cell_id, least(75,", "SELECT c.cell_id, dd.d, stop_id, arr_w_s, walk_only_s IS NOT NULL AND (score IS NULL OR round(walk_only_s*1.15,6)<score) AS walked, least(75,")


@query("r06_select_depart_after", f"""WITH {search_sql(SEED_ALL)}, {PROFILE}, {ARRIVAL}, {PURE}, {DEP_PICK}, p AS (SELECT cell_id, v[1+(len(v)-1)*50//100] AS p FROM v)
    SELECT j.cell_id, CAST(m AS BIGINT) AS minutes, CAST(d AS BIGINT) AS dep_s, CAST(CASE WHEN NOT walked THEN arr_w_s END AS BIGINT) AS arr_w_s, CASE WHEN NOT walked THEN stop_id END AS stop_id, walked FROM j JOIN p ON p.cell_id=j.cell_id WHERE m=p AND p<75 QUALIFY row_number() OVER (PARTITION BY j.cell_id ORDER BY d DESC)=1""")
def _(n):
    return assemble.select_depart_after(n.cell, n.access, arrivals(n), purewalk(n), DEPARTURES, 50)


@query("r15_stop_percentile_anchor", f"""WITH {search_sql(SEED_ALL)}, {PROFILE}, {ARRIVAL}, dd AS (SELECT unnest({DEPARTURES!r}) AS d), t AS (SELECT a.cell_id, a.stop_id, d, arr_w_s, least(75, coalesce(ceil((arr_w_s-d)/60.0),75)) AS m FROM tn_access a JOIN dd ON true LEFT JOIN ar ON ar.stop_id=a.stop_id AND ar.dep_s=28800+CAST(ceil((d+a.walk_s-28800)/60.0) AS BIGINT)*60),
    g AS (SELECT cell_id, stop_id, list_sort(list(CAST(m AS BIGINT))) AS v FROM t GROUP BY cell_id, stop_id) SELECT t.cell_id, t.stop_id, CAST(m AS BIGINT) AS minutes, CAST(d AS BIGINT) AS dep_s, CAST(arr_w_s AS BIGINT) AS arr_w_s FROM t JOIN g ON g.cell_id=t.cell_id AND g.stop_id=t.stop_id WHERE m=v[1+(len(v)-1)*50//100] AND m<75 QUALIFY row_number() OVER (PARTITION BY t.cell_id, t.stop_id ORDER BY d DESC)=1""")
def _(n):
    own = settle(n.access.withColumn("shift", F.ceil(F.col("walk_s") / 60).cast("long")), "access")
    anchors = assemble.stop_percentile_anchor(own.select("stop_id", "shift").distinct(), arrivals(n), DEPARTURES, 50)
    return own.join(anchors, ["stop_id", "shift"]).select("cell_id", "stop_id", "minutes", "dep_s", "arr_w_s")


TARGET = "t AS (SELECT journey, sum(dur_s+wait_s)+(journey%7-3)*40 AS target_s FROM w GROUP BY journey)"
CLOCKED = """c AS (SELECT *, sum(dur_s) OVER (PARTITION BY journey ORDER BY leg)-dur_s AS before, first_value(dep_s) OVER (PARTITION BY journey ORDER BY leg) AS d0 FROM ch_leg),
    q AS (SELECT *, greatest(d0, max(CASE WHEN kind='ride' THEN dep_s-before END) OVER (PARTITION BY journey ORDER BY leg)) AS base, coalesce(greatest(d0, max(CASE WHEN kind='ride' THEN dep_s-before END) OVER (PARTITION BY journey ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), d0) AS prior FROM c),
    w AS MATERIALIZED (SELECT journey, leg, kind, dur_s, CAST(coalesce(base,d0)-prior AS BIGINT) AS wait_s FROM q)"""


@query("k07_walk_truth", f"""WITH {CLOCKED}, {TARGET}, f AS (SELECT *, min(CASE WHEN kind='ride' THEN leg END) OVER (PARTITION BY journey) AS fr FROM w),
    g AS (SELECT f.*, coalesce(max(CASE WHEN leg=fr THEN wait_s END) OVER j,0) AS fold_s, max(CASE WHEN kind='walk' AND leg<coalesce(fr,1<<30) THEN leg END) OVER j AS near, min(CASE WHEN kind='walk' AND leg<coalesce(fr,1<<30) THEN leg END) OVER j AS front, target_s-sum(dur_s+wait_s) OVER j AS gap FROM f JOIN t USING (journey) WINDOW j AS (PARTITION BY journey)),
    h AS (SELECT *, CASE WHEN gap<0 THEN greatest(fold_s+gap,0) ELSE fold_s END AS fold, greatest(gap,0) AS more FROM g),
    u AS (SELECT journey, leg, kind, dur_s AS physical_s, CASE WHEN leg=near THEN fold ELSE 0 END+CASE WHEN leg=front THEN more ELSE 0 END AS allowance_s, CASE WHEN leg=fr THEN 0 ELSE wait_s END AS wait_s FROM h UNION ALL SELECT journey, 0, 'walk', 0, fold+more, 0 FROM h WHERE near IS NULL AND leg=fr AND fold+more>0)
    SELECT journey, leg, kind, CAST(physical_s+allowance_s AS BIGINT) AS sec, CAST(physical_s AS BIGINT) AS physical_s, CAST(allowance_s AS BIGINT) AS allowance_s, CAST(wait_s AS BIGINT) AS wait_s FROM u""")
def _(n):
    legs = n.view("ch_leg")
    rows = settle(journeys.clocked(legs).select("journey", "leg", "wait_s").join(legs.select("journey", "leg", "kind", "dur_s"), ["journey", "leg"]), "clocked")
    target = rows.groupBy("journey").agg((F.sum(F.col("dur_s") + F.col("wait_s")) + (F.col("journey") % 7 - 3) * 40).alias("target_s"))
    return planned.folded_walks(rows, target)


# what is travelled, from leaving home on

CHAIN = """gc AS MATERIALIZED (SELECT deadline_s, origin AS stop_id, leg, kind, pattern_id, CASE WHEN kind='ride' THEN dep_s END AS dep_s, arrive AS arr_s, w AS walk_s FROM ad WHERE leg<=coalesce(last_ride, leg)
        UNION ALL SELECT a.deadline_s, a.origin, a.last_ride+1, 'egress', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), t.out_s FROM ad a JOIN ta t ON t.deadline_s=a.deadline_s AND t.stop_id=a.origin WHERE a.leg=a.last_ride)"""
FORWARD = """fw AS (SELECT c.cell_id, g.leg, g.kind, g.pattern_id, g.dep_s, g.arr_s, g.walk_s, c.board_s, coalesce(sum(g.walk_s) OVER b, 0) AS walked FROM ch c JOIN gc g ON g.stop_id=c.stop_id AND g.deadline_s=c.deadline_s WINDOW b AS (PARTITION BY c.cell_id ORDER BY g.leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    fx AS (SELECT *, max(CASE WHEN kind='ride' THEN arr_s-walked END) OVER (PARTITION BY cell_id ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead_s FROM fw),
    fz AS (SELECT cell_id, 0 AS leg, CASE WHEN stop_id IS NULL THEN 'walk' ELSE 'access' END AS kind, CAST(NULL AS BIGINT) AS pattern_id, access_s AS sec, 0 AS wait_s FROM ch UNION ALL SELECT cell_id, leg+1, kind, pattern_id, CASE WHEN kind='ride' THEN arr_s-dep_s ELSE walk_s END, CASE WHEN kind='ride' THEN dep_s-coalesce(lead_s+walked, board_s+walked) ELSE 0 END FROM fx)
    SELECT cell_id, CAST(leg AS BIGINT) AS leg, kind, CAST(pattern_id AS BIGINT) AS pattern_id, CAST(sec AS BIGINT) AS sec, CAST(wait_s AS BIGINT) AS wait_s FROM fz"""
LEGS = ("cell_id", "leg", "kind", "pattern_id", "sec", "wait_s")


def travelled(n):
    """Chains behind every label and the templates of every stop, written."""
    legs = traced(n, DEADLINES)[1]
    chain = settle(planned.chain_legs(legs, n.stop_time, n.egress), "chains")
    return chain, templates(n, reached(n), tails(n))


@query("k06_depart_after", f"{PLAN}, {TEMPLATE}, {PRIMARY}, {CHAIN}, ch AS (SELECT p.cell_id, p.stop_id, t.deadline_s, p.board_s, coalesce(a.walk_s, p.raw_s) AS access_s FROM pv p LEFT JOIN tp t ON t.stop_id=p.stop_id LEFT JOIN tn_access a ON a.cell_id=p.cell_id AND a.stop_id=p.stop_id), {FORWARD}")
def _(n):
    """The primary of every cell; its seconds and waits add up to r12's raw seconds."""
    chain, template = travelled(n)
    best = planned.primary(access(n), template, purewalk(n)).join(template.select("stop_id", "deadline_s"), "stop_id", "left").join(access(n), ["cell_id", "stop_id"], "left")
    chosen = best.select("cell_id", "stop_id", "deadline_s", "board_s", F.coalesce("walk_to_s", "raw_s").alias("access_s"))
    return longs(planned.forward_itineraries(chosen, chain), *LEGS)


@query("k06_via_stop", f"{PLAN}, {TEMPLATE}, {CHAIN}, ch AS (SELECT a.cell_id, a.stop_id, t.deadline_s, t.board_s, a.walk_s AS access_s FROM tn_access a JOIN tp t ON t.stop_id=a.stop_id QUALIFY row_number() OVER (PARTITION BY a.cell_id ORDER BY a.walk_s, a.stop_id)=1), {FORWARD}")
def _(n):
    """By way of the nearest stop that has a template, whatever the cell's best stop."""
    chain, template = travelled(n)
    own = access(n).join(template.select("stop_id", "deadline_s", "board_s"), "stop_id")
    via = own.groupBy("cell_id").agg(F.min(F.struct("walk_to_s", "stop_id", "deadline_s", "board_s")).alias("x"))
    chosen = via.select("cell_id", "x.stop_id", "x.deadline_s", "x.board_s", F.col("x.walk_to_s").alias("access_s"))
    return longs(planned.forward_itineraries(chosen, chain), *LEGS)
