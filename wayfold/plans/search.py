"""Queries of the backward search, profiles, and minutes per cell."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wayfold.operators import assemble, search
from wayfold.plans.base import query

BY = 32400
DEADLINES = search.grid(30600, 34200, 180)
DEPARTURES = search.grid(28800, 30600, 60)
BOARDS = search.grid(28800, 32700, 60)  # the departures, and the walks after them
ROUNDS = search.MAX_ROUNDS  # the search ends before them when nothing improves


def search_sql(seed: str, keys: str = "deadline_s", rounds: int = ROUNDS, times: str = "tn_stop_time", time_key: str = "", prefix: str = "") -> str:
    """CTEs f0..fR, b0..bR of the search, unrolled, their names behind the prefix; `seed` gives keys, stop_id, v."""
    on = lambda a, b: " AND ".join(f"{a}.{k}={b}.{k}" for k in [*keys.split(", "), "stop_id"])
    tk = f" AND x.{time_key}=f.{time_key}" if time_key else ""
    tk2 = f" AND y.{time_key}=x.{time_key}" if time_key else ""
    fk = ", ".join(f"f.{k}" for k in keys.split(", "))
    out = [
        f"s0 AS MATERIALIZED (SELECT {keys}, stop_id, max(v) AS v FROM ({seed}) s GROUP BY ALL)",
        f"h0 AS MATERIALIZED (SELECT {fk}, t.from_id AS stop_id, max(f.v-t.walk_s) AS v FROM s0 f JOIN tn_transfer t ON t.to_id=f.stop_id GROUP BY ALL)",
        f"b0 AS MATERIALIZED (SELECT {keys}, stop_id, max(v) AS v, 0 AS rides FROM (SELECT * FROM s0 UNION ALL SELECT * FROM h0) u GROUP BY ALL)",
        "f0 AS MATERIALIZED (SELECT * FROM b0)",
    ]
    for r in range(1, rounds + 1):
        p = r - 1
        out += [
            f"c{r} AS MATERIALIZED (SELECT {fk}, y.stop_id, max(y.dep_s) AS v FROM f{p} f JOIN {times} x ON x.stop_id=f.stop_id AND x.arr_s<=f.v-60{tk} JOIN {times} y ON y.pattern_id=x.pattern_id AND y.trip_id=x.trip_id AND y.pos<x.pos{tk2} GROUP BY ALL)",
            f"n{r} AS MATERIALIZED (SELECT f.* FROM c{r} f LEFT JOIN b{p} b ON {on('f', 'b')} WHERE b.v IS NULL OR f.v>b.v)",
            f"m{r} AS MATERIALIZED (SELECT {keys}, stop_id, max(v) AS v FROM (SELECT {keys}, stop_id, v FROM b{p} UNION ALL SELECT {keys}, stop_id, v FROM n{r}) u GROUP BY ALL)",
            f"h{r} AS MATERIALIZED (SELECT {fk}, t.from_id AS stop_id, max(f.v-t.walk_s) AS v FROM n{r} f JOIN tn_transfer t ON t.to_id=f.stop_id GROUP BY ALL)",
            f"f{r} AS MATERIALIZED (SELECT {keys}, stop_id, max(v) AS v FROM (SELECT {keys}, stop_id, v FROM n{r} UNION ALL SELECT {', '.join('h.' + k for k in keys.split(', '))}, h.stop_id, h.v FROM h{r} h LEFT JOIN m{r} m ON {on('h', 'm')} WHERE m.v IS NULL OR h.v>m.v) u GROUP BY ALL)",
            f"b{r} AS MATERIALIZED (SELECT * FROM b{p} b WHERE NOT EXISTS (SELECT 1 FROM f{r} f WHERE {on('f', 'b')}) UNION ALL SELECT {keys}, stop_id, v, {r} AS rides FROM f{r})",
        ]
    return re.sub(r"\b([shbfcnm]\d)\b", rf"{prefix}\1", ",\n".join(out)) if prefix else ",\n".join(out)


SEED_ONE = f"SELECT {BY} AS deadline_s, stop_id, {BY}-walk_s AS v FROM tn_egress"
SEED_ALL = f"SELECT d AS deadline_s, stop_id, d-walk_s AS v FROM tn_egress, (SELECT unnest({DEADLINES!r}) AS d) g"
PURE = "pw AS (SELECT cell_id, CAST(floor((abs(3000-x_m)+abs(3000-y_m))*0.75+0.5) AS BIGINT) AS walk_only_s FROM tn_cell WHERE abs(3000-x_m)+abs(3000-y_m)<=6000)"
PROFILE = f"pr AS MATERIALIZED (SELECT deadline_s, stop_id, v, max(v) OVER (PARTITION BY stop_id ORDER BY deadline_s ROWS UNBOUNDED PRECEDING) AS latest_s FROM b{ROUNDS})"
ARRIVAL = f"ar AS MATERIALIZED (SELECT stop_id, d AS dep_s, min(deadline_s) AS arr_w_s FROM pr JOIN (SELECT unnest(range({BOARDS[0]},{BOARDS[-1] + 1},60)) AS d) g ON latest_s>=d GROUP BY ALL)"
ONE = f"WITH {search_sql(SEED_ONE)}"
ALL = f"WITH {search_sql(SEED_ALL)}, {PROFILE}"


def purewalk(n):
    dist = F.abs(F.col("x_m") - 3000) + F.abs(F.col("y_m") - 3000)
    return n.cell.where(dist <= 6000).select("cell_id", F.floor(dist * 0.75 + 0.5).cast("long").alias("walk_only_s"))


def labels(n):
    return search.reverse_search(search.lanes(n.stop_time), n.footpaths, search.seed(n.egress, [BY]), rounds=ROUNDS)


def profile(n):
    found = search.reverse_search(search.lanes(n.stop_time), n.footpaths, search.seed(n.egress, DEADLINES), rounds=ROUNDS)
    return search.monotone(found)


def arrivals(n):
    return search.arrival_profile(profile(n), BOARDS)


@query("r01_reverse_search", f"{ONE} SELECT CAST(deadline_s AS BIGINT) AS deadline_s, stop_id, CAST(v AS BIGINT) AS v, CAST(rides AS BIGINT) AS rides FROM b{ROUNDS}")
def _(n):
    return labels(n).select("deadline_s", "stop_id", "v", F.col("rides").cast("long").alias("rides"))


@query("r02_reverse_profile", f"{ALL} SELECT CAST(deadline_s AS BIGINT) AS deadline_s, stop_id, CAST(v AS BIGINT) AS v, CAST(latest_s AS BIGINT) AS latest_s FROM pr")
def _(n):
    return profile(n).select("deadline_s", "stop_id", "v", "latest_s")


@query("r04_arrival_profile", f"{ALL}, {ARRIVAL} SELECT stop_id, CAST(dep_s AS BIGINT) AS dep_s, CAST(arr_w_s AS BIGINT) AS arr_w_s FROM ar")
def _(n):
    return arrivals(n)


DEP_ROWS = f"""dd AS (SELECT unnest({DEPARTURES!r}) AS d), q AS MATERIALIZED (SELECT a.cell_id, a.walk_s, d, ar.arr_w_s FROM tn_access a JOIN dd ON true JOIN ar ON ar.stop_id=a.stop_id AND ar.dep_s=28800+CAST(ceil((d+a.walk_s-28800)/60.0) AS BIGINT)*60),
    e AS (SELECT *, min(arr_w_s) OVER (PARTITION BY cell_id, d) AS lo FROM q), s AS (SELECT cell_id, d, round(arr_w_s-d+0.15*walk_s,6) AS score, arr_w_s-d AS tt FROM e WHERE arr_w_s<=lo+60),
    k AS (SELECT cell_id, d, score, tt FROM s QUALIFY row_number() OVER (PARTITION BY cell_id, d ORDER BY score, tt)=1),
    j AS (SELECT c.cell_id, least(75, coalesce(ceil((CASE WHEN walk_only_s IS NOT NULL AND (score IS NULL OR round(walk_only_s*1.15,6)<score) THEN walk_only_s ELSE tt END)/60.0),75)) AS m FROM tn_cell c JOIN dd ON true LEFT JOIN pw ON pw.cell_id=c.cell_id LEFT JOIN k ON k.cell_id=c.cell_id AND k.d=dd.d),
    v AS (SELECT cell_id, list_sort(list(CAST(m AS BIGINT))) AS v FROM j GROUP BY cell_id)"""


@query("r05_depart_after", f"{ALL}, {ARRIVAL}, {PURE}, {DEP_ROWS} SELECT cell_id, CASE WHEN v[1+(len(v)-1)*5//100]<75 THEN v[1+(len(v)-1)*5//100] END AS p5, CASE WHEN v[1+(len(v)-1)*50//100]<75 THEN v[1+(len(v)-1)*50//100] END AS p50 FROM v")
def _(n):
    return assemble.depart_after(n.cell, n.access, arrivals(n), purewalk(n), DEPARTURES)


PLANNED = f"""an AS (SELECT stop_id, dep_s, arr_w_s FROM ar WHERE dep_s BETWEEN {DEPARTURES[0]} AND {DEPARTURES[-1]}),
    pk AS (SELECT a.cell_id, a.stop_id, a.walk_s, dep_s, arr_w_s-dep_s+a.walk_s AS cost FROM tn_access a JOIN an ON an.stop_id=a.stop_id QUALIFY row_number() OVER (PARTITION BY a.cell_id ORDER BY arr_w_s-dep_s+a.walk_s, dep_s DESC, a.walk_s, a.stop_id)=1),
    pl AS (SELECT c.cell_id, pk.*, walk_only_s, walk_only_s IS NOT NULL AND (cost IS NULL OR walk_only_s<cost) AS w FROM tn_cell c LEFT JOIN pk ON pk.cell_id=c.cell_id LEFT JOIN pw ON pw.cell_id=c.cell_id),
    pm AS (SELECT *, CAST(ceil((CASE WHEN w THEN walk_only_s ELSE cost END)/60.0) AS BIGINT) AS mm FROM pl)"""


@query("r07_planned", f"""{ALL}, {ARRIVAL}, {PURE}, {PLANNED} SELECT cell_id, CASE WHEN mm<75 THEN mm END AS minutes, CASE WHEN mm<75 AND NOT w THEN stop_id END AS stop_id,
    CAST(CASE WHEN mm<75 AND NOT w THEN dep_s-walk_s WHEN mm<75 THEN {DEPARTURES[-1]}-walk_only_s END AS BIGINT) AS leave_s, coalesce(w AND mm<75,false) AS walked FROM pm""".replace("SELECT c.cell_id, pk.*", "SELECT c.cell_id, pk.stop_id, pk.walk_s, pk.dep_s, pk.cost"))
def _(n):
    return assemble.planned(n.cell, n.access, arrivals(n), purewalk(n), DEPARTURES).withColumn("walked", F.coalesce("walked", F.lit(False)))


@query("r11_stop_anchor", f"{ALL}, {ARRIVAL} SELECT stop_id, CAST(dep_s AS BIGINT) AS dep_s, CAST(arr_w_s AS BIGINT) AS arr_w_s FROM ar WHERE dep_s BETWEEN {DEPARTURES[0]} AND {DEPARTURES[-1]} QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY arr_w_s-dep_s, dep_s DESC)=1")
def _(n):
    return assemble.stop_anchor(arrivals(n), DEPARTURES)


@query("r08_arrive_by_profile", f"""{ALL}, {PURE}, ho AS (SELECT a.cell_id, a.walk_s, pr.deadline_s, latest_s-a.walk_s AS home FROM tn_access a JOIN pr ON pr.stop_id=a.stop_id), o AS (SELECT *, max(home) OVER (PARTITION BY cell_id, deadline_s) AS opt FROM ho),
    k AS (SELECT cell_id, deadline_s, home, round(home-0.15*walk_s,6) AS pen FROM o WHERE home>=opt-60 QUALIFY row_number() OVER (PARTITION BY cell_id, deadline_s ORDER BY round(home-0.15*walk_s,6) DESC, home DESC)=1),
    j AS (SELECT c.cell_id, least(75, coalesce(ceil(greatest(0, CASE WHEN walk_only_s IS NOT NULL AND (pen IS NULL OR round(walk_only_s*1.15,6)<round(d-pen,6)) THEN walk_only_s ELSE d-home END)/60.0),75)) AS m FROM tn_cell c JOIN (SELECT unnest({DEADLINES!r}) AS d) g ON true LEFT JOIN pw ON pw.cell_id=c.cell_id LEFT JOIN k ON k.cell_id=c.cell_id AND k.deadline_s=d),
    v AS (SELECT cell_id, list_sort(list(CAST(m AS BIGINT))) AS v FROM j GROUP BY cell_id) SELECT cell_id, CASE WHEN v[1+(len(v)-1)*5//100]<75 THEN v[1+(len(v)-1)*5//100] END AS p5, CASE WHEN v[1+(len(v)-1)*50//100]<75 THEN v[1+(len(v)-1)*50//100] END AS p50 FROM v""")
def _(n):
    return assemble.arrive_by_profile(n.cell, n.access, profile(n), purewalk(n), DEADLINES)


@query("r10_arrive_by", f"""{ONE}, {PURE}, k AS (SELECT a.cell_id, a.stop_id, v-a.walk_s AS home FROM tn_access a JOIN b{ROUNDS} b ON b.stop_id=a.stop_id QUALIFY row_number() OVER (PARTITION BY a.cell_id ORDER BY v-a.walk_s DESC, a.stop_id)=1),
    j AS (SELECT c.cell_id, k.stop_id, {BY}-home AS ride, walk_only_s, walk_only_s IS NOT NULL AND (home IS NULL OR walk_only_s<{BY}-home) AS w FROM tn_cell c LEFT JOIN k ON k.cell_id=c.cell_id LEFT JOIN pw ON pw.cell_id=c.cell_id),
    m AS (SELECT *, CAST(ceil((CASE WHEN w THEN walk_only_s ELSE ride END)/60.0) AS BIGINT) AS mm FROM j) SELECT cell_id, CASE WHEN mm<75 THEN mm END AS minutes, CASE WHEN mm<75 AND NOT w THEN stop_id END AS stop_id, coalesce(w AND mm<75,false) AS walked FROM m""")
def _(n):
    return assemble.arrive_by(n.cell, n.reach, labels(n), purewalk(n), BY).withColumn("walked", F.coalesce("walked", F.lit(False)))


@query("p14_reachable", f"""{ONE}, {PURE}, k AS (SELECT a.cell_id, max(v-a.walk_s) AS home FROM tn_access a JOIN b{ROUNDS} b ON b.stop_id=a.stop_id GROUP BY a.cell_id)
    SELECT cell_id, CASE WHEN m<75 THEN m END AS minutes FROM (SELECT c.cell_id, CAST(ceil(least(coalesce({BY}-home, walk_only_s), coalesce(walk_only_s, {BY}-home))/60.0) AS BIGINT) AS m FROM tn_cell c LEFT JOIN k ON k.cell_id=c.cell_id LEFT JOIN pw ON pw.cell_id=c.cell_id) t""")
def _(n):
    """The minutes to every cell, by transit or on foot, null from 75 on."""
    return assemble.arrive_by(n.cell, n.reach, labels(n), purewalk(n), BY).select("cell_id", "minutes")
