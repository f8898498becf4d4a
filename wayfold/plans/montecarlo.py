"""Queries of the committed Monte-Carlo: full runs, replays for routes, what is shown of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import planned, reliability, search
from wayfold.operators.rounds import settle
from wayfold.plans.base import baked, query
from wayfold.plans.journeys import DELAYED, chains, late_times
from wayfold.plans.planned import BRANCHES, PLAN, PRIMARY, TEMPLATE, WINDOW, access, primaries, reached, tails, templates, traced
from wayfold.plans.search import DEADLINES, DEPARTURES, ROUNDS, search_sql
from wayfold.sources.network import DRAWS

TAIL_DEADLINES = search.grid(29400, 34800, 300)
TAIL_SEED = f"SELECT x.draw_id, d AS deadline_s, stop_id, d-walk_s AS v FROM tn_egress, (SELECT unnest({TAIL_DEADLINES!r}) AS d) g, (SELECT unnest(range({DRAWS})) AS draw_id) x"
MC = f"""{PLAN}, {TEMPLATE}, {PRIMARY}, fr AS MATERIALIZED (SELECT deadline_s, origin, pattern_id, bpos, apos, foot_s FROM (SELECT *, sum(CASE WHEN kind='foot' THEN w ELSE 0 END) OVER (PARTITION BY deadline_s, origin ORDER BY leg) AS foot_s FROM nx) q WHERE kind='ride' QUALIFY row_number() OVER (PARTITION BY deadline_s, origin ORDER BY leg)=1),
    dl AS MATERIALIZED ({DELAYED}), {search_sql(TAIL_SEED, 'draw_id, deadline_s', ROUNDS, 'dl', 'draw_id', 'mc')}, mp AS MATERIALIZED (SELECT draw_id, deadline_s, stop_id, max(v) OVER (PARTITION BY draw_id, stop_id ORDER BY deadline_s ROWS UNBOUNDED PRECEDING) AS latest_s FROM mcb{ROUNDS})"""


def score_sql(commits: str, ids: str) -> str:
    """CTE sc (draw_id, ids, minutes) from commits(ids, home_s, walk_s, pattern_id, bpos, apos)."""
    own = lambda t: ", ".join(f"{t}.{c}" for c in ids.split(", "))
    return f"""cm AS MATERIALIZED ({commits}),
    nt AS MATERIALIZED (SELECT t.draw_id, {own('c')}, c.home_s, c.pattern_id, c.apos, t.trip_id FROM cm c JOIN dl t ON t.pattern_id=c.pattern_id AND t.pos=c.bpos AND t.dep_s>=c.home_s+c.walk_s QUALIFY row_number() OVER (PARTITION BY t.draw_id, {own('c')} ORDER BY t.dep_s, t.trip_id)=1),
    sc AS MATERIALIZED (SELECT n.draw_id, {own('n')}, coalesce(least(greatest((min(CASE WHEN latest_s>=t.arr_s+60 THEN deadline_s END)-any_value(n.home_s))/60.0,0.0),75.0),75.0) AS minutes FROM nt n JOIN dl t ON t.draw_id=n.draw_id AND t.pattern_id=n.pattern_id AND t.trip_id=n.trip_id AND t.pos=n.apos
        LEFT JOIN mp ON mp.draw_id=n.draw_id AND mp.stop_id=t.stop_id GROUP BY n.draw_id, {own('n')})"""


def published_sql(floors: str, ids: str) -> str:
    """CTE sm: the summary that is shown."""
    on = " AND ".join(f"s.{c}=f.{c}" for c in ids.split(", "))
    own = ", ".join(f"f.{c}" for c in ids.split(", "))
    return f"""fl AS MATERIALIZED ({floors}), ev AS (SELECT {own}, f.perfect, CAST(coalesce(s.minutes,75.0) AS DOUBLE) AS m, greatest(CAST(coalesce(s.minutes,75.0) AS DOUBLE), CAST(f.perfect AS DOUBLE)) AS g FROM fl f CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw_id) d LEFT JOIN sc s ON s.draw_id=d.draw_id AND {on}),
    sm AS MATERIALIZED (SELECT {ids}, any_value(perfect) AS perfect, CAST(ceil(round(quantile_cont(m,0.5),6)) AS BIGINT) AS raw, CAST(ceil(round(quantile_cont(g,0.5),6)) AS BIGINT) AS real, CAST(greatest(round_even(round(quantile_cont(g,0.9)-quantile_cont(g,0.5),6),0),0) AS BIGINT) AS frag, CAST(round_even(round(quantile_cont(g,0.9),6),0) AS BIGINT) AS p90,
        CAST(round_even(round(stddev_pop(g),6),0) AS BIGINT) AS spread, CAST(round(avg(CASE WHEN g>=75 THEN 1.0 ELSE 0.0 END),6) AS DOUBLE) AS stuck FROM ev GROUP BY {ids})"""


PRIMARY_COMMITS = "SELECT pv.cell_id, pv.board_s-a.walk_s AS home_s, a.walk_s+fr.foot_s AS walk_s, fr.pattern_id, fr.bpos, fr.apos FROM pv JOIN tn_access a ON a.cell_id=pv.cell_id AND a.stop_id=pv.stop_id JOIN tp ON tp.stop_id=pv.stop_id JOIN fr ON fr.deadline_s=tp.deadline_s AND fr.origin=pv.stop_id"
CELL = f"{MC}, {score_sql(PRIMARY_COMMITS, 'cell_id')}, {published_sql('SELECT cm.cell_id, CAST(ceil(raw_s/60.0) AS BIGINT) AS perfect FROM cm JOIN pv ON pv.cell_id=cm.cell_id', 'cell_id')}"
ROUTE_COMMITS = "SELECT br.cell_id, br.route, br.board_s-a.walk_s AS home_s, a.walk_s+fr.foot_s AS walk_s, fr.pattern_id, fr.bpos, fr.apos FROM br JOIN tn_access a ON a.cell_id=br.cell_id AND a.stop_id=br.stop_id JOIN fr ON fr.deadline_s=br.deadline_s AND fr.origin=br.stop_id"
ROUTE = f"{MC}, {BRANCHES}, {score_sql(ROUTE_COMMITS, 'cell_id, route')}, {published_sql('SELECT cell_id, route, CAST(ceil(total_s/60.0) AS BIGINT) AS perfect FROM br', 'cell_id, route')}"


class Plan:
    """What all these queries start from: tails, templates, primaries, branches, late times and their profiles, each written once."""

    def __init__(self, n):
        self.n = n
        legs = traced(n, DEADLINES)[1]
        self.tail = tails(n)
        arrived = reached(n)
        self.template = templates(n, arrived, self.tail)
        self.primary = primaries(n)
        self.first = settle(planned.first_rides(legs), "first-rides")
        self.arrived = arrived
        self.times = settle(late_times(n), "delayed")
        start = search.seed(n.egress, TAIL_DEADLINES).withColumn("draw_id", F.explode(F.array(*(F.lit(d).cast("long") for d in range(DRAWS)))))
        found = search.reverse_search(search.lanes(self.times, chains(n), ("draw_id",)), n.transfer, start, ("draw_id", "deadline_s"), time_keys=("draw_id",))
        self.retained = settle(search.monotone(found, ("draw_id",)), "retained")  # the tails that later replays read

    def branches(self):
        probes = planned.probes(self.arrived, self.tail, DEPARTURES)
        return settle(planned.branches(access(self.n), planned.stop_branches(probes, self.tail), self.primary, WINDOW), "branches")

    def replayed(self, commits, ids):
        return reliability.scored(reliability.next_committed(commits, self.times, ids), self.retained, ids=ids)

    def cells(self):
        chosen = self.primary.where("stop_id is not null").join(self.template.select("stop_id", "deadline_s"), "stop_id")
        commits = settle(planned.commits(chosen, access(self.n), self.first, ("cell_id",)), "commits")
        floors = commits.select("cell_id").join(self.primary.select("cell_id", F.ceil(F.col("raw_s") / 60).cast("long").alias("perfect")), "cell_id")
        return commits, floors

    def summary(self):
        commits, floors = self.cells()
        return reliability.published(self.replayed(commits, ("cell_id",)), floors, ["cell_id"], DRAWS), floors

    def routes(self):
        found = self.branches()
        commits = planned.commits(found, access(self.n), self.first, ("cell_id", "route"))
        floors = found.select("cell_id", "route", F.ceil(F.col("total_s") / 60).cast("long").alias("perfect"))
        return settle(commits, "route-commits"), floors


SHOWN = ("raw", "real", "frag", "p90", "spread", "stuck")


def _plan(n) -> Plan:
    return baked(n, ("montecarlo",), lambda: Plan(n))


@query("m08_montecarlo", f"{CELL} SELECT cell_id, {', '.join(SHOWN)} FROM sm")
def _(n):
    return _plan(n).summary()[0].select("cell_id", *SHOWN)


@query("m10_overlay", f"{CELL} SELECT cell_id, perfect AS served, greatest(p90-perfect,0) AS frag, stuck FROM sm")
def _(n):
    """What is added to the served minute on a bad day: the committed p90 minus it."""
    found, floors = _plan(n).summary()
    return found.join(floors, "cell_id").select("cell_id", F.col("perfect").alias("served"), F.greatest(F.col("p90") - F.col("perfect"), F.lit(0)).alias("frag"), "stuck")


@query("m05_replay_routes", f"{ROUTE} SELECT CAST(draw_id AS BIGINT) AS draw_id, cell_id, route, CAST(round(minutes,6) AS DOUBLE) AS minutes FROM sc")
def _(n):
    """Every route of every cell, scored against the retained tails of the draws; no search is run for them."""
    plan = _plan(n)
    return plan.replayed(plan.routes()[0], ("cell_id", "route")).select("draw_id", "cell_id", "route", F.round("minutes", 6).alias("minutes"))


def typicals(n):
    plan = _plan(n)
    commits, floors = plan.routes()
    return reliability.published(plan.replayed(commits, ("cell_id", "route")), floors, ["cell_id", "route"], DRAWS), floors


@query("m09_route_typicals", f"{ROUTE} SELECT cell_id, route, real, frag, p90 FROM sm")
def _(n):
    return typicals(n)[0].select("cell_id", "route", "real", "frag", "p90")


@query("m11_reliability_projection", f"{ROUTE} SELECT br.cell_id, br.route, CAST(ceil(total_s/60.0) AS BIGINT) AS minutes, s.real, CASE WHEN s.p90 IS NOT NULL THEN greatest(s.p90-CAST(ceil(total_s/60.0) AS BIGINT),0) END AS frag FROM br LEFT JOIN sm s ON s.cell_id=br.cell_id AND s.route=br.route")
def _(n):
    """Scheduled minutes of each route, and what its own draws add, joined by the route, never by position."""
    found, floors = typicals(n)
    both = floors.join(found, ["cell_id", "route"], "left")
    return both.select("cell_id", "route", F.col("perfect").alias("minutes"), "real", F.when(F.col("p90").isNotNull(), F.greatest(F.col("p90") - F.col("perfect"), F.lit(0))).alias("frag"))
