"""Operators of the travel-time engine on small networks, against independent searches and by hand."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from wayfold.functions import feeds, walking
from wayfold.operators import choice, corridors, journeys, planned, reliability, search, spatial, timetable, transfers, validate, walkgraph
from wayfold.sources import gtfs, publish

TIMES = "pattern_id long, trip_id long, pos long, stop_id long, arr_s long, dep_s long"
WALKS = "from_id long, to_id long, walk_s long"


def line(pattern, trip, stops, times):
    return [(pattern, trip, k, s, t, t) for k, (s, t) in enumerate(zip(stops, times, strict=True))]


def brute(times, walks, seeds, rounds, slack=60):
    """Labels by scanning trips, round by round: {stop: v}."""
    best = {}
    for s, v in seeds:
        best[s] = max(best.get(s, v), v)

    def hop(new, base):
        out = {}
        for a, b, w in walks:
            if b in new and new[b] - w > max(base.get(a, -(10**9)), out.get(a, -(10**9))):
                out[a] = new[b] - w
        return out

    foot = hop(best, best)
    best |= foot
    frontier = dict(best)
    trips = {}
    for p, t, pos, s, a, d in times:
        trips.setdefault((p, t), []).append((pos, s, a, d))
    for _ in range(rounds):
        new = {}
        for stops in trips.values():
            stops.sort()
            last = max((k for k, (_, s, a, _) in enumerate(stops) if s in frontier and a <= frontier[s] - slack), default=None)
            for k in range(last or 0):
                s, d = stops[k][1], stops[k][3]
                if d > max(best.get(s, -(10**9)), new.get(s, -(10**9))):
                    new[s] = d
        middle = best | new
        foot = hop(new, middle)
        best = middle | foot
        frontier = new | foot
        if not frontier:
            break
    return best


def test_trip_prune_trio(spark):
    rows = sum((line(0, t, (0, 1, 2), x) for t, x in enumerate(((100, 180, 300), (200, 300, 500), (400, 510, 540)))), [])
    got = search.reverse_search(search.lanes(spark.createDataFrame(rows, TIMES)), spark.createDataFrame([(2, 0, 30), (2, 1, 30)], WALKS), spark.createDataFrame([(600, 2, 600)], "deadline_s long, stop_id long, v long"), rounds=2)
    assert {r.stop_id: r.v for r in got.collect()}[0] == 400


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_equals_label_scanning(spark, seed):
    rng = random.Random(seed)
    rows = []
    for p in range(6):
        stops = rng.sample(range(12), 4)
        for t in range(rng.choice((1, 3, 5))):
            at = rng.randrange(0, 3000)
            rows += line(p, 100 * p + t, stops, [at + k * rng.randrange(60, 200) for k in range(4)])
    walks = [(a, b, rng.randrange(10, 200)) for a in range(12) for b in range(12) if a != b and rng.random() < 0.15]
    times, feet = spark.createDataFrame(rows, TIMES), spark.createDataFrame(walks, WALKS)
    start = [(d, s, d - 60) for d in (2000, 3500) for s in (0, 1)]
    found, history = search.traced_search(times, feet, spark.createDataFrame(start, "deadline_s long, stop_id long, v long"), rounds=3)
    labels = found.collect()
    plain = search.reverse_search(search.lanes(times), feet, spark.createDataFrame(start, "deadline_s long, stop_id long, v long"), rounds=3)
    assert {(r.deadline_s, r.stop_id, r.v, r.rides) for r in plain.collect()} == {(r.deadline_s, r.stop_id, r.v, r.rides) for r in labels}
    for d in (2000, 3500):
        assert {r.stop_id: r.v for r in labels if r.deadline_s == d} == brute(rows, walks, [(s, v) for x, s, v in start if x == d], 3)
    legs = {}
    for r in search.trace(found, history, rounds=3).collect():
        legs.setdefault((r.deadline_s, r.origin), []).append(r)
    for r in labels:
        own = sorted(legs[r.deadline_s, r.stop_id], key=lambda x: x.leg)
        assert own[0].v == r.v and own[-1].kind == "egress"
        assert all(a.to_stop == b.from_stop for a, b in zip(own, own[1:], strict=False))
        assert sum(x.kind == "ride" for x in own) <= 3
        for a, b in zip(own, own[1:], strict=False):
            assert a.kind != "ride" or a.arr_s <= b.v - 60


def test_arrival_profile(spark):
    p = spark.createDataFrame([(1, 600, 100), (1, 700, 100), (1, 800, 250)], "stop_id long, deadline_s long, latest_s long")
    got = {r.dep_s: r.arr_w_s for r in search.arrival_profile(p, [0, 60, 120, 180, 240, 300]).collect()}
    assert got == {0: 600, 60: 600, 120: 800, 180: 800, 240: 800}


def test_first_at_or_after(spark):
    rows = spark.createDataFrame([(1, 5), (1, 11), (2, 1)], "k long, at long")
    steps = spark.createDataFrame([(1, 5, 50), (1, 10, 100)], "k long, step long, val long")
    got = {(r.k, r.at): r.val for r in search.first_at_or_after(rows, steps, ["k"], "at", "step", "val").collect()}
    assert got == {(1, 5): 50, (1, 11): None, (2, 1): None}


def test_percentile_lower(spark):
    df = spark.range(10)
    assert df.agg(search.percentile_lower("id", 95)).first()[0] == 8


def test_time_parsing(spark):
    rows = [("25:01:02", 90062), ("", None), (None, None), ("7:61:00", 28860), ("x:1:2", None), (" 8:00:00 ", 28800)]
    got = spark.createDataFrame(rows, "t string, want long").select("want", feeds.seconds(F.col("t")).alias("s"), feeds.strict_seconds(F.col("t")).alias("strict"), "t").collect()
    assert all(r.s == r.want for r in got)
    assert [r.strict for r in got if r.t == "7:61:00"] == [None]


def test_rounding_modes(spark):
    got = spark.createDataFrame([(5, 0, False), (-1, 0, False), (0, 0, False), (5, 9, True)], "s long, least long, path boolean").select(
        walking.scaled_rint(F.col("s"), 0.5).alias("rint"), walking.scaled_transfer(F.col("s"), F.col("least"), 0.5, F.col("path")).alias("up"), walking.scaled_never_zero(F.col("s"), 0.01).alias("one")
    )
    assert [tuple(r) for r in got.collect()] == [(2, 3, 1), (-1, 0, -1), (0, 0, 0), (2, 9, 1)]


def test_radius_join_equals_all_pairs(spark):
    rng = random.Random(1)
    pts = [(k, rng.randrange(-500, 500), rng.randrange(-500, 500)) for k in range(80)]
    df = spark.createDataFrame(pts, "id long, x_m long, y_m long")
    got = {(r.a, r.b) for r in spatial.manhattan_join(df, df, 150, "id", "id", ("a", "b")).collect()}
    assert got == {(p[0], q[0]) for p in pts for q in pts if abs(p[1] - q[1]) + abs(p[2] - q[2]) <= 150}


def test_fifo_chains_never_overtake(spark):
    rng = random.Random(7)
    rows = []
    for t in range(30):
        at, step = rng.randrange(1000), rng.choice((50, 90, 140))
        rows += line(1, t, (0, 1, 2, 3), [at + k * step for k in range(4)])
    chains = {r.trip_id: (r.chain, r["rank"]) for r in timetable.fifo_chains(spark.createDataFrame(rows, TIMES)).collect()}
    by = {}
    for p, t, pos, s, a, d in rows:
        by.setdefault(t, []).append(a)
    groups = {}
    for t, (c, r) in chains.items():
        groups.setdefault(c, []).append((r, by[t]))
    for own in groups.values():
        own.sort()
        assert all(x <= y for (_, a), (_, b) in zip(own, own[1:], strict=False) for x, y in zip(a, b, strict=True))
    assert len(chains) == 30


def test_no_delay_changes_nothing(spark):
    rows = sum((line(1, t, (0, 1, 2), (100 * t, 100 * t + 30, 100 * t + 60)) for t in range(4)), [])
    times = spark.createDataFrame(rows, TIMES)
    draws = spark.createDataFrame([(1, t, 0, 0.0, 0.0) for t in range(4)], "pattern_id long, trip_id long, draw_id long, delta0 double, slope double")
    chains = spark.createDataFrame([(1, t, 0, t) for t in range(4)], "pattern_id long, trip_id long, chain long, rank long")
    got = reliability.delayed(times, draws, chains).select("pattern_id", "trip_id", "pos", "stop_id", "arr_s", "dep_s")
    assert got.exceptAll(times).isEmpty() and got.count() == len(rows)


def test_shortest_paths_and_components(spark):
    rng = random.Random(2)
    edges = [(a, b, rng.randrange(1, 9)) for a in range(30) for b in range(30) if a != b and a // 15 == b // 15 and rng.random() < 0.12]
    df = spark.createDataFrame(edges, "src long, dst long, w_s long")
    want = {0: 0}
    for _ in range(30):
        for a, b, w in edges:
            if a in want and want[a] + w <= 20 and want[a] + w < want.get(b, 99):
                want[b] = want[a] + w
    roots = spark.createDataFrame([(0, 0, 0)], "root long, node long, sec long")
    assert {r.node: r.sec for r in walkgraph.shortest(df, roots, 20).collect()} == want
    label = {}
    for r in walkgraph.components(df).collect():
        label[r.node] = r.component
    assert all(label[a] == label[b] for a, b, _ in edges)
    assert len(set(label.values())) == 2


def test_transfer_rules(spark):
    rules = [(1, 2, "2", "45"), (1, 2, "2", "90"), (2, 3, "3", None), (4, 5, "2", "-1"), (4, 5, "2", "x"), (6, 7, "2", "30")]
    walks = spark.createDataFrame([(1, 2, 60), (2, 3, 10), (4, 5, 20)], WALKS)
    got = {(r.from_id, r.to_id): r.eff_s for r in transfers.ruled_transfers(walks, spark.createDataFrame(rules, "from_id long, to_id long, transfer_type string, min_transfer_time string")).collect()}
    assert got == {(1, 2): 90, (4, 5): 20, (6, 7): 30}


def test_minutes_add_up(spark):
    legs = spark.createDataFrame([(1, 1, 90), (1, 2, 90), (1, 3, 61), (2, 1, 59)], "journey long, leg long, sec long")
    got = {(r.journey, r.leg): r.minutes for r in journeys.reconciled_minutes(legs).collect()}
    assert got == {(1, 1): 2, (1, 2): 2, (1, 3): 1, (2, 1): 1}


OPTION = "cell_id long, option_id long, minutes long, walk_min long, transfers long, frag_min long, family long, branch long, line_id long, final_walk long"


def test_diversity_and_dominance(spark):
    rows = [(1, 1, 10, 5, 0, 1, 0, 0, 1, 1), (1, 2, 11, 5, 0, 1, 0, 0, 2, 1), (1, 3, 12, 2, 1, 1, 0, 1, 3, 1), (1, 4, 20, 9, 2, 2, 1, 0, 4, 2), (1, 5, 30, 1, 0, 0, 2, 0, 5, 0), (1, 6, 11, 5, 0, 1, 0, 0, 6, 1)]
    df = spark.createDataFrame(rows, OPTION).selectExpr("*", "minutes * 60 AS exact_s", "0L AS access_walk", "0L AS anchor_neg", "0 AS token_ride")
    assert {r.option_id for r in choice.pareto(df).collect()} == {1, 3, 4, 5}
    assert [r.option_id for r in choice.diverse(df).orderBy("slot").collect()] == [1, 4, 5, 3]
    clusters = {r.option_id: r.cluster for r in choice.families(df).collect()}
    assert clusters[1] == clusters[2] == clusters[6] != clusters[4]


def test_first_failure(spark):
    df = spark.createDataFrame([("b", 2), ("a", 0), ("c", 1)], "code string, violations long")
    assert tuple(validate.first_failure(df, ["a", "c", "b"]).first()) == (False, "c")
    assert tuple(validate.first_failure(df.where("violations = 0"), ["a"]).first()) == (True, "ready")


def test_feed_archives(spark, tmp_path):
    good, bad = tmp_path / "good.zip", tmp_path / "bad.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("stops.txt", "﻿stop_id, stop_lat\n1,37.5\n2,\n")
        z.writestr("routes.txt", "route_id\nr\n")
        z.writestr("trips.txt", "route_id,service_id,trip_id\nr,s,t\n")
        z.writestr("stop_times.txt", "trip_id,stop_id,stop_sequence,arrival_time,departure_time\nt,1,1,08:00:00,08:00:00\nt,2,2,25:00:00,\n")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("stops.txt", "stop_id,stop_id\n1\n")
        z.writestr("routes.txt", "name\n")
    paths = [str(good), str(bad)]
    stops = gtfs.read_table(spark, paths, "stops", ["stop_id", "stop_lat", "zone"])
    assert sorted((r.feed, r.stop_id, r.zone) for r in stops.collect()) == [("bad.zip", "1", None), ("good.zip", "1", None), ("good.zip", "2", None)]
    faults = {(r.feed, r.table, r.fault) for r in gtfs.header_faults(spark, paths).collect()}
    assert not any(f == "good.zip" for f, *_ in faults)
    assert {("bad.zip", "trips", "missing_table"), ("bad.zip", "stops", "ragged"), ("bad.zip", "stops", "repeated_column"), ("bad.zip", "routes", "missing_column:route_id"), ("bad.zip", "routes", "no_rows")} <= faults
    gtfs.to_parquet(spark, [str(good)], {"stop_times": ["trip_id", "departure_time"]}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/stop_times")).where("feed = 'good.zip'").count() == 2


def test_publish_and_rebuild(spark, tmp_path):
    path, built = str(tmp_path / "bake"), []

    def build():
        built.append(1)
        return spark.range(5)

    source = spark.createDataFrame([("a", 1)], "path string, n long")
    for s in (source, source, spark.createDataFrame([("a", 2)], "path string, n long")):
        assert publish.load_or_build(spark, path, s, build).count() == 5
    assert len(built) == 2
    with pytest.raises(ValueError):
        publish.publish(spark.range(3), path, lambda df: df.count() == 4)
    assert publish.read(spark, path).count() == 5


@pytest.mark.parametrize("step", ["check", "point"])
def test_a_publish_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "place")
    publish.publish(spark.range(5), path)

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        if step == "point":
            m.setattr(publish, "point", die)
        publish.publish(spark.range(9), path, die if step == "check" else lambda _: True)
    assert publish.read(spark, path).count() == 5
    reader = publish.read(spark, path)
    publish.publish(spark.range(7), path)
    assert publish.read(spark, path).count() == 7 and reader.count() == 5


def test_fingerprints_tell_sources_and_parameters_apart(spark):
    a, b = spark.createDataFrame([(1, 4), (2, 3)], "x long, y long"), spark.createDataFrame([(1, 3), (2, 4)], "x long, y long")
    told = [publish.fingerprint(a, pace=1).first(), publish.fingerprint(b, pace=1).first(), publish.fingerprint(a, pace=2).first(), publish.fingerprint(a.union(a), pace=1).first()]
    assert len(set(told)) == 4 and told[0] == publish.fingerprint(a.orderBy("y"), pace=1).first()


def test_first_wins_depends_on_what_was_kept(spark):
    rows = [(1, 1, "a", "p", "One"), (1, 2, "a", "q", "Two"), (1, 3, "b", "q", "Three"), (1, 4, None, "r", " three, "), (1, 5, None, "s", "Four"), (2, 1, "a", "p", "One")]
    df = spark.createDataFrame(rows, "g long, k long, id string, place string, label string")
    # hit 2 falls to hit 1's id, so its place is free for hit 3
    assert sorted((r.g, r.k) for r in corridors.first_wins(df, "g", "k").collect()) == [(1, 1), (1, 3), (1, 5), (2, 1)]


def test_points_in_polygons(spark):
    rng = random.Random(5)
    points = [(k, rng.randrange(0, 400), rng.randrange(0, 400)) for k in range(300)]
    rings = {1: [(50.5, 50.5), (250.5, 80.5), (200.5, 300.5), (120.5, 150.5)], 2: [(10.5, 10.5), (390.5, 10.5), (200.5, 30.5)]}

    def inside(x, y, ring):
        hits = 0
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            hits += (y < ay) != (y < by) and x < ax + (y - ay) * (bx - ax) / (by - ay)
        return hits % 2

    df = spark.createDataFrame(points, "p long, x_m long, y_m long")
    polygons = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in rings.items()], "h long, ring array<struct<x: double, y: double>>")
    got = {(r.p, r.h) for r in spatial.in_polygons(df, polygons, "p", "h", 100).collect()}
    assert got == {(k, h) for k, x, y in points for h, r in rings.items() if inside(x, y, r)}


def test_waits_fold_into_walks_and_targets_reconcile(spark):
    legs = [(1, 1, "walk", 100, 0), (1, 2, "ride", 600, 50), (1, 3, "walk", 60, 0), (1, 4, "ride", 300, 20), (2, 1, "ride", 300, 40), (3, 1, "walk", 100, 0), (3, 2, "ride", 200, 30)]
    target = [(1, 1130 + 25), (2, 340), (3, 330 - 20)]
    got = planned.folded_walks(spark.createDataFrame(legs, "journey long, leg long, kind string, dur_s long, wait_s long"), spark.createDataFrame(target, "journey long, target_s long"))
    rows = {(r.journey, r.leg): (r.physical_s, r.allowance_s, r.wait_s, r.sec) for r in got.collect()}
    assert rows[1, 1] == (100, 75, 0, 175) and rows[1, 2][2] == 0 and rows[1, 4][2] == 20  # first wait and surplus; later waits stay
    assert rows[2, 0] == (0, 40, 0, 40)  # a walk of allowance alone before the first ride
    assert rows[3, 1] == (100, 10, 0, 110)  # what exceeds the target comes out of the allowance
    for j, want in target:
        assert sum(sec + wait for (k, _), (_, _, wait, sec) in rows.items() if k == j) == want


def test_templates_reanchor_or_drop(spark):
    tail = spark.createDataFrame([(600, 1, 150, 1, 500, 60, "A", "A"), (600, 2, 90, 1, 500, 60, "A", "A"), (600, 3, 300, 1, 550, 0, "B", "B")], "deadline_s long, stop_id long, v long, rides long, finish_s long, walk_s long, route string, dominant string")
    anchors = spark.createDataFrame([(1, 200, 600), (2, 200, 600), (3, 200, 600)], "stop_id long, dep_s long, arr_w_s long")
    got = {r.stop_id: (r.board_s, r.reanchored, r.tail_s) for r in planned.templates(anchors, tail, 100).collect()}
    assert got == {1: (150, True, 350), 3: (200, False, 350)}  # stop 2's chain leaves before the window


def test_published_reliability(spark):
    rows = [(d, 1, float(20 + d)) for d in range(4)]
    got = reliability.published(spark.createDataFrame(rows, "draw_id long, cell_id long, minutes double"), spark.createDataFrame([(1, 22)], "cell_id long, perfect long"), ["cell_id"], 5).first()
    # a missing draw counts as the cap; the floor holds before medians are taken
    assert (got.raw, got.real, got.p90, got.frag, got.stuck) == (22, 22, 54, 32, 0.2)
