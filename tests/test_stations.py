"""Transfer rules with scopes, pathways, the transfers they leave, and drawn walks, on small hand-made cases."""

import random

import pytest

from wayfold.operators import transfers, walkgraph

RULE = "from_stop_id string, to_stop_id string, transfer_type string, min_transfer_time string, from_route_id string, to_route_id string, from_trip_id string, to_trip_id string"
WAY = "pathway_id string, from_stop_id string, to_stop_id string, pathway_mode string, is_bidirectional string, length string, traversal_time string"


def rules(spark, rows):
    pair, scoped = transfers.parsed_rules(spark.createDataFrame([(*r, *([None] * (8 - len(r)))) for r in rows], RULE))
    return {(r.from_id, r.to_id): (r.min_s, r.prohibited) for r in pair.collect()}, {tuple(r) for r in scoped.collect()}


def test_largest_minimum_and_prohibition(spark):
    pair, scoped = rules(spark, [("A", "B", "2", "45"), (" A ", "B", "2", " 90"), ("A", "B", "0", "not-a-number"), ("B", "C", "3", "0"), ("B", "C", "3", "30"), ("C", "D", "2", "30"), ("C", "D", "3", "")])
    assert pair == {("A", "B"): (90, False), ("B", "C"): (None, True), ("C", "D"): (30, True)} and scoped == set()


def test_malformed_rules_say_nothing(spark):
    pair, scoped = rules(spark, [("A", "B", "2", "-1"), ("A", "C", "wat", "15"), ("", "D", "2", "15"), ("D", "D", "2", "15"), ("E", "F", "3", "-4"), ("G", "H", "0", "10"), ("G", "I", "2", "9" * 40)])
    assert pair == {("E", "F"): (None, True), ("G", "H"): (10, False)} and scoped == set()


def test_scoped_rules_never_become_a_pairs(spark):
    rows = [("A", "B", "2", "30", "R1", "R2"), ("A", "B", "2", "45", "R1", "R2"), ("A", "B", "2", "75", "R3", "R4"), ("A", "B", "3", "0", "RX", "RY"), ("A", "B", "3", "0", "RX", "RY"), ("A", "B", "3", "0", "", " ", "T1", "T2")]
    pair, scoped = rules(spark, rows)
    assert pair == {} and scoped == {
        ("A", "B", "R1", "R2", None, None, None, 45, False), ("A", "B", "R3", "R4", None, None, None, 75, False),
        ("A", "B", "RX", "RY", None, None, None, None, True), ("A", "B", None, None, "T1", "T2", None, None, True),
    }


def test_linked_trips_need_both_trips(spark):
    rows = [("A", "B", "4", "90", "R1", "R2", "T1", "T2"), ("A", "B", "5", "120", "R3", "R4", "T3", "T4"), ("B", "C", "4", "60", "RX", "RY", "", "T5"), ("C", "D", "5", "60", "R7", "R8"), ("D", "E", "4", "60")]
    pair, scoped = rules(spark, rows)
    assert pair == {} and scoped == {("A", "B", "R1", "R2", "T1", "T2", "4", None, False), ("A", "B", "R3", "R4", "T3", "T4", "5", None, False)}


def edges(spark, rows):
    return {(r.pathway_id, r.from_id, r.to_id, r.back): (r.seconds, r.mode, r.length_m) for r in transfers.pathway_edges(spark.createDataFrame(rows, WAY)).collect()}


def test_pathways_are_directed_edges(spark):
    got = edges(spark, [("p1", "A", "B", "1", "1", "20", "40"), ("p2", "B", "C", "2", "0", "30", "55"), ("p3", "C", "D", "3", "1", "70", ""), ("flag", "K", "L", "1", "2", "10", "5"), ("neg", "I", "J", "1", "0", "-10", "-5")])
    assert got == {
        ("p1", "A", "B", False): (40, "1", 20.0), ("p1", "B", "A", True): (40, "1", 20.0), ("p2", "B", "C", False): (55, "2", 30.0),
        ("p3", "C", "D", False): (None, "3", 70.0), ("p3", "D", "C", True): (None, "3", 70.0), ("neg", "I", "J", False): (None, "1", None),
    }


def test_repeated_pathways_leave_the_shortest(spark):
    got = edges(spark, [("same", "A", "B", "1", "0", "20", ""), ("same", "A", "B", "1", "0", "20", "40"), ("same", "A", "B", "2", "0", "20", "25"), ("same", "A", "B", "1", "0", "20", "25"), ("other", "A", "B", "1", "0", "20", "40")])
    assert got == {("same", "A", "B", False): (25, "1", 20.0), ("other", "A", "B", False): (40, "1", 20.0)}


def test_pathways_override_walks_and_rules_bound_both(spark):
    pairs = "from_id string, to_id string"
    walks = spark.createDataFrame([("A", "B", 100), ("B", "A", 90), ("A", "C", 300), ("C", "A", 310), ("D", "A", 20)], f"{pairs}, walk_s long")
    near = spark.createDataFrame([("A", "B"), ("B", "A"), ("D", "A"), ("A", "D")], pairs)
    known = spark.createDataFrame([("A", "B", 60, False), ("A", "C", 400, False), ("D", "A", None, True), ("B", "D", 10, False)], f"{pairs}, min_s long, prohibited boolean")
    ways = transfers.pathway_edges(spark.createDataFrame([("p", "A", "B", "1", "0", "", "25"), ("q", "A", "B", "1", "0", "", "40"), ("r", "E", "A", "1", "0", "", "15"), ("s", "C", "A", "1", "0", "", "")], WAY))
    done = transfers.baked(walks, near, known, ways)
    assert {(r.from_id, r.to_id): (r.physical_s, r.fixed_s, r.eff_s, r.indoor) for r in done.collect()} == {
        ("A", "B"): (25, 60, 60, True), ("B", "A"): (90, 0, 90, False), ("A", "C"): (300, 400, 400, False), ("E", "A"): (15, 0, 15, True),
    }
    scoped = spark.createDataFrame([("A", "B", "R1"), ("C", "A", "R2"), ("D", "A", "R3"), ("A", "E", "R4")], f"{pairs}, from_route_id string")
    got = {r.from_route_id: (r.physical_s, r.indoor) for r in transfers.enriched(scoped, done, walks, ways).collect()}
    assert got == {"R1": (25, True), "R2": (None, False), "R3": (20, False), "R4": (None, False)}  # an untimed pathway is no reason to walk the street


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_cost_what_the_search_says(spark, seed):
    rng = random.Random(seed)
    graph = {(a, b): rng.randrange(1, 40) for a in range(40) for b in rng.sample(range(40), 3) if a != b}
    edge = spark.createDataFrame([(a, b, w) for (a, b), w in graph.items()], "src long, dst long, w_s long")
    snaps = {(r, rng.randrange(40)): rng.randrange(30) for r in range(4) for _ in range(3)}
    roots = spark.createDataFrame([(r, v, s) for (r, v), s in snaps.items()], "root long, node long, sec long")
    found = walkgraph.shortest(edge, roots, 200)
    cost = {(r.root, r.node): r.sec for r in found.collect()}
    got = {(r.root, r.node): r.path for r in walkgraph.node_paths(walkgraph.path_tree(edge, found, roots)).collect()}
    assert set(got) == set(cost) and max(map(len, got.values())) > 4
    for (root, node), path in got.items():
        assert path[-1] == node and snaps[root, path[0]] + sum(graph[a, b] for a, b in zip(path, path[1:], strict=False)) == cost[root, node]


def test_drawn_paths_have_both_ends_once(spark):
    place = "x_m long, y_m long"
    ways = spark.createDataFrame([(1, 7, 90, [0, 1, 2]), (2, 7, 5, [2])], "root long, id long, sec long, path array<long>")
    nodes = spark.createDataFrame([(0, 0, 0), (1, 10, 0), (2, 20, 0)], f"node_id long, {place}")
    starts, ends = spark.createDataFrame([(1, 0, 0), (2, 21, 1)], f"root long, {place}"), spark.createDataFrame([(7, 20, 5)], f"id long, {place}")
    assert {r.root: r.points for r in walkgraph.drawn(ways, nodes, starts, ends).collect()} == {1: "0 0,10 0,20 0,20 5", 2: "21 1,20 0,20 5"}
