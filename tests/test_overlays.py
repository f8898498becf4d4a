"""Service days, contracts, replays shared by cells, routes within the window, committed rides and recommendations on small cases."""

import random

import pytest

from wayfold.operators import calendars, planned, reliability, selection, transfers, validate
from tests.test_selection import frame, option

CALENDAR = "feed long, service_id string, wednesday string, start_date string, end_date string"
DATES = "feed long, service_id string, date string, exception_type string"


def day(spark, calendar, dates, trips):
    found = calendars.common_day(spark.createDataFrame(calendar, CALENDAR), spark.createDataFrame(dates, DATES), spark.createDataFrame([(t,) for t in trips], "service_id string"))
    return found.collect()[0].service_date


def test_common_day_waits_for_all_feeds(spark):
    regular = [(0, "a", "1", "20240101", "20240331"), (1, "b", "1", "20240110", "20240228")]
    assert day(spark, regular, [], "ab") == "20240117"  # a Wednesday itself, seven days after the later start
    removed = [(1, "b", "20240117", "2")]
    assert day(spark, regular, removed, "ab") == "20240124"
    only_dates = [(2, "c", "20240131", "1"), (2, "c", "20240201", "1")]  # a feed that has exceptions only
    assert day(spark, regular, removed + only_dates, "abc") == "20240131"


def test_common_day_needs_trips_and_a_shared_range(spark):
    regular = [(0, "a", "1", "20240101", "20240331"), (1, "b", "1", "20240110", "20240228")]
    assert day(spark, regular, [], "a") is None
    assert day(spark, regular, [(2, "c", "20240306", "1")], "abc") is None  # beyond the earliest end
    assert day(spark, [], [], "") is None


def violated(df):
    return {r.code: r.violations for r in df.collect() if r.violations}


def test_walk_graph_faults(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 0), (2, 5, 5, None), (3, 1, 1, 1), (3, 1, 1, 1)], "node_id long, x_m long, y_m long, elev_m long")
    edges = spark.createDataFrame([(1, 2, 5), (2, 1, 5), (1, 9, 3), (9, 8, 1), (3, 1, -1), (3, 1, 4)], "src long, dst long, w_s long")
    assert violated(validate.walk_graph(nodes, edges)) == {"repeated_node": 1, "bad_node": 1, "dangling_edge": 2, "bad_weight": 1, "repeated_edge": 1, "one_way": 4}
    assert violated(validate.walk_graph(nodes.where("node_id = 1"), edges.where("false"))) == {"empty": 1}


def test_access_contract_faults(spark):
    cells = spark.createDataFrame([(1,), (2,)], "cell_id long")
    stops = spark.createDataFrame([(7,), (8,)], "stop_id long")
    access = spark.createDataFrame([(1, 7, 10), (1, 7, 10), (5, 7, 950), (1, 9, None)], "cell_id long, stop_id long, walk_s long")
    assert violated(validate.access_contract(cells, stops, access, 900)) == {"unknown_cell": 1, "unknown_stop": 1, "bad_weight": 1, "over_cap": 1, "repeated_pair": 1, "cell_without_stop": 1, "stop_without_cell": 1}


def test_transfer_views(spark):
    stops = spark.createDataFrame([(1, 0, 0), (2, 100, 1), (3, 900, 0)], "stop_id long, x_m long, y_m long")
    walks = spark.createDataFrame([(1, 2, 76), (2, 1, 76)], "from_id long, to_id long, walk_s long")
    rules = spark.createDataFrame([(1, 2, 120, False), (2, 1, None, False)], "from_id long, to_id long, min_s long, prohibited boolean")
    forward = transfers.costed(walks, rules)
    assert {(r.from_id, r.to_id, r.walk_s, r.cost_s) for r in forward.collect()} == {(1, 2, 76, 120), (2, 1, 76, 76)}
    turned = lambda df: df.selectExpr("to_id AS at_id", "from_id AS of_id", "cost_s")
    assert violated(validate.transfer_views(forward, turned(forward), rules, stops, 600, 0.75)) == {"raised": 1}  # 75.75 rounds half up
    bad = spark.createDataFrame([(1, 2, 75, 75), (1, 3, 675, 675)], "from_id long, to_id long, walk_s long, cost_s long")
    assert violated(validate.transfer_views(bad, turned(forward), rules, stops, 600, 0.75)) == {"forward_only": 2, "reverse_only": 2, "wrong_walk": 1, "below_minimum": 1, "out_of_reach": 1}
    never = rules.selectExpr("from_id", "to_id", "min_s", "true AS prohibited")
    assert transfers.costed(walks, never).isEmpty()


def test_shared_replays_equal_single_ones(spark):
    rng = random.Random(5)
    times = [(d, p, t, pos, pos + 10 * p, 1000 + 300 * t + 90 * pos + rng.randrange(60), 1000 + 300 * t + 90 * pos + 60) for d in range(3) for p in range(3) for t in range(6) for pos in range(5)]
    times = spark.createDataFrame(times, "draw_id long, pattern_id long, trip_id long, pos long, stop_id long, arr_s long, dep_s long")
    retained = [(d, s, at, at - 400 - rng.randrange(100)) for d in range(3) for s in range(0, 25) if s % 4 for at in range(1200, 4000, 300)]
    retained = spark.createDataFrame(retained, "draw_id long, stop_id long, deadline_s long, latest_s long")
    commits = []
    for cell in range(60):
        b = rng.randrange(4)
        commits.append((cell, 900 + 60 * rng.randrange(25), 60 * rng.randrange(4), rng.randrange(3), b, rng.randrange(b + 1, 5)))
    commits = spark.createDataFrame(commits, "cell_id long, home_s long, walk_s long, pattern_id long, bpos long, apos long")
    each = reliability.scored(reliability.next_committed(commits, times), retained)
    once = reliability.replayed_once(commits, times, retained, ("cell_id",))
    rows = lambda df: sorted((r.draw_id, r.cell_id, r.minutes) for r in df.collect())
    assert rows(once) == rows(each) and len(rows(once)) > 50


def test_routes_within_the_window(spark):
    access = spark.createDataFrame([(1, 7, 60), (1, 8, 0), (1, 9, 0), (2, 9, 0)], "cell_id long, stop_id long, walk_to_s long")
    template = spark.createDataFrame([(7, 100, 540), (8, 100, 600), (9, 100, 1201)], "stop_id long, deadline_s long, tail_s long")
    tail = spark.createDataFrame([(7, 100, 1, "L1", "5:0-2"), (8, 100, 1, "L1", "4:0-2"), (9, 100, 2, "L2 > L3", "6:0-1>7:0-1"), (7, 999, 1, "L9", "9:0-1")], "stop_id long, deadline_s long, rides long, route string, shape string")
    base = spark.createDataFrame([(1, 600), (2, 1000)], "cell_id long, raw_s long")
    found = {(r.cell_id, r.route): (r.minutes, r.stop_id) for r in planned.planned_window(access, template, tail, base, 10).collect()}
    # equal minutes: the smaller shape stands for the label; 1201 s is 21 minutes, one more than the window of cell 1
    assert found == {(1, "L1"): (10, 8), (2, "L2 > L3"): (21, 9)}


@pytest.mark.parametrize("first_ride, folded, tiny", [(119, 2, True), (120, 1, False)])
def test_short_hops_fold(spark, first_ride, folded, tiny):
    schema = "deadline_s long, origin long, leg long, kind string, from_stop long, to_stop long, v long, dep_s long, arr_s long, pattern_id long, trip_id long, bpos long, apos long"
    legs = [(9000, 1, 0, "ride", 1, 2, 1000, 1000, 1000 + first_ride, 1, 1, 0, 1), (9000, 1, 1, "ride", 2, 3, 2000, 2000, 3000, 2, 2, 0, 3), (9000, 1, 2, "egress", 3, None, 8900, 8900, None, None, None, None, None)]
    times = spark.createDataFrame([(2, 2, 3, 3, 3000)], "pattern_id long, trip_id long, pos long, stop_id long, arr_s long")
    egress = spark.createDataFrame([(3, 100)], "stop_id long, walk_s long")
    row = planned.committed_rides(spark.createDataFrame(legs, schema), times, egress).collect()
    assert [(r.stop_id, r.pattern_id, r.bpos, r.apos, r.folded_pattern, r.tiny) for r in row] == [(1, 1, 0, 1, folded, tiny)]


def test_recommendations_differ_when_delays_count(spark):
    rows = [option(1, "P", minutes=20, frag=9, primary=True), option(1, "Q", branch="U", minutes=23, frag=1), option(2, "R", minutes=20)]
    found = {r.cell_id: r for r in selection.recommended(frame(spark, rows)).collect()}
    assert found[1].map_choice_key == found[1].scheduled_choice_key != found[1].typical_choice_key
    assert '"lines":["Q"]' in found[1].typical_choice_key
    assert found[2].map_choice_key is None and found[2].typical_choice_key == found[2].scheduled_choice_key


def test_options_take_fragility(spark):
    branch = spark.createDataFrame([(1, "a", "L", "1:0-2", "1:0-2", 600, 60, 0, 0, 60, 300, 5000), (1, "b", "M", "2:0-2", "2:0-2", 601, 60, 0, 0, 60, 300, 5000)], "cell_id long, shape string, route string, seg string, last_seg string, total_s long, access_s long, transfers long, hop_s long, out_s long, ride_s long, dep_s long")
    base = spark.createDataFrame([(1, 600, 7)], "cell_id long, raw_s long, stop_id long")
    frag = spark.createDataFrame([(1, "b", 4)], "cell_id long, shape string, frag long")
    assert {(r.shape, r.frag_min) for r in selection.options(branch, base, frag).collect()} == {("a", 0), ("b", 4)}


def test_branches_by_a_deadline(spark):
    tail = "stop_id long, v long, rides long, route string, shape string, pattern_id long, trip_id long, bpos long, ride_dep_s long, seg string, last_seg string, foot_s long, hop_s long, out_s long, ride_s long"
    label = lambda stop, v, shape, rides=1: (stop, v, rides, "L", shape, 1, 1, 0, v, shape, shape, 0, 0, 60, 300)
    tails = spark.createDataFrame([label(7, 8400, "1:0-2"), label(8, 8340, "1:0-2"), label(9, 7800, "2:0-2"), label(6, 9000, "", 0), label(5, 8100, "3:0-2", 2)], tail)
    access = spark.createDataFrame([(1, 7, 60), (1, 8, 0), (1, 9, 0), (1, 6, 0), (1, 5, 0), (2, 7, 0)], "cell_id long, stop_id long, walk_to_s long")
    afoot = spark.createDataFrame([(1, 700), (2, 500), (3, 900)], "cell_id long, walk_only_s long")
    found, base = planned.branches_by(access, tails, afoot, 9000, 5)
    # equal seconds: the shorter walk; stop 9 is ten minutes slower; a label without a ride is no branch; walking wins for cells 2 and 3
    assert {(r.cell_id, r.shape, r.stop_id, r.total_s, r.transfers) for r in found.collect()} == {(1, "1:0-2", 8, 660, 0), (1, "3:0-2", 5, 900, 1), (2, "1:0-2", 7, 600, 0)}
    assert {(r.cell_id, r.raw_s, r.stop_id) for r in base.collect()} == {(1, 660, 8), (2, 500, None), (3, 900, None)}
