"""Queries on tables repeated with shifted keys, so that stops and cells share their points and ids are large, against their SQL."""

import os

import pytest

import __spark_entry__ as entry
from wayfold.plans import registry
from wayfold.sources.network import Network

SOURCE = "/root/testdata/sf0.001"
#: Stops are floor(part / 5) and points repeat every 6000 ids: so these shifts put every copy on the points of the first. Patterns hold trips of all copies.
SHIFTS = {"o_orderkey": 100_000_003, "l_orderkey": 100_000_003, "o_custkey": 6000, "c_custkey": 6000, "l_partkey": 30_000, "p_partkey": 30_000, "s_suppkey": 10}
COPIES = 3
#: Queries that find things once for a place.
QUERIES = (
    "g08_offgrid_access",
    "g06_transfer_bake",
    "k16_station_closure",
    "k05_itinerary_minutes",
    "k06_itinerary",
    "a18_stop_statistics",
    "s16_origins_to_results",
    "k01_access_selection",
    "j18_scoped_enrichment",
    "g06_transfers_with_pathways",
    "g07_access_bake",
    "g04_snap_argmin",
    "g03_drawn_paths",
    "v07_readiness",
    "s12_access_archive",
    "j11_next_committed_trip",
    "j09_knn_snap",
    "w05_first_argmin",
    "r10_arrive_by",
)


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """A folder of tables, COPIES times those of sf0.001."""
    out = str(tmp_path_factory.mktemp("copies"))
    for t in "region nation customer supplier part orders lineitem events".split():
        rows = spark.read.parquet(f"{SOURCE}/{t}.parquet")
        shifted = [rows.withColumns({c: rows[c] + k * SHIFTS[c] for c in rows.columns if c in SHIFTS}) for k in range(COPIES if t not in ("region", "nation") else 1)]
        every = shifted[0]
        for more in shifted[1:]:
            every = every.union(more)
        every.select(*(every[c].cast(rows.schema[c].dataType) for c in rows.columns)).coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return out


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def agrees(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in os.listdir(folder):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{t}/*.parquet')")
    told = db.execute(registry.ORACLES[name])
    names = [c[0] for c in told.description]
    order = sorted(range(len(names)), key=names.__getitem__)  # columns go by name
    want = sorted(repr(tuple(plain(r[k]) for k in order)) for r in told.fetchall())
    rows = entry.queries()[name](spark, folder)
    got = sorted(repr(tuple(map(plain, r))) for r in rows.select(*sorted(names)).collect())
    assert got == want and want


def test_trip_of_a_large_id_as_in_the_sql(spark, copied):
    """j07: ids over a million count in dep_s * 1000000 + trip_id."""
    agrees(spark, copied, "j07_latest_trip")


def test_pairs_do_not_grow_with_copies_on_one_point(spark, copied):
    """What searches and cells join are pairs of places: as many as in one copy, whatever the number of rows on a point."""
    one, three = Network(spark, SOURCE), Network(spark, copied)
    assert three.stop.count() == COPIES * one.stop.count() and three.cell.count() == COPIES * one.cell.count()
    assert three.reach.pairs.count() == one.reach.pairs.count() == one.access.count()
    assert three.footpaths.pairs.count() == one.footpaths.pairs.count() == one.transfer.count() + one.stop.count()
    assert three.access.count() == COPIES**2 * one.access.count()


@pytest.mark.parametrize("name", QUERIES)
def test_agrees_with_its_sql_where_points_are_shared(spark, copied, name):
    agrees(spark, copied, name)
