"""Whitening against numpy's eigenvectors, exact deviations, and awkward rows."""

import math

import numpy as np
import pytest

from wayfold.llm import whitening
from wayfold.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, vectors, schema=SCHEMA):
    prepare(spark)
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in enumerate(vectors)], schema)


def integers(vectors):
    return np.floor(64 * np.array(vectors, np.float32).astype(np.float64)) + 1_000_000


def check(vectors, rows, dim):
    """rows: of whiten(); vectors: those that take part, by id."""
    x = integers(list(vectors.values()))
    n, sums = len(x), x.astype(np.int64).sum(axis=0)
    centred = x - x.mean(axis=0)
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    kept = min(32, int((values > 1e-9 * values[0]).sum()))
    got = {(r.vec_id, r.component): r for r in rows}
    assert set(got) == {(i, c) for i in vectors for c in range(1, kept + 1)} and len(rows) == len(got)
    for k, i in enumerate(vectors):
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k].astype(np.int64), sums, strict=True))
        assert all(got[i, c].deviation == exact and got[i, c].n == n for c in range(1, kept + 1))
    for c in range(kept):
        want = centred @ parts[:, c] / math.sqrt(values[c])
        mine = np.array([got[i, c + 1].whitened for i in vectors])
        gap = min(abs(values[c] - values[o]) for o in range(dim) if o != c) / values[0]
        if gap > 1e-6:
            assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert abs(got[next(iter(vectors)), c + 1].explained / (values[c] / values.sum()) - 1) < 1e-9
    assert all(r.identity_error < 1e-9 for r in rows)


@pytest.mark.parametrize(("n", "dim"), [(300, 40), (60, 8), (20, 40)])
def test_whitening_equals_eigenvectors(spark, n, dim):
    rng = np.random.default_rng(n)
    vectors = (rng.standard_normal((n, dim)) * np.geomspace(8, 0.5, dim)).tolist()
    df = frame(spark, vectors).repartition(3)
    check(dict(enumerate(vectors)), whitening.whiten(df, whitening.fit(df)).collect(), dim)


def test_whitening_on_the_given_table(spark):
    prepare(spark)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    check(vectors, whitening.whiten(df, whitening.fit(df)).collect(), 64)


def test_whitening_of_repeated_eigenvalues(spark):
    """Four equal variances: any basis will do, so the whitened rows must have the identity as covariance."""
    vectors = [[s * (k == d) for k in range(4)] for d in range(4) for s in (1, -1)]
    df = frame(spark, vectors)
    model = whitening.fit(df)
    rows = whitening.whiten(df, model).collect()
    w = np.zeros((8, 4))
    for r in rows:
        w[r.vec_id, r.component - 1] = r.whitened
    assert len(rows) == 32 and np.abs(w.T @ w / 8 - np.outer(w.mean(0), w.mean(0)) - np.eye(4)).max() < 1e-10


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = rng.standard_normal((30, 3)).tolist()
    odd = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 0.0], [1.0, 2.0]]
    df = frame(spark, good + odd).selectExpr("vec_id", "embedding", "'x' AS component", "'x' AS n", "'x' AS whitened")
    twice = df.union(df.where("vec_id < 2"))
    check(dict(enumerate(good)), whitening.whiten(df, whitening.fit(df)).collect(), 3)
    assert whitening.whiten(twice, whitening.fit(twice)).count() == 32 * 3
    named = whitening.whiten(df.selectExpr("nullif(vec_id, 0) AS vec_id", "embedding"), whitening.fit(df))
    assert named.where("vec_id is null").count() == 3
    for empty in (df.limit(0), frame(spark, [[1.0, 2.0]] * 5), frame(spark, [[1.0, 2.0]])):
        assert whitening.whiten(empty, whitening.fit(empty)).collect() == []


def test_whitening_of_constant_and_large_entries(spark):
    """A constant dimension has no component; a deviation beyond a long is null, and those within are exact."""
    vectors = [[float(k % 5), 7.0, float(k % 3) * 1000] for k in range(40)]
    df = frame(spark, vectors)
    check(dict(enumerate(vectors)), whitening.whiten(df, whitening.fit(df)).collect(), 3)
    large = frame(spark, [[1e15, 1.0], [2e15, 2.0], [3e15, 4.0]])
    rows = whitening.whiten(large, whitening.fit(large)).collect()
    assert {r.vec_id: r.deviation for r in rows}[0] is None and all(math.isfinite(r.whitened) for r in rows)
