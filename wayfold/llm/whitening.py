"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

A is the matrix of centred rows. Each step is one pass of the table: every task forms its rows' part of u = A q and adds up
A'u, U'u and u'u, so only sums of a vector's length meet at the driver. Earlier u stand as A times a coefficient vector, so
U'u is summed in the same pass and no column of U, which has an entry for every row, is ever stored or moved. New u and v are
orthogonalised against all earlier ones; where much of u is removed, the step is repeated with what is left ("twice is
enough"). The bidiagonal matrix that results is small; its singular vectors turn the v into components, its singular values
into deviations. Steps end when the wanted components have residuals at rounding level, at the latest after as many
steps as there are dimensions. A step that breaks down (an invariant subspace, a repeated eigenvalue) goes on with a new
direction orthogonal to all so far.

Rows enter as y = floor(64 c), which differs from x = y + 1000000 by a constant, so centred values, covariances and
n*x - S are the same; sums of y are exact integers.

Defined cases: vectors that are null, empty, or hold null or non-finite entries take no part. Where lengths differ, those of the
most frequent length take part (ties: the longer). Entries beyond +-2^62 after scaling count as that bound. Components
without variance (fewer rows than components, constant dimensions) have no whitened value and are left out, so a table
of equal vectors, like an empty one, gives no rows. A deviation that no long can hold is null. Repeated rows and ids stay
separate rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
SHIFT = 1_000_000  # x = y + SHIFT; it cancels in everything that is returned
COMPONENTS = 32
LARGEST = 2.0**62
HALF = 31
BATCH_ROWS = 8192
#: A residual, or a direction's length, that is rounding error beside the largest singular value.
ROUNDING = 1e-14
NO_VARIANCE = 1e-11
SEED = 11
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n fitted rows of `dim` entries; exact sums of y; components as columns; their variances; the variance of all dimensions."""

    n: int
    dim: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    steps: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)


@contextmanager
def _batches(df: DataFrame, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs that run inside; the session's setting is put back."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(rows))
    try:
        yield
    finally:
        conf.set(key, before)


def scaled(column: pa.Array, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, y as floats) of a batch's usable vectors of `dim` entries, or of each length."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    starts = np.cumsum(sizes) - sizes
    for size in [dim] if dim else np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        y = flat[starts[at][:, None] + np.arange(size)]
        good = np.isfinite(y).all(axis=1)
        if good.any():
            yield at[good], np.clip(np.floor(SCALE * y[good]), -LARGEST, LARGEST)


def _summed(vectors: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of of(y) over all batches: each task adds up its own, Spark the tasks'."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for _, y in scaled(part.column(0), dim):
                own = of(y)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "x"])

    rows = vectors.mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["k"]] = r["x"]
    return out


def _exact_sums(vectors: DataFrame) -> tuple[int, int, list[int]] | None:
    """(n, dim, sums of y) of the vectors that take part. Sums are added as halves, so that longs hold them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for _, y in scaled(part.column(0)):
                whole = y.astype(np.int64)
                own = np.concatenate(([len(y)], (whole >> HALF).sum(axis=0), (whole & ((1 << HALF) - 1)).sum(axis=0)))
                dim = y.shape[1]
                total[dim] = total[dim] + own if dim in total else own
        for dim, own in total.items():
            k = np.arange(len(own), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim, np.int32)), pa.array(k), pa.array(own)], ["dim", "k", "x"])

    sums = vectors.mapInArrow(run, "dim int, k int, x long").groupBy("dim", "k").agg(F.sum("x").alias("x"))
    best = sums.where("k = 0").orderBy(F.desc("x"), F.desc("dim")).first()
    if best is None:
        return None
    dim, found = best["dim"], {r["k"]: r["x"] for r in sums.where(F.col("dim") == best["dim"]).collect()}
    return found[0], dim, [(found[1 + k] << HALF) + found[1 + dim + k] for k in range(dim)]


def _orthogonal(w: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    for _ in range(2 if to else 0):
        basis = np.array(to)
        w = w - basis.T @ (basis @ w)
    return w


def fit(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Whitening | None:
    """The leading components of the covariance (divisor n) of all usable vectors; None where nothing varies."""
    vectors = embeddings.select(column)
    with _batches(vectors):
        found = _exact_sums(vectors)
        if found is None:
            return None
        n, dim, sums = found
        mean = np.array([s / n for s in sums])
        total = float(_summed(vectors, dim, lambda y: np.array([np.square(y - mean).sum()]))[0])
        if total <= 0:
            return None
        return _bidiagonalise(vectors, n, dim, sums, mean, total, components)


def _bidiagonalise(vectors: DataFrame, n: int, dim: int, sums: list[int], mean: np.ndarray, total: float, wanted: int) -> Whitening:
    size = np.sqrt(total)  # of A, so every singular value is at most this
    rng = np.random.default_rng(SEED)

    def products(q: np.ndarray, earlier: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """u'u, A'u and U'u for u = A q."""

        def own(y: np.ndarray) -> np.ndarray:
            rows = y - mean
            u = rows @ q
            return np.concatenate(([u @ u], u @ rows, u @ (rows @ earlier)))

        out = _summed(vectors, dim, own)
        return float(out[0]), out[1 : 1 + dim], out[1 + dim :]

    v = rng.standard_normal(dim)
    v /= np.linalg.norm(v)
    vs, ps, zs, alphas, betas = [v], [], [], [], []
    while True:
        p_all = np.array(ps).T if ps else np.zeros((dim, 0))
        q = vs[-1] - betas[-1] * ps[-1] if ps else vs[-1]
        square, z, along = products(q, p_all)
        if along @ along > 0.01 * square:  # much was removed: once more with what is left
            q = q - p_all @ along
            square, z, along = products(q, p_all)
        left = square - along @ along
        if left > (NO_VARIANCE * size) ** 2:
            alpha = np.sqrt(left)
            p, z = (q - p_all @ along) / alpha, (z - np.array(zs).T @ along if zs else z) / alpha
        else:  # A v lies in the span of the earlier u
            alpha, p, z = 0.0, np.zeros(dim), np.zeros(dim)
        alphas.append(alpha)
        ps.append(p)
        zs.append(z)
        w = _orthogonal(z - alpha * vs[-1], vs)
        beta = float(np.linalg.norm(w))
        k = len(alphas)
        small_u, s, small_v = np.linalg.svd(np.diag(alphas) + np.diag(betas[: k - 1], 1))
        residuals = beta * np.abs(small_u[-1])
        if k == dim or k >= wanted and (residuals[:wanted] <= ROUNDING * s[0]).all() and beta > ROUNDING * size:
            break
        if beta <= ROUNDING * size:
            beta, w = 0.0, _orthogonal(rng.standard_normal(dim), vs)
        betas.append(beta)
        vs.append(w / np.linalg.norm(w))
    kept = min(wanted, int((s > NO_VARIANCE * size).sum()))
    parts = np.array(vs).T @ small_v.T[:, :kept]
    return Whitening(n, dim, sums, parts / np.linalg.norm(parts, axis=0), np.square(s[:kept]) / n, total / n, k)


def identity_error(embeddings: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    mean, onto = model.mean, model.projection
    k = onto.shape[1]

    def own(y: np.ndarray) -> np.ndarray:
        w = (y - mean) @ onto
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    vectors = embeddings.select(column)
    with _batches(vectors):
        out = _summed(vectors, model.dim, own) / model.n
    return float(np.abs(out[k:].reshape(k, k) - np.outer(out[:k], out[:k]) - np.eye(k)).max())


def deviations(y: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n*y - sum)^2 for each row, exact."""
    bound = n * float(np.abs(y).max()) + max(abs(s) for s in sums)
    if y.shape[1] * bound**2 < 2.0**62:
        return pa.array(np.square(n * y.astype(np.int64) - np.array(sums, np.int64)).sum(axis=1))
    exact = np.square(n * y.astype(np.int64).astype(object) - np.array(sums, object)).sum(axis=1)
    return pa.array([d if d < 1 << 63 else None for d in exact.tolist()], pa.int64())


def whiten(embeddings: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """One row per usable vector and component; the model's small arrays travel with the task."""
    if model is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    error, mean, onto = identity_error(embeddings, model, column), model.mean, model.projection
    explained, k = model.variances / model.trace, onto.shape[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, y in scaled(part.column(1), model.dim):
                rows = np.repeat(np.arange(len(at)), k)
                columns = [
                    part.column(0).take(pa.array(at[rows])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(rows), model.n)),
                    deviations(y, model.n, model.sums).take(pa.array(rows)),
                    pa.array(((y - mean) @ onto).ravel()),
                    pa.array(np.tile(explained, len(at))),
                    pa.array(np.full(len(rows), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return embeddings.select(F.col("vec_id").cast("long"), column).mapInArrow(run, SCHEMA)
