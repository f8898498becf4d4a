"""Exact top-k by inner product, with multi-resolution segment statistics.

Vectors become integers. For every vector and for 1, 4 and 16 segments, the segment means and deviations are kept. By
Cauchy-Schwarz, sum over segments of (length * mean_q * mean_x + dev_q * dev_x) is at least q.x; in terms of distance,
|q|^2 + |x|^2 minus twice that bounds |q - x|^2 from below. Bounds go coarse to fine, each only over the pairs that the
coarser ones left; a pair whose bound is under the query's k-th best so far is out, and survivors get exact integer
scores. Nothing is approximate.

The rows are dealt by norm to parts of bounded size. A query first meets its own part, which gives a floor under its k-th best
score. It then meets only those other parts whose statistics (range of means, largest deviation) admit a score above the floor.
Queries travel to the parts, as rows behind the part's own rows in one sorted shuffle: a task holds one part and streams any
number of queries past it. Neither rows nor queries pass through the driver, and there is no loop over blocks.

Scores are exact at any size of the components: pairs whose products may exceed 2^52 are summed as whole numbers of any
length; a score beyond the range of a long counts as that range's end.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; vectors of different
lengths don't meet; a query excludes the rows of its own id, and an id on several rows asks once, with its smallest
vector; ties go to the smaller vec_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import materialize

K = 10
EVERY = 100
SCALE = 1024
SEGMENTS = (1, 4, 16)
PART_MB, LEAST_ROWS = 64, 2048
CHUNK = 4096
SALT_PARTS = 4096
SAFE = 2.0**26  # norms below this have inner products below 2^52, exact in doubles
LONG = (-(1 << 63), (1 << 63) - 1)
DENSE = 0.2


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, dim, mean, dev, norm) of the vectors that take part; v as doubles, not yet scaled."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", good) & (F.size("v") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim"))
    # from 2^50 on a double is a whole number by itself
    rows = rows.withColumn("_w", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)))
    total = lambda f: F.aggregate("_w", F.lit(0.0), lambda a, x: a + f(x))
    rows = rows.withColumn("mean", total(lambda x: x) / F.col("dim")).withColumn("_sq", total(lambda x: x * x))
    dev = F.sqrt(F.greatest(F.col("_sq") - F.col("dim") * F.col("mean") * F.col("mean"), F.lit(0.0)))
    return rows.select("vec_id", "v", "dim", "mean", F.nanvl(dev, F.lit(float("inf"))).alias("dev"), F.sqrt("_sq").alias("norm"))


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment lengths, means and deviation norms."""
    edges = np.unique(np.arange(segments) * x.shape[1] // segments)
    length = np.diff(np.append(edges, x.shape[1])).astype(float)
    mean = np.add.reduceat(x, edges, axis=1) / length
    square = np.add.reduceat(x * x, edges, axis=1) - length * mean * mean
    return length, mean, np.sqrt(np.maximum(square, 0))


def bound_factors(x: np.ndarray, query: bool) -> list[np.ndarray]:
    """For each resolution a matrix such that query factors times candidate factors bound the inner products from above."""
    out = []
    for s in SEGMENTS:
        length, mean, dev = statistics(x, s)
        out.append(np.concatenate((mean * length if query else mean, dev), axis=1))
    return out


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """Python integers floor(1024 * x); beyond 2^50 a double is a whole number already."""
    scaled = [[int(np.floor(x * SCALE)) if abs(x) < 2.0**50 else int(x) * SCALE for x in row] for row in v.tolist()]
    return np.array(scaled, object).reshape(v.shape)


class Best:
    """The k best (score, -vec_id) of each of some queries so far; scores under a query's floor are not kept."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k, self.floor = ids, k, floor.copy()
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def add(self, n: int, score: np.ndarray, vec: np.ndarray) -> None:
        keep = vec != self.ids[n]
        s, v = np.concatenate((self.found[n][0], score[keep])), np.concatenate((self.found[n][1], vec[keep]))
        if len(s) > self.k:
            cut = np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, v = s[s >= cut], v[s >= cut]
            order = np.lexsort((v, -1 - s))[: self.k]  # -1 - s keeps the order and can't overflow
            s, v = s[order], v[order]
            self.floor[n] = max(self.floor[n], float(s[-1]) - 1024 * (abs(float(s[-1])) > 2.0**53))
        self.found[n] = s, v

    def rows(self) -> pd.DataFrame:
        n = np.repeat(np.arange(len(self.ids)), [len(s) for s, _ in self.found])
        cat = lambda k: np.concatenate([f[k] for f in self.found]) if self.found else np.zeros(0, np.int64)
        return pd.DataFrame({"query_id": self.ids[n], "vec_id": cat(1), "score": cat(0)})


class Part:
    """Rows of one part and one dimension, largest norms first, with their factors at each resolution."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        with np.errstate(over="ignore"):
            x = np.floor(v * SCALE)
            norm = np.sqrt(np.square(x).sum(1))
        order = np.argsort(-norm, kind="stable")
        self.ids, self.v, norm, x = ids[order], v[order], norm[order], x[order]
        self.n_big = int((norm >= SAFE).sum())  # these come first
        self.x, self.norm = x[self.n_big :], norm[self.n_big :]
        self.factors = bound_factors(self.x, False) if len(self.x) else []
        self._whole: np.ndarray | None = None

    def whole(self) -> np.ndarray:
        if self._whole is None:
            self._whole = whole_numbers(self.v)
        return self._whole

    def _exact(self, q: np.ndarray, best: Best, n: int, upto: int) -> None:
        """All of the first `upto` rows, in whole numbers of any length."""
        scores = self.whole()[:upto].dot(whole_numbers(q[None, :])[0])
        best.add(n, np.array([min(max(s, LONG[0]), LONG[1]) for s in scores], np.int64), self.ids[:upto])

    def search(self, ids: np.ndarray, v: np.ndarray, floor: np.ndarray, k: int) -> Best:
        best = Best(ids, floor, k)
        with np.errstate(over="ignore"):
            q = np.floor(v * SCALE)
            norm = np.sqrt(np.square(q).sum(1))
        for n in np.flatnonzero(norm >= SAFE):
            self._exact(v[n], best, n, len(self.ids))
        small = np.flatnonzero(norm < SAFE)
        if self.n_big:
            for n in small:
                self._exact(v[n], best, n, self.n_big)
        if not len(self.x) or not len(small):
            return best
        q, norm = q[small], norm[small]
        mine = bound_factors(q, True)
        for a in range(0, len(self.x), CHUNK):
            b = min(a + CHUNK, len(self.x))
            least = best.floor[small] - 1e-9 * norm * self.norm[a] - 1e-6
            rows, cols = self._alive(mine, a, b, least)
            if not len(rows):
                continue
            if len(rows) > DENSE * len(small) * (b - a):  # a product of matrices is cheaper than most of its entries one by one
                every = q @ self.x[a:b].T
                score = every[rows, cols - a]
            else:
                score = np.concatenate([np.einsum("ij,ij->i", q[rows[s : s + 65536]], self.x[cols[s : s + 65536]]) for s in range(0, len(rows), 65536)])
            score, cut = score.astype(np.int64), np.searchsorted(rows, np.arange(len(small) + 1))
            for r in np.flatnonzero(np.diff(cut)):
                s, e = cut[r], cut[r + 1]
                best.add(int(small[r]), score[s:e], self.ids[self.n_big + cols[s:e]])
        return best

    def _alive(self, mine: list[np.ndarray], a: int, b: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row), by query, that no resolution rules out; a resolution looks only at what the coarser left."""
        bound = mine[0] @ self.factors[0][a:b].T
        rows, cols = np.nonzero(bound >= least[:, None])
        cols += a
        for own, theirs in zip(mine[1:], self.factors[1:], strict=True):
            if not len(rows):
                break
            if len(rows) > DENSE * len(own) * (b - a):
                bound = (own @ theirs[a:b].T)[rows, cols - a]
            else:
                bound = np.einsum("ij,ij->i", own[rows], theirs[cols])
            keep = bound >= least[rows]
            rows, cols = rows[keep], cols[keep]
        return rows, cols


def _meet(rows: DataFrame, queries: DataFrame, parts: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every query within every part it is sent to.

    rows: part, vec_id, v. queries: part, vec_id, v, floor.
    """
    both = rows.select("part", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("floor")).union(queries.select("part", F.lit(1).alias("kind"), "vec_id", "v", "floor"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, built = None, [], {}
        for frame in frames:
            keys = list(zip(frame["part"].tolist(), frame["kind"].tolist(), strict=True))
            upto = 0
            for (part, kind), run_ in groupby(keys):
                own = frame.iloc[upto : (upto := upto + len(list(run_)))]
                if part != at:
                    at, held, built = part, [], {}
                if kind == 0:
                    held.append((own["vec_id"].to_numpy(np.int64), own["v"].tolist()))
                    continue
                if held:
                    ids, lists = np.concatenate([i for i, _ in held]), [x for _, xs in held for x in xs]
                    dims = np.array([len(x) for x in lists])
                    built = {d: Part(ids[dims == d], np.stack([lists[i] for i in np.flatnonzero(dims == d)])) for d in np.unique(dims).tolist()}
                    held = []
                dims = own["v"].map(len).to_numpy()
                for d in np.unique(dims).tolist():
                    if d in built:
                        asked = own[dims == d]
                        floor = asked["floor"].astype("float64").fillna(-np.inf).to_numpy()
                        yield built[d].search(asked["vec_id"].to_numpy(np.int64), np.stack(asked["v"].tolist()), floor, k).rows()

    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "kind")
    return dealt.mapInPandas(run, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, part_mb: float = PART_MB, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose id is divisible by `every`, against all rows."""
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    n, numbers = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    parts = max(1, -(-numbers * 8 // int(part_mb * (1 << 20))), min(spark.sparkContext.defaultParallelism, n // least_rows))
    dealt = rows.repartitionByRange(parts, "dim", "norm", "vec_id").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "topk-parts")
    asked = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "part", "mean", "dev")).alias("s")).select("vec_id", "s.*")
    asked = materialize(asked, "topk-queries")
    found = materialize(_meet(dealt, asked.withColumn("floor", F.lit(None).cast("double")), parts, k), "topk-home")
    if parts > 1:
        floor = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= k)
        size = dealt.groupBy("part", "dim").agg(F.min("mean").alias("low"), F.max("mean").alias("high"), F.max("dev").alias("wide"))
        q = asked.withColumnRenamed("part", "home").join(floor.select("vec_id", "floor"), "vec_id", "left")
        # one row per query and part of its dimension, numbers alone, salted so that no dimension is one group
        salts = -(-parts // SALT_PARTS)
        q = q.select("vec_id", "home", "dim", "floor", F.col("mean").alias("m"), F.col("dev").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        met = q.join(size.withColumn("salt", F.col("part") % salts), ["dim", "salt"]).where("part <> home")
        mean = F.greatest(F.col("m") * F.col("low"), F.col("m") * F.col("high")) * F.col("dim")
        bound = mean + F.col("d") * F.col("wide") + (F.abs(mean) + F.col("d") * F.col("wide")) * 1e-9 + 1
        met = met.where(F.col("floor").isNull() | F.isnan(bound) | (bound >= F.col("floor"))).select("vec_id", "part", "floor")
        sent = met.join(asked.select("vec_id", "v"), "vec_id")
        found = found.union(_meet(dealt, sent, parts, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
