"""SimHash near-duplicates through a Gray-order hierarchical index.

1. fingerprint: 64 majority bits over the XXH64 of every 3-word shingle (repeats included), window by window of a text.
2. Distinct fingerprints are range-partitioned and sorted by Gray rank, so that neighbours share bit patterns. Runs of
   at most `leaf` fingerprints with a common prefix form a leaf, which knows the bits all its members agree on (those where the
   AND and the OR of its members are alike). Leaves with the same first half of the prefix form an upper node, which factors out
   the bits that all of them share.
3. Upper nodes meet through an equi-join on half prefixes that differ in at most `distance` bits. A pair of nodes is pruned
   whole when its shared patterns differ in more. What survives goes down with the differences it has used up: leaves
   meet through an equi-join on the second half, which may only differ in the bits that are left, and are pruned by their own
   shared patterns. So far all rows are numbers; only surviving pairs of leaves fetch their members, which are compared exactly, and
   each comparison emits a spanning forest of its links, at most one row per member.
4. Components: minimum labels with pointer jumping over the links, each round written to the shared folder.

Prefixes grow with the logarithm of the number of fingerprints, so leaves stay small at any size. No step holds more than two
leaves at a time and no candidate is capped. Exact copies meet in an aggregation before the index, so a
group of copies of any size is one fingerprint. Fingerprints are kept as signed longs with the same bits.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer than three words hash the
whole sequence; repeated rows stay separate rows; rows without a doc_id link others and get their component's id; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import loose_id, materialize, solid_id

DISTANCE = 2
LEAF = 256
SHINGLE = 3
SEED = 42
WINDOW = 1 << 19
SPACE = re.compile(rb"[\t-\r ]")
PER_PREFIX = 64
HOT_ROWS = 100_000


def word_windows(raw: bytes, window: int) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; windows end at white space."""
    at = 0
    while at < len(raw):
        end = at + window
        if end < len(raw):
            space = SPACE.search(raw, end)
            end = space.start() if space else len(raw)
        yield raw[at:end].split()  # bytes split at \x20 and \x09-\x0D, and nowhere else
        at = end


def fingerprint_of(text: str | None, window: int = WINDOW) -> int:
    """Signed 64-bit SimHash of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z only
    ones, total, held, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for new in word_windows(raw, window):
        words = held + new
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
            hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        held = words[1 - SHINGLE :]
    if not total:
        if not held:
            return 0
        hashes = np.array([digest(b" ".join(held), SEED)], np.uint64)
        ones, total = np.unpackbits(hashes.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row."""
    kept = docs.select(solid_id(F.col("doc_id")).alias("doc_id"), "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fps = np.fromiter(map(fingerprint_of, part["text"]), np.int64, len(part))
            yield pd.DataFrame({"doc_id": part["doc_id"], "fp": fps})

    return kept.mapInPandas(run, "doc_id long, fp long").select(loose_id(F.col("doc_id")).alias("doc_id"), "fp")


def gray_rank(fp):
    """Rank of a fingerprint in Gray order, as a signed long that sorts like the unsigned rank."""
    rank = fp
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _leaves(classes: DataFrame, bits: int, leaf: int) -> DataFrame:
    """Leaf rows from (fp, rep), in Gray order."""
    ordered = classes.withColumn("rank", gray_rank(F.col("fp"))).repartitionByRange("rank").sortWithinPartitions("rank")

    def rows(fp: np.ndarray, rep: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
        prefix = fp.view(np.uint64) >> np.uint64(64 - bits)
        cut = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        size = np.diff(np.concatenate((cut, [len(fp)])))
        cut = np.concatenate([np.arange(a, a + n, leaf) for a, n in zip(cut, size, strict=True)])
        both, any_ = np.bitwise_and.reduceat(fp, cut), np.bitwise_or.reduceat(fp, cut)
        at = np.split(np.arange(len(fp)), cut[1:])
        return pd.DataFrame({"prefix": prefix[cut].astype(np.int64), "leaf": rank[cut], "all_": both, "any_": any_, "fps": [fp[i] for i in at], "reps": [rep[i] for i in at]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield rows(*(part[c].to_numpy(np.int64) for c in ("fp", "rep", "rank")))

    return ordered.select("fp", "rep", "rank").mapInPandas(run, "prefix long, leaf long, all_ long, any_ long, fps array<long>, reps array<long>")


def forest(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within or between two leaves, thinned to one per member: each to the smallest rep it reaches here."""
    differ = (a[:, None] ^ b[None, :]).view(np.uint64)  # signed numbers would be counted by their absolute value
    near = np.bitwise_count(differ) <= distance
    rows, cols = near.any(1), near.any(0)
    if not rows.any():
        return ra[:0], ra[:0]
    near, ra, rb = near[np.ix_(rows, cols)], ra[rows], rb[cols]
    big = np.int64(np.iinfo(np.int64).max)
    la = ra.copy()
    while True:
        lb = np.minimum(rb, np.where(near, la[:, None], big).min(0))
        new = np.minimum(la, np.where(near, lb[None, :], big).min(1))
        if (new == la).all():
            break
        la = new
    u, v = np.concatenate((ra, rb)), np.concatenate((la, lb))
    return u[u != v], v[u != v]


def _flips(bits: int, distance: int) -> Column:
    """array<long>: every choice of at most `distance` of the lowest bits."""
    return F.array(*(F.lit(sum(1 << k for k in c)).cast("long") for d in range(distance + 1) for c in combinations(range(bits), d)))


def _accumulated(a: str, b: str) -> Column:
    """Bits in which all members of one group differ from all members of the other."""
    x = lambda c, side: F.col(f"{c}_{side}")
    shared = F.bitwise_not(x("all", a).bitwiseXOR(x("any", a))).bitwiseAND(F.bitwise_not(x("all", b).bitwiseXOR(x("any", b))))
    return F.bit_count(x("all", a).bitwiseXOR(x("all", b)).bitwiseAND(shared))


def leaf_pairs(leaves: DataFrame, bits: int, distance: int) -> DataFrame:
    """(leaf_a, leaf_b): pairs of leaves that may hold a link, each once, a leaf with itself included."""
    low = bits - bits // 2
    heads = leaves.select("prefix", "leaf", F.col("all_").alias("all"), F.col("any_").alias("any"), F.shiftright("prefix", low).alias("node"))
    nodes = materialize(heads.groupBy("node").agg(F.bit_and("all").alias("all"), F.bit_or("any").alias("any")), "simhash-nodes")
    side = lambda df, x: df.select(*(F.col(c).alias(f"{c}_{x}") for c in df.columns))
    up = side(nodes, "a").withColumn("flip", F.explode(_flips(bits - low, distance))).withColumn("node_b", F.col("node_a").bitwiseXOR(F.col("flip"))).where("node_a <= node_b")
    met = up.join(side(nodes, "b"), "node_b").where(_accumulated("a", "b") <= distance)
    met = met.select("node_a", "node_b", F.bit_count(F.col("node_a").bitwiseXOR(F.col("node_b"))).alias("used"))
    left = F.element_at(F.array(*(_flips(low, distance - d) for d in range(distance + 1))), F.col("used") + 1)
    down = side(heads, "a").join(met, "node_a").select("prefix_a", "leaf_a", "all_a", "any_a", "node_a", "node_b", F.explode(left).alias("flip"))
    second = F.col("prefix_a").bitwiseAND(F.lit((1 << low) - 1)).bitwiseXOR(F.col("flip"))
    down = down.withColumn("prefix_b", F.shiftleft("node_b", low).bitwiseOR(second)).where("prefix_a <= prefix_b")
    hit = down.drop("node_b").join(side(heads, "b"), "prefix_b").where((_accumulated("a", "b") <= distance) & ((F.col("prefix_a") != F.col("prefix_b")) | (F.col("leaf_a") <= F.col("leaf_b"))))
    return hit.select("leaf_a", "leaf_b")


def links(classes: DataFrame, distance: int = DISTANCE, leaf: int = LEAF) -> DataFrame:
    """(u, v): reps of fingerprints connected within `distance` bits; enough of them to span every component."""
    n = classes.count()
    bits = max(2, round(math.log2(max(n, 1) / PER_PREFIX)))
    leaves = materialize(_leaves(classes, bits, leaf), "simhash-leaves")
    pairs = materialize(leaf_pairs(leaves, bits, distance), "simhash-pairs")
    held = leaves.select("leaf", "fps", "reps")
    side = lambda x: held.select(*(F.col(c).alias(f"{c}_{x}") for c in held.columns))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [forest(a, b, ra, rb, distance) for a, b, ra, rb in zip(part["fps_a"], part["fps_b"], part["reps_a"], part["reps_b"], strict=True)]
            if found:
                yield pd.DataFrame({"u": np.concatenate([x for x, _ in found]), "v": np.concatenate([x for _, x in found])})

    both = pairs.join(side("a"), "leaf_a").join(side("b"), "leaf_b")
    return both.select("fps_a", "fps_b", "reps_a", "reps_b").mapInPandas(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for every node that has an edge."""
    both = materialize(edges.union(edges.select("v", "u")), "cc-edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "cc-labels")
    total = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    while True:
        l, m = labels.alias("l"), labels.alias("m")
        seen = both.join(l, F.col("v") == F.col("l.node")).select(F.col("u").alias("node"), "label")
        low = seen.union(labels).groupBy("node").agg(F.min("label").alias("low"))
        jumped = low.join(m, F.col("low") == F.col("m.node")).select(low["node"], F.least("low", "m.label").alias("label"))
        labels = materialize(jumped, "cc-labels", instead=labels)
        before, after = total(labels), before
        if before == after:  # labels only fall, so their sum tells of any change
            return labels


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable over links.

    Every fingerprint has a number of its own, so those of rows without an id link like any other; a component of such rows alone
    has no component_id.
    """
    fps = materialize(fingerprints(docs), "simhash-fp")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "simhash-classes")
    # a doc_id on several rows may stand for several fingerprints; these are then joined through it
    own = _by_fingerprint(fps, classes.select("fp", "rep", "rows")).where("doc_id is not null").select("doc_id", "rep")
    spread = own.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v < last").select("doc_id", "v")
    shared = own.join(spread, "doc_id").where("rep > v").select(F.col("rep").alias("u"), "v").distinct()
    labels = components(links(classes.select("fp", "rep"), distance).union(shared))
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep"))
    named = materialize(named.select("fp", "label", "least", "rows"), "simhash-labels")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return _by_fingerprint(fps, materialize(named.join(ids, "label").select("fp", "component_id", "rows"), "simhash-named")).drop("rows")


def _by_fingerprint(fps: DataFrame, known: DataFrame) -> DataFrame:
    """fps with the columns of known(fp, rows, ...). Fingerprints of over HOT_ROWS rows, at most one for so many rows, are broadcast."""
    hot = known.where(F.col("rows") > HOT_ROWS)
    cold = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(known.where(F.col("rows") <= HOT_ROWS), "fp")
    return cold.unionByName(fps.join(F.broadcast(hot), "fp"))
