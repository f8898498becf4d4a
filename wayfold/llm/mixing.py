"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Each document i of source s gets a rate r_i = min(cap, exp(lambda_s * size_i / mean_size_s)): among all rates whose
word total meets the source's target, these are the ones nearest to 1 in relative entropy. lambda_s solves the convex
dual; every Newton step is one distributed aggregation over all documents, for all sources at once, and the multipliers are a table:
the driver sees one number a round, the largest gap.

Rounding into copies is systematic: within a bucket of a source, documents are ordered by size and document i gets
floor(C_i + u) - floor(C_{i-1} + u) copies, C being the running sum of rates. Neighbours have nearly equal sizes, so
the error of a bucket's word total is at most about one document. A source is cut into buckets of bounded expected
size, so a source with most of the rows still spreads over many tasks. What a source's words then lack or exceed is made
up by one copy more or less of a few documents, the largest that fit first; they come from a few candidates of each size class.

Defined cases: null text has size 0; null sources form one source, after all others; a source without words has target
0; repeated rows are separate documents; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, with_running

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BUCKET_ROWS = 4_000
BROADCAST_SOURCES = 100_000
PER_CLASS = 8
WORD = r"[^\x20\x09-\x0D]+"


def _small(df: DataFrame, n_sources: int) -> DataFrame:
    """A table of one row per source: broadcast while the sources are few, else joined like any other."""
    return F.broadcast(df) if n_sources <= BROADCAST_SOURCES else df


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: (source, source_size, n_docs, target).

    Water-filling: a source ends at cap * size exactly if its level cap*size/weight is below the common level tau.
    Sorted by that level, tau is the largest remainder, shared by weight, that exceeds no cap of those that share it.
    Ranks and running sums go over ranges of sources, so no task holds them all.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = with_running(per, [F.col("source").asc_nulls_last()], {"rn": F.lit(1)}, "mix-rank")
    w = F.lit(None)
    for k, x in enumerate(weights):
        w = F.when((F.col("rn") - 1) % len(weights) == k, F.lit(float(x))).otherwise(w)
    per = per.withColumn("weight", w).withColumn("level", cap * F.col("source_size") / w)
    per = with_running(per, [F.col("level").asc(), F.col("rn").asc()], {"sizes": F.col("source_size"), "weights": F.col("weight")}, "mix-level")
    whole = per.agg((F.sum("source_size") * share).alias("total"), F.sum("weight").alias("all_weight"))
    tau = (F.col("total") - cap * (F.col("sizes") - F.col("source_size"))) / (F.col("all_weight") - F.col("weights") + F.col("weight"))
    per = per.join(F.broadcast(whole)).withColumn("tau", tau)  # one row
    common = per.agg(F.max(F.when(F.col("tau") <= F.col("level"), F.col("tau"))).alias("common"))
    target = F.coalesce(F.least(cap * F.col("source_size"), F.col("weight") * F.col("common")), cap * F.col("source_size"))
    return per.join(F.broadcast(common)).select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _solve(sizes: DataFrame, targets: DataFrame, cap: float, rounds: int) -> DataFrame:
    """(source, lam, mean): damped Newton on the dual, one aggregation over all documents each round."""
    # Sizes repeat, so the dual needs one row per (source, size), however many documents there are.
    hist = materialize(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).where("size > 0"), "mix-hist")
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-9)
    state = targets.where("target > 0").select(
        "source", "target", (F.col("source_size") / F.greatest("n_docs", F.lit(1))).alias("mean"), full.alias("full"),
        F.when(full, 700.0).otherwise(0.0).alias("lam"), F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"), F.lit(1.0).alias("gap"),
    )
    state = materialize(state, "mix-state")
    n = state.count()
    for _ in range(rounds):
        z = F.col("h.size") / F.col("l.mean")
        raw = F.exp(F.least(F.col("l.lam") * z, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        met = hist.alias("h").join(_small(state.where("not full"), n).alias("l"), F.col("h.source").eqNullSafe(F.col("l.source")))
        step = met.groupBy(F.col("l.source").alias("s")).agg(F.sum(words * F.least(raw, F.lit(cap))).alias("got"), F.sum(F.when(raw < cap, words * z * raw).otherwise(0.0)).alias("slope"))
        both = state.where("not full").join(_small(step, n), F.col("source").eqNullSafe(F.col("s")))
        low = F.col("got") < F.col("target")
        both = both.withColumn("lo", F.when(low, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(low, F.col("hi")).otherwise(F.col("lam")))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.nullif(F.col("slope"), F.lit(0.0))
        lam = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        gap = F.abs(F.col("got") - F.col("target")) / F.col("target")
        near = gap < 1e-6  # keep what is good enough, so that a round more or less changes nothing
        both = both.withColumn("gap", gap).withColumn("lam", F.when(near, F.col("lam")).otherwise(lam)).select(*state.columns)
        state = materialize(both.union(state.where("full")), "mix-state", instead=state)
        if (state.where("not full").agg(F.max("gap")).first()[0] or 0.0) < 1e-6:
            break
    return state.select("source", F.round("lam", 9).alias("lam"), "mean")  # sums in another order must not change a rounded rate


def _made_up(rounded: DataFrame, cap: float, per_class: int = PER_CLASS) -> DataFrame:
    """(uid, more): documents that get a copy more or less, so that their source's words come near its target.

    Largest first, as long as they fit what is left: a class of sizes within a factor of two leaves less than two of its
    documents' words to the next, which a few candidates of each class suffice for.
    """
    gap = rounded.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    rows = rounded.where("size > 0").join(_small(gap.withColumnRenamed("source", "s"), gap.count()), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.where(F.when(F.col("gap") > 0, (F.col("copies") < int(cap)) & (F.col("size") < 2 * F.col("gap"))).otherwise((F.col("copies") > 0) & (F.col("size") < -2 * F.col("gap"))))
    each = Window.partitionBy("source", F.floor(F.log2("size"))).orderBy("h", "uid")
    few = rows.withColumn("k", F.row_number().over(each)).where(F.col("k") <= per_class)
    lists = few.groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct("size", "uid")), asc=False).alias("x"))  # at most per_class a class
    none = F.lit(None).cast("struct<size:bigint,uid:bigint>")
    start = F.struct(F.abs("gap").alias("left"), F.array().cast("array<bigint>").alias("taken"), none.alias("over"))

    def step(acc, x):
        take = F.struct((acc["left"] - x["size"]).alias("left"), F.concat(acc["taken"], F.array(x["uid"])).alias("taken"), acc["over"].alias("over"))
        return F.when(x["size"] <= acc["left"], take).otherwise(F.struct(acc["left"].alias("left"), acc["taken"].alias("taken"), x.alias("over")))

    def finish(acc):  # the smallest that did not fit, if it leaves less than there is now
        return F.when(acc["over"]["size"] < 2 * acc["left"], F.concat(acc["taken"], F.array(acc["over"]["uid"]))).otherwise(acc["taken"])

    taken = F.aggregate("x", start, step, finish)
    return lists.select(F.explode(taken).alias("uid"), F.when(F.col("gap") > 0, 1).otherwise(-1).alias("more"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, rounds: int = 40, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs plus (size, source_size, target, rate, copies); every row is kept, with copies in 0..cap.

    Only the sizes are shuffled by source; the copies of a document are found again by (source, size, row order key).
    """
    docs = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    sizes = materialize(docs, "mix-size")
    targets = materialize(source_targets(sizes, weights, share, cap), "mix-target")
    lam = _solve(sizes, targets, cap, rounds)
    known = targets.alias("t").join(lam.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left").select(
        F.col("t.source").alias("s"), "source_size", "n_docs", "target", "lam", "mean"
    )
    rate = (
        F.when(F.col("size") == 0, F.when(F.col("target") > 0, 1.0).otherwise(0.0))
        .when(F.col("lam").isNull(), 0.0)
        .otherwise(F.least(F.lit(cap), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    )
    rated = sizes.join(_small(known, targets.count()), F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", F.round(rate, 6))
    bucket = F.pmod(F.col("h"), F.greatest(F.ceil(F.col("n_docs") / bucket_rows), F.lit(1)))
    within = Window.partitionBy("source", "bucket").orderBy("size", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.round(F.sum("rate").over(within), 6) + 0.5
    rounded = (
        rated.withColumn("bucket", bucket)
        .withColumn("upto", upto)
        .withColumn("copies", (F.floor("upto") - F.floor(F.round(F.col("upto") - F.col("rate"), 6))).cast("long"))
        .withColumn("copies", F.least(F.greatest(F.col("copies"), F.lit(0)), F.lit(int(cap))))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "h", F.monotonically_increasing_id().alias("uid"))
    )
    rounded = materialize(rounded, "mix-rounded")  # uid numbers the rows of this table
    more = _made_up(rounded, cap)
    out = rounded.join(more, "uid", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies")
