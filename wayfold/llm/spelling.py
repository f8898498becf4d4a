"""Spelling variants by a dictionary of trie-node pairs.

1. Words are counted within each task and then over all documents; the counts are written.
2. The vocabulary is sorted in ranges. A word's nodes in the trie are numbered in that order: it shares those of the prefix it has
   in common with the word before it and gets new numbers for the rest, so a word of any length costs as many numbers as letters.
   Only the first word of a range can share nodes with the range before; those few numbers, one list a range, are equated
   afterwards. Reversed words give the suffix nodes alike.
3. A word with k letters taken out at one place is a pair (prefix node, suffix node): one letter (a skip) or none (a gap). Two
   skips with equal pairs are words that differ by one replaced letter; a skip and a gap with equal pairs are a word and the same
   with one letter more. Of a run of equal letters only the first skip meets gaps, so no neighbour is met twice. A pair holds at
   most one gap and one skip for each letter of the alphabet, so its members fit one row, and neighbours are counted and
   the best one found from sorted members, without making pairs of words.
4. Forms rise in count by a factor of two at least, so chains are short; roots follow them by pointer doubling.

Words carry their sorted place as number, so ties are told by numbers, and strings are joined only at the end.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in the checksum; repeated rows count again,
each on its own; an empty table gives an empty result; words and texts of any length are whole. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize

MIN_LENGTH = 5
MIN_COUNT = 3
MODULUS = 97
TASK_WORDS = 400_000
ROOT = -1
#: In Latin-1, a letter is a byte: A-Z lower-cased, a-z and U+00C0 to U+00FF kept, all else made a space ('?' stands for what Latin-1 lacks).
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def changed_run(run: bytes, crc: int, modulus: int = MODULUS) -> bytes:
    """A lower-cased run (Latin-1), with one letter less where the checksum says so. crc: of '<doc_id>:'."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), crc)
    if h % modulus:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of at least min_length letters and min_count occurrences."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for part in parts:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                crc = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for own, n in Counter((text or "").encode("latin-1", "replace").translate(LETTERS).split()).items():
                    if len(own) >= min_length and len(word := changed_run(own, crc)) >= min_length:
                        total[word] += n
                if len(total) >= TASK_WORDS:
                    yield flush()
        yield flush()

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _shared(a: str, b: str) -> int:
    most = min(len(a), len(b))
    return next((k for k in range(most) if a[k] != b[k]), most)


def trie_nodes(words: DataFrame, tag: str) -> tuple[DataFrame, DataFrame | None]:
    """words(word, ...) with range, place (sorted number) and nodes (of prefixes of 1, 2, ... letters); and (dup, node) to equate."""
    columns = [c for c in words.columns if c != "word"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        before, stack, place, node = "", [], base, base
        for part in parts:
            flat, ends = [], [0]
            for word in part.column(0).to_pylist():
                k = _shared(before, word)
                fresh = len(word) - k
                stack = stack[:k] + list(range(node, node + fresh))
                node += fresh
                before = word
                flat += stack
                ends.append(len(flat))
            n = part.num_rows
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            places = pa.array(np.arange(place, place + n))
            place += n
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(n, base >> 40)), places, nodes], ["word", *columns, "range", "place", "nodes"])

    types = dict(words.dtypes)
    schema = ", ".join(["word string", *(f"{c} {types[c]}" for c in columns), "range long", "place long", "nodes array<long>"])
    ordered = words.select("word", *columns).repartitionByRange("word").sortWithinPartitions("word")
    numbered = materialize(ordered.mapInArrow(run, schema), tag)
    end = F.struct("word", "nodes")
    borders = numbered.groupBy("range").agg(F.min_by(end, "word").alias("first"), F.max_by(end, "word").alias("last")).orderBy("range").collect()
    same: dict[int, int] = {}
    for a, b in zip(borders, borders[1:], strict=False):  # a range or none of them for each partition
        for k in range(_shared(a["last"]["word"], b["first"]["word"])):
            same[b["first"]["nodes"][k]] = same.get(a["last"]["nodes"][k], a["last"]["nodes"][k])
    equal = words.sparkSession.createDataFrame(list(same.items()), "dup long, node long") if same else None
    return numbered, equal


def _equated(pairs: DataFrame, equal: DataFrame | None, column: str) -> DataFrame:
    """Node numbers that stand for the same node made one. At most a word's letters for each range are broadcast."""
    if equal is None:
        return pairs
    out = pairs.join(F.broadcast(equal), F.col(column) == F.col("dup"), "left")
    return out.withColumn(column, F.coalesce("node", column)).drop("dup", "node")


def node_pairs(forward: DataFrame, backward: DataFrame, same_prefix: DataFrame | None, same_suffix: DataFrame | None) -> DataFrame:
    """(p, s, place, n, gap, first): the node pairs of each word; first: a skip that opens its run of equal letters."""
    root = F.array(F.lit(ROOT).cast("long"))
    both = forward.select("place", "word", "n", F.concat(root, "nodes").alias("p")).join(backward.select("place", F.reverse(F.concat(root, "nodes")).alias("s")), "place")
    size, letters = F.size("p") - 1, F.split("word", "")
    opens = F.zip_with(letters, F.concat(F.array(F.lit("")), F.slice(letters, F.lit(1), F.size(letters) - 1)), lambda x, y: x != y)
    gaps = F.arrays_zip("p", "s", F.array_repeat(F.lit(True), size + 1).alias("gap"), F.array_repeat(F.lit(False), size + 1).alias("first"))
    skips = F.arrays_zip(F.slice("p", F.lit(1), size).alias("p"), F.slice("s", F.lit(2), size).alias("s"), F.array_repeat(F.lit(False), size).alias("gap"), opens.alias("first"))
    one = both.select("place", "n", F.explode(F.concat(gaps, skips)).alias("x")).select("x.*", "place", "n")
    return _equated(_equated(one, same_prefix, "p"), same_suffix, "s")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(place, n_near, best): how many near words a word has, and (-n, place) of the best one; words without any are left out."""
    member = F.struct((-F.col("n")).alias("less"), "place", "gap", "first")
    groups = pairs.groupBy("p", "s").agg(F.array_sort(F.collect_list(member)).alias("all")).where(F.size("all") > 1)
    groups = groups.select(F.filter("all", lambda x: ~x["gap"]).alias("skips"), F.filter("all", lambda x: x["gap"]).alias("gaps"))
    groups = groups.select("skips", "gaps", F.filter("skips", lambda x: x["first"]).alias("heads"))
    rank = lambda x: F.struct(x["less"].alias("less"), x["place"].alias("place"))
    gap, top, second = F.get("gaps", F.lit(0)), F.get("skips", F.lit(0)), F.get("skips", F.lit(1))

    def of_skip(x: Column) -> Column:
        other = F.when(x["place"] == top["place"], second).otherwise(top)
        meets = x["first"] & gap.isNotNull()
        best = F.least(F.when(other.isNotNull(), rank(other)), F.when(meets, rank(gap)))
        return F.struct(x["place"].alias("place"), (F.size("skips") - 1 + meets.cast("int")).cast("long").alias("near"), best.alias("best"))

    def of_gap(x: Column) -> Column:
        head = F.get("heads", F.lit(0))
        return F.struct(x["place"].alias("place"), F.size("heads").cast("long").alias("near"), F.when(head.isNotNull(), rank(head)).alias("best"))

    found = groups.select(F.explode(F.concat(F.transform("skips", of_skip), F.transform("gaps", of_gap))).alias("x")).select("x.*").where("near > 0")
    return found.groupBy("place").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(place, root) of forms(place, form): the last form of each chain."""
    at = materialize(forms.select("place", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("place").alias("root"), F.col("root").alias("next"))
        new = at.join(ahead, "root", "left").select("place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = materialize(new, "spelling-roots", instead=at)
        if new.where("moved").isEmpty():
            return new.select("place", "root")
        at = new.drop("moved")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word."""
    counts = materialize(word_counts(docs, min_length, min_count), "spelling-words")
    forward, same_prefix = trie_nodes(counts, "spelling-forward")
    turned = forward.select(F.reverse("word").alias("word"), F.col("place").alias("at"))
    backward, same_suffix = trie_nodes(turned, "spelling-backward")
    backward = backward.select(F.col("at").alias("place"), "nodes")
    near = neighbours(node_pairs(forward, backward, same_prefix, same_suffix))
    names = forward.select("place", "word", "n")
    known = names.join(near, "place", "left")
    form_n = -F.col("best.less")
    good = form_n >= 2 * F.col("n")
    known = materialize(known.select("place", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.place")).alias("form"), F.when(good, form_n).alias("form_n")), "spelling-near")
    ends = roots(known.where("form is not null"))
    form = names.select(F.col("place").alias("form"), F.col("word").alias("form_word"))
    root = names.select(F.col("place").alias("root"), F.col("word").alias("root_word"))
    with_form = known.where("form is not null").join(form, "form").join(ends, "place").join(root, "root")
    columns = ("word", "n", "n_near", "form_n")
    return with_form.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), *columns[1:]).unionByName(
        known.where("form is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), *columns[1:])
    )
