"""Benchmark decontamination by winnowing.

1. A text's words are hashed, and every `gram` words in a row make one hash. Of every `window - gram + 1` of these in a row,
   which together span `window` words, the smallest (the last of equal ones) is a fingerprint. Equal spans of `window` words
   choose equal fingerprints at equal places, so every shared span of that length meets in the join. An item of fewer words
   is one fingerprint of its own length; documents give all grams of those lengths for it to meet.
2. Item fingerprints set bits of a bitmap of fixed size. Documents, read once in batches of whole texts, write only
   fingerprints whose bit is set, with the words around them: as few as the benchmark calls for, at any number of items.
   A bit set by another item costs a row and changes nothing.
3. Document and item fingerprints are joined by hash and extended by comparing the words around them one by one. Shared
   runs of at least the item's window are hits; a document's hit words are the union of its runs.

Items with the same words around a fingerprint share one context, which is joined and extended once.

Defined cases: null and empty texts have no words and no hits. An item without words occurs nowhere. An item with a null id
marks words as hit but is in no count or list; rows with the same item_id are one item in counts and lists. Repeated documents
stay separate rows, with null ids too. Empty tables give an empty result or no hits. Very long texts are cut into
segments that overlap by `window - 1` words. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize

WINDOW = 10
GRAM = 5
SEED = 12
BITS = 23  # of a place in the bitmap: 1 MB
SEGMENT_BYTES = 1 << 20
FLUSH_WORDS = 200_000
CACHE_WORDS = 400_000
FOLD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of words stay, A-Z lower-cased; all others become spaces. No byte of a longer UTF-8 character is below 0x80.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = "row long, id long, n_words long, pos long, size int, hash long, lead int, span string"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return out


def segments(raw: bytes, overlap: int, most: int = SEGMENT_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of a text, some at a time; each begins with the last `overlap` words before it."""
    text, at, base, held = raw.translate(WORD_BYTES), 0, 0, []
    while at < len(text):
        end = text.find(b" ", at + most)
        end = len(text) if end < 0 else end
        new = text[at:end].split()
        if new:
            words = held + new
            yield base, words
            held = words[max(0, len(words) - overlap) :]
            base += len(words) - len(held)
        at = end


def gram_hashes(h: np.ndarray, gram: int, size: int) -> np.ndarray:
    """A hash of every `gram` values in a row, apart for each window size."""
    out = np.full(len(h) - gram + 1, size, np.uint64)
    for j in range(gram):
        out = out * FOLD + h[j : len(h) - gram + 1 + j]
    out ^= out >> np.uint64(31)
    out *= MIX
    return out ^ (out >> np.uint64(29))


def winnowed(h: np.ndarray, seg: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints within segments; seg: the segment of each word."""
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(h, gram, window)
    starts = np.flatnonzero(seg[: len(seg) - window + 1] == seg[window - 1 :])
    views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)[starts]
    at = np.unique(starts + (window - gram) - views[:, ::-1].argmin(axis=1))
    return at, grams[at]


def _fingerprints(texts: DataFrame, id_column: str, window: int, gram: int, bitmap=None, shorts: list[int] | None = None) -> DataFrame:
    """SCHEMA: a row for each text (pos null) and one for each fingerprint. Documents come with the items' bitmap and short lengths."""
    items = bitmap is None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if items else np.frombuffer(bitmap.value, np.uint8)
        cache, row = _Hashes(), TaskContext.get().partitionId() << 40
        words: list[bytes] = []
        sizes: list[int] = []
        rows: list[int] = []
        bases: list[int] = []

        def chosen() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            """(window size, gram, places, hashes)"""
            h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
            seg = np.repeat(np.arange(len(sizes)), sizes)
            yield window, gram, *winnowed(h, seg, window, gram)
            count = np.array(sizes)
            for n in range(1, window) if items else shorts:
                if len(h) >= n:
                    at = np.flatnonzero(seg[: len(seg) - n + 1] == seg[n - 1 :])
                    at = at[count[seg[at]] == n] if items else at
                    yield n, n, at, gram_hashes(h, n, n)[at]

        def flush() -> pa.RecordBatch:
            ends = np.cumsum(sizes)
            starts = ends - sizes
            found: dict[str, list] = {c: [] for c in ("row", "pos", "size", "hash", "lead", "span")}
            for size, own, at, hashes in chosen():
                if not items:
                    slot = hashes >> np.uint64(64 - BITS)
                    hit = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                    at, hashes = at[hit > 0], hashes[hit > 0]
                segs = np.searchsorted(ends, at, "right")
                first = np.maximum(at - (size - own), starts[segs])
                last = np.minimum(at + size, ends[segs])
                found["row"] += np.array(rows, np.int64)[segs].tolist()
                found["pos"] += (np.array(bases, np.int64)[segs] + at - starts[segs]).tolist()
                found["size"] += [size] * len(at)
                found["hash"] += hashes.view(np.int64).tolist()
                found["lead"] += (at - first).tolist()
                found["span"] += [b" ".join(words[a:b]).decode() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            n = len(found["row"])
            for x in (words, sizes, rows, bases):
                x.clear()
            return _batch(found["row"], [None] * n, [None] * n, *(found[c] for c in ("pos", "size", "hash", "lead", "span")))

        for part in parts:
            numbers, counts = [], []
            for raw in part.column(1).to_pylist():
                row += 1
                n = 0
                for base, own in segments(raw or b"", window - 1):
                    words += own
                    sizes.append(len(own))
                    rows.append(row)
                    bases.append(base)
                    n = base + len(own)
                    if len(words) >= FLUSH_WORDS:
                        yield flush()
                numbers.append(row)
                counts.append(n)
            none = [None] * len(numbers)
            yield _batch(numbers, part.column(0), counts, none, none, none, none, none)
        if words:
            yield flush()

    return texts.select(F.col(id_column).cast("long"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)


def _batch(*columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, types = zip(*(c.split() for c in SCHEMA.split(", ")), strict=True)
    made = [c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(made, list(names))


def _bitmap(prints: DataFrame) -> bytes:
    """One bit for each leading BITS bits of a hash. The driver gets at most 2^BITS / 8 bytes, in blocks that Spark fills."""
    slot = F.shiftrightunsigned("hash", 64 - BITS) + 1
    blocks = prints.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("block"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in blocks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():
        at = (r["block"] - 1) * len(r["bits"])
        out[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def _alike(a: Column, b: Column) -> Column:
    """How many words two arrays have in common from their first on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    other = F.array_position(same, F.lit(False))
    return F.when(other == 0, F.size(same)).otherwise(other - 1)


def _before(side: str) -> Column:
    return F.reverse(F.slice(F.split(f"{side}.span", " "), F.lit(1), F.col(f"{side}.lead")))


def _after(side: str) -> Column:
    words = F.split(f"{side}.span", " ")
    return F.slice(words, F.col(f"{side}.lead") + 1, F.size(words) - F.col(f"{side}.lead"))


def _covered(runs: Column) -> Column:
    """Words in the union of sorted (first, last + 1) runs."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(s: Column, x: Column) -> Column:
        new = F.greatest(x["to"] - F.greatest(x["first"], s["end"]), F.lit(0))
        return F.struct((s["n"] + new).alias("n"), F.greatest(s["end"], x["to"]).alias("end"))

    return F.aggregate(runs, start, add)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    prints = materialize(_fingerprints(items, "item_id", window, gram), "decontam-items")
    names = prints.where("pos is null").select("row", "id")
    prints = prints.where("pos is not null").drop("id")
    context = ("size", "hash", "lead", "span")
    contexts = materialize(prints.select(*context).distinct().withColumn("context", F.monotonically_increasing_id()), "decontam-contexts")
    users = materialize(prints.join(contexts, list(context)).join(names, "row").select("context", "id").distinct(), "decontam-users")
    shorts = sorted(r["size"] for r in contexts.where(F.col("size") < window).select("size").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(contexts))
    found = materialize(_fingerprints(docs, "doc_id", window, gram, bitmap, shorts), "decontam-docs")

    d, i = found.where("pos is not null").alias("d"), contexts.alias("i")
    met = d.join(i, (F.col("d.hash") == F.col("i.hash")) & (F.col("d.size") == F.col("i.size")))
    met = met.select("d.row", "d.pos", "i.size", "i.context", _alike(_before("d"), _before("i")).alias("left"), _alike(_after("d"), _after("i")).alias("right"))
    least = F.when(F.col("size") < window, F.col("size")).otherwise(gram)  # words of the fingerprint itself
    met = met.where((F.col("right") >= least) & (F.col("left") + F.col("right") >= F.col("size")))
    run = F.struct((F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("to"))
    hits = met.join(users, "context").groupBy("row")
    hits = hits.agg(F.array_sort(F.collect_set(run)).alias("runs"), F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("ids"))
    hits = hits.select("row", _covered(F.col("runs")).alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    out = found.where("pos is null").select("row", F.col("id").alias("doc_id"), "n_words").join(hits, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
