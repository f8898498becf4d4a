"""Spelling variants against all pairs by the definition, and awkward rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayfold.llm import spelling
from wayfold.llm.common import prepare


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, least=3):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}
    close = {a: [b for b in n if near(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(close[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best and n[best] >= 2 * n[a] else None
    root = {}
    for a in n:
        at = a
        while form[at]:
            at = form[at]
        root[a] = at
    return {(a, form[a], root[a], n[a], len(close[a]), n[form[a]] if form[a] else None) for a in n}


def run(spark, docs, **settings):
    prepare(spark)
    rows = [tuple(r) for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **settings).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("alphabet", "parts"), [("ab", 1), ("aé", 4), ("abcz", 7)])
def test_words_of_few_letters(spark, alphabet, parts):
    """Runs of equal letters, words with many neighbours, ties in counts; ranges of the sorted words share prefixes and suffixes."""
    rng = random.Random(parts)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(4, 9))) for _ in range(150)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(120)))) for k in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert run(spark, docs) == brute(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_given_documents(spark):
    prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert {tuple(r) for r in spelling.variants(docs).collect()} == brute([tuple(r) for r in docs.collect()])


def test_chains_end_in_their_root(spark):
    """Each word one letter from the next, counts doubling: eight links."""
    words = ["aaaaaaaaa"[:k] + "bbbbbbbbb"[k:] for k in range(9)]
    docs = [(-1 - k, " ".join([w] * (3 * 2**k))) for k, w in enumerate(words)]
    got = run(spark, docs)
    assert got == brute(docs) and {r[2] for r in got if r[0] in words} == {max(brute(docs), key=lambda r: r[3])[0]}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TASK_WORDS", 3)
    long = "x" * 30_000
    docs = [(1, None), (2, ""), (None, "banana Banane BANANA 12"), (3, "banana\tbananä,bananas"), (3, "banana\tbananä,bananas"), (4, "banan banan banan Ÿbanana\U0001f600banana")]
    docs += [(k, f"{long} {long}y Banana×÷Õ") for k in range(5, 9)]
    want = brute(docs)
    assert run(spark, docs) == want and any(len(r[0]) >= 30_000 and r[4] == 1 for r in want)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "place", "nodes", "form", "root")})
    assert {tuple(r) for r in spelling.variants(frame).collect()} == want
    assert spelling.variants(frame.limit(0)).collect() == []
    assert run(spark, [(1, "single words only")]) == set()
