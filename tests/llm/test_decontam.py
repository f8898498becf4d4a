"""Decontamination against every window of every text, and awkward rows."""

import hashlib
import random
import re

import pytest

from wayfold.llm import decontam
from wayfold.llm.common import prepare


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, window=10):
    known = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                found = known.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    ids |= found
        shown = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), len(hit), len(shown), hashlib.sha256(",".join(shown).encode()).hexdigest(), bool(hit)))
    return out


def run(spark, docs, items, **settings):
    prepare(spark)
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return [tuple(r) for r in decontam.decontaminate(left, spark.createDataFrame(items, "item_id long, text string"), **settings).collect()]


def same(got, want):
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    return sorted(got, key=key) == sorted(want, key=key)


def test_given_tables(spark):
    prepare(spark)
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = [tuple(r) for r in decontam.decontaminate(docs, items).collect()]
    assert same(got, brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()]))
    assert any(r[-1] for r in got)


@pytest.mark.parametrize(("window", "gram"), [(10, 5), (6, 6), (4, 1)])
def test_random_texts_of_few_words(spark, window, gram):
    """Few words make windows repeat, touch and overlap, and grams tie."""
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice(["a", "b", "Cé", "d4", "中"]) + rng.choice(["", ",", " -"]) for _ in range(n))
    docs = [(k, text(rng.randrange(60))) for k in range(60)]
    items = [(k, text(rng.randrange(25))) for k in range(12)]
    docs += [(100 + k, f"x y {t} z") for k, (_, t) in enumerate(items)]
    assert same(run(spark, docs, items, window=window, gram=gram), brute(docs, items, window))


def test_segments_of_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    draw = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passage = draw(14)
    long = draw(300) + passage + draw(200) + passage[:9] + draw(50) + passage[3:13] + draw(2)
    for size in (1, 40, 333):
        found = []
        for base, own in decontam.segments(" ".join(long).encode(), 9, size):
            assert own == [w.encode() for w in long[base : base + len(own)]]
            found += range(base, base + len(own) - 9)
        assert set(found) == set(range(len(long) - 9))
    docs, items = [(1, " ".join(long)), (2, " ".join(draw(30)))], [(7, " ".join(passage)), (8, "w1 w2")]
    monkeypatch.setattr(decontam, "FLUSH_WORDS", 50)
    assert same(run(spark, docs, items), brute(docs, items))


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, passage), (1, passage), (None, passage), (2, None), (3, ""), (4, "..."), (5, passage.upper() + "!"), (6, "seven Eight"), (7, "lorem ipsum dolor " * 60000 + passage)]
    items = [(10, passage), (9, passage + " twelve"), (9, "seven eight"), (None, "lorem ipsum"), (3, None), (4, ""), (5, "...")]
    got = run(spark, docs, items)
    assert same(got, brute(docs, items)) and len(got) == len(docs)
    assert next(r for r in got if r[0] == 7)[2:4] == (120_011, 2)
    prepare(spark)
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS id", "'x' AS row", "1 AS n_words", "'x' AS span", "0 AS item_id")
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS hash", "'x' AS context", "0 AS doc_id")
    assert same([tuple(r) for r in decontam.decontaminate(left, right).collect()], brute(docs, items))
    assert decontam.decontaminate(left.limit(0), right).collect() == []
    assert not any(r.contaminated for r in decontam.decontaminate(left, right.limit(0)).collect())
