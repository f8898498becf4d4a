"""Language identification with interpolated Kneser-Ney character models, one per language.

Letters are lower-cased, everything else is one space, and every character is scored given the three before it. Four
16-bit characters are one 64-bit key; multiplied by an odd constant it is a hash without collisions. Counting runs over
all documents of the learning folds: tasks count their own n-grams, Spark adds the counts up, and the tables of every order,
probabilities and back-off weights, are joins and windows over all n-grams; none is left out. A row holds an n-gram and
its log probability in every language, in whole 1/65536 nats, so that sums don't depend on their order. A text's score
in a language is its mean log probability per character; the lowest cross-entropy wins, ties going to the first language by
name.

While the tables take at most `model_mb`, tasks get them as sorted hash arrays. Beyond that nothing is sent around: the texts' own
n-grams are joined to the tables, order by order. Both give the same sums.

Rejection and sharpness are calibrated on all documents of the learning folds that have a language and a letter: `rejected`
marks texts whose best cross-entropy is above the REJECT quantile (exact, by running counts) that such documents have in their
own language, with a twentieth added. `score` is the winner's posterior at the SHARPNESS with the least log loss over them. Where
the texts to name are those that the model is learned from, `classify` scores each once, for both.

Texts are read in windows of BLOCK characters that carry the last three on, so memory doesn't grow with a text.
Defined cases: a null text or one without letters is `und` with score 0; without learning rows everything is `und`;
repeated rows score alike and count each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import crc_remainder, loose_id, materialize, solid_id, with_running

ORDER = 4
FOLDS = 5
MODEL_MB = 48
REJECT = 0.999
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
DISCOUNT = 0.75
UNIT = 65536.0
SALTS = 8
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 19

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point to lower-case letter, 0 for what is not a letter; beyond the basic plane all letters share one code."""
    if not _letters:
        t = np.zeros(0x110000, np.uint16)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                t[k] = 0x2F if k > 0xFFFF else ord(low) if len(low) == 1 and ord(low) < 0x10000 else k
        _letters.append(t)
    return _letters[0]


def normal(text: str) -> np.ndarray:
    return letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].astype(np.uint64)


def four(padded: np.ndarray) -> np.ndarray:
    """The key at every character but the first three."""
    return (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owner): the 4-gram key at every character of the normalised texts, and the text each belongs to."""
    chars = normal("\x00\x00\x00".join(["", *texts]))
    owner = np.repeat(np.arange(len(texts)), np.array([len(t) for t in texts], np.int64) + 3)  # three spaces stand before each text, and count as one
    space = chars == 0
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    chars, owner = chars[keep], owner[keep]
    keys = four(np.concatenate((np.zeros(3, np.uint64), chars)))
    edge = np.concatenate(([True], owner[1:] != owner[:-1]))
    first = np.flatnonzero(edge)
    ago = np.arange(len(keys)) - np.repeat(first, np.diff(np.concatenate((first, [len(keys)]))))
    for k, m in ((0, 0xFFFF), (1, 0xFFFFFFFF), (2, 0xFFFFFFFFFFFF)):  # no character of the text before is seen
        at = ago == k
        keys[at] &= np.uint64(m)
    return keys, owner


def long_keys(text: str, block: int) -> Iterator[np.ndarray]:
    """The keys of one text, window by window."""
    held = np.zeros(3, np.uint64)
    for a in range(0, len(text), block):
        chars = normal(text[a : a + block])
        if not a:
            chars = np.concatenate((np.zeros(1, np.uint64), chars))
        space = chars == 0
        before = np.concatenate(([a > 0 and held[-1] == 0], space[:-1]))
        padded = np.concatenate((held, chars[~(space & before)]))
        if len(padded) > 3:
            yield four(padded)
        held = padded[-3:]


def key_blocks(texts: list[str], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, owner) of all texts, in blocks of about `block` characters; owners rise within a block."""
    own, n, first = [], 0, 0
    for k, t in enumerate(texts):
        if len(t) > block:
            if own:
                keys, owner = keys_of(own)
                yield keys, owner + first
            for keys in long_keys(t, block):
                yield keys, np.full(len(keys), k)
            own, n, first = [], 0, k + 1
            continue
        own.append(t)
        n += len(t)
        if n >= block:
            keys, owner = keys_of(own)
            yield keys, owner + first
            own, n, first = [], 0, k + 1
    if own:
        keys, owner = keys_of(own)
        yield keys, owner + first


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over (text, lang)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, own in part.groupby("lang", sort=False):
                for keys, _ in key_blocks(own["text"].tolist()):
                    grams, n = np.unique(keys, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    return rows.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def shorter(gram: Column, order: int) -> Column:
    """The n-gram without its first character, for n-grams of this order."""
    return gram.bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1)) if order > 1 else gram


def units(log: Column) -> Column:
    return F.round(log * UNIT).cast("int")


def _array(by_lang: str, langs: int, other) -> Column:
    """The map by language number as an array; other(i) where a language has no entry."""
    return F.transform(F.sequence(F.lit(0), F.lit(langs - 1)), lambda i: F.coalesce(F.try_element_at(F.col(by_lang), i), other(i)))


@dataclass
class Tables:
    """The model as tables: grams[k - 1] (gram, lp array<int>) and backs[k - 1] (context, bow array<int>) by order k."""

    langs: list[str]
    grams: list[DataFrame]
    backs: list[DataFrame]
    floor: list[int]
    sharpness: float = 1.0
    limit: float = float("inf")
    arrays: Arrays | None = field(default=None, repr=False)


def kneser_ney(counts: DataFrame, langs: list[str]) -> Tables:
    """Interpolated Kneser-Ney from (lang, gram, n): lower orders count the distinct left neighbours."""
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    levels = [counts.select(number.alias("li"), "gram", F.col("n").cast("double").alias("n"))]
    for k in range(ORDER, 1, -1):
        below = levels[0].groupBy("li", shorter(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        levels.insert(0, materialize(below, f"langid-counts{k - 1}"))
    sizes = {r.li: r["count"] for r in levels[0].groupBy("li").count().collect()}
    floors = [1.0 / (max(sizes.get(i, 0), 1) + 1.0) for i in range(len(langs))]
    floor = [round(float(np.log(f)) * UNIT) for f in floors]
    p = None
    known = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i + 1)
    grams, backs = [], []
    for k, level in enumerate(levels, 1):
        own = Window.partitionBy("li", "context")
        rows = level.withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("total", F.sum("n").over(own)).withColumn("types", F.count(F.lit(1)).over(own))
        if p is None:
            rows = rows.withColumn("low", known(floors, F.col("li")))
        else:
            rows = rows.withColumn("suffix", shorter(F.col("gram"), k)).join(p.select("li", F.col("gram").alias("suffix"), F.col("p").alias("low")), ["li", "suffix"])
        rest = DISCOUNT * F.col("types") / F.col("total")
        rows = rows.select("li", "gram", "context", ((F.col("n") - DISCOUNT) / F.col("total") + rest * F.col("low")).alias("p"), units(F.log(rest)).alias("bow"))
        p = materialize(rows, f"langid-order{k}")
        by_lang = lambda c: F.map_from_entries(F.collect_list(F.struct("li", c)))
        back = p.groupBy("context", "li").agg(F.first("bow").alias("bow")).groupBy("context").agg(by_lang("bow").alias("m"))
        backs.append(materialize(back.select("context", _array("m", len(langs), lambda i: F.lit(0)).alias("bow")), f"langid-back{k}"))
        rows = p.groupBy("gram").agg(by_lang(units(F.log("p"))).alias("m"))
        rows = rows.withColumn("context", F.shiftrightunsigned("gram", 16)).join(backs[-1], "context")
        if k > 1:
            rows = rows.withColumn("suffix", shorter(F.col("gram"), k)).join(grams[-1].select(F.col("gram").alias("suffix"), F.col("lp").alias("lower")), "suffix")
        else:
            rows = rows.withColumn("lower", F.array(*map(F.lit, floor)))
        lp = _array("m", len(langs), lambda i: F.get("bow", i) + F.get("lower", i))
        grams.append(materialize(rows.select("gram", lp.alias("lp")), f"langid-grams{k}"))
    return Tables(langs, grams, backs, floor)


class Level:
    """A sorted hash array of n-grams with one row of values per language."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        mixed = keys.view(np.uint64) * MIX
        order = np.argsort(mixed)
        self.hashes, self.values = mixed[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = keys * MIX
        at = np.searchsorted(self.hashes, mixed)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == mixed


@dataclass
class Arrays:
    """The model as sorted hash arrays, by order 1 to ORDER."""

    grams: list[Level]
    backs: list[Level]
    floor: np.ndarray

    def log_probs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Whole units by key and language; keys are n-grams of the order."""
        if not order:
            return np.broadcast_to(self.floor, (len(keys), len(self.floor))).copy()
        level = self.grams[order - 1]
        at, hit = level.find(keys)
        out = level.values[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            left = keys[miss]
            low = self.log_probs(left & np.uint64((1 << (16 * (order - 1))) - 1) if order > 1 else left, order - 1)
            at, hit = self.backs[order - 1].find(left >> np.uint64(16))
            low[hit] += self.backs[order - 1].values[at[hit]]
            out[miss] = low
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: summed units by language, characters, and whether it has a letter."""
        total, n, letters = np.zeros((len(texts), len(self.floor)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for keys, owner in key_blocks(texts, max(1024, BLOCK // max(1, len(self.floor) // 16))):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            at = owner[starts]
            total[at] += np.add.reduceat(self.log_probs(keys), starts, axis=0, dtype=np.int64)
            n[at] += np.diff(np.concatenate((starts, [len(keys)])))
            letters[at] |= np.maximum.reduceat(keys & np.uint64(0xFFFF), starts) > 0
        return total, n, letters


def fetched(model: Tables) -> Arrays:
    def level(df: DataFrame) -> Level:
        rows = df.toPandas()
        return Level(rows.iloc[:, 0].to_numpy(np.int64), np.stack(rows.iloc[:, 1].to_numpy()).astype(np.int32))

    return Arrays([level(g) for g in model.grams], [level(b) for b in model.backs], np.array(model.floor, np.int32))


def is_learning() -> Column:
    """Whether a row belongs to the learning folds (crc32 of the id, mod 5, is not 0) and has a language."""
    return (crc_remainder(F.col("doc_id"), FOLDS) != 0) & F.col("lang").isNotNull()


def uncalibrated(docs: DataFrame, model_mb: float = MODEL_MB) -> Tables | None:
    """The model, not yet calibrated, from all documents of the learning folds that have a language."""
    train = docs.where(is_learning()).select("text", "lang")
    counts = materialize(count_ngrams(train), "langid-ngrams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    model = kneser_ney(counts, langs)
    rows = reduce(DataFrame.union, (df.select(F.lit(1)) for df in (*model.grams, *model.backs))).count()
    if rows * (8 + 4 * len(langs)) <= model_mb * (1 << 20):
        model.arrays = fetched(model)
    return model


def numbered(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(doc_id, text, own): own is the language's number for learning rows, which calibrate, else -1; scores don't see it."""
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    return docs.select(solid_id(F.col("doc_id")).alias("doc_id"), "text", F.when(is_learning(), number).otherwise(-1).alias("own"))


def calibrate(model: Tables, found: DataFrame) -> None:
    """Set sharpness and limit from all learning rows with a letter among those of `summed`."""
    seen = found.where("own >= 0 and letters").withColumn("top", F.array_max("total"))
    own = F.get("total", F.col("own"))

    def loss(sharp: float) -> Column:
        z = lambda t: (t - F.col("top")) / (F.lit(UNIT) * F.col("n")) * F.lit(sharp)
        return F.log(F.aggregate("total", F.lit(0.0), lambda a, t: a + F.exp(z(t)))) - z(own)

    # decimals, so that the sums don't depend on the order of rows
    sums = seen.agg(F.count(F.lit(1)).alias("rows"), *(F.sum(loss(x).cast("decimal(28,18)")).alias(f"s{k}") for k, x in enumerate(SHARPNESS))).first()
    if not sums["rows"]:
        return
    model.sharpness = SHARPNESS[min(range(len(SHARPNESS)), key=lambda k: sums[f"s{k}"])]
    nats = seen.groupBy((own / (-UNIT * F.col("n"))).alias("nats")).agg(F.count(F.lit(1)).alias("c"))
    upto = with_running(nats, [F.col("nats")], {"upto": F.col("c")}, "langid-nats")
    place = REJECT * (sums["rows"] - 1)
    low = int(place)
    at = upto.agg(*(F.min(F.when(F.col("upto") > k, F.col("nats"))).alias(a) for a, k in (("low", low), ("high", min(low + 1, sums["rows"] - 1))))).first()
    model.limit = (at["low"] + (place - low) * (at["high"] - at["low"])) * 1.05


def learn(docs: DataFrame, model_mb: float = MODEL_MB) -> Tables | None:
    """The calibrated model from all documents of the learning folds that have a language."""
    model = uncalibrated(docs, model_mb)
    if model is not None:
        calibrate(model, materialize(summed(numbered(docs, model.langs).where("own >= 0"), model), "langid-totals"))
    return model


def summed(docs: DataFrame, model: Tables) -> DataFrame:
    """(doc_id, own, total array<long> by language, n, letters) for every row of (doc_id, text, own)."""
    if model.arrays is None:
        return _joined(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays)  # at most model_mb

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = shared.value
        for part in parts:
            total, n, letters = arrays.sums(part["text"].fillna("").tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "own": part["own"].to_numpy(), "total": list(total), "n": n, "letters": letters})

    return docs.mapInPandas(run, "doc_id long, own int, total array<long>, n long, letters boolean")


def _joined(docs: DataFrame, model: Tables) -> DataFrame:
    """The same by joins: the n-grams of each text meet the tables of the highest order, what is left those of the next."""
    width = len(model.langs)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = part["rid"].to_numpy()
            names, langs = part["doc_id"].to_numpy(), part["own"].to_numpy()
            yield pd.DataFrame({"rid": ids, "doc_id": names, "own": langs, "gram": 0, "c": 0, "letter": False})  # a row even for an empty text
            for keys, owner in key_blocks(part["text"].fillna("").tolist()):
                for at in np.unique(owner):
                    grams, c = np.unique(keys[np.searchsorted(owner, at) : np.searchsorted(owner, at, "right")], return_counts=True)
                    yield pd.DataFrame({"rid": ids[at], "doc_id": names[at], "own": langs[at], "gram": grams.view(np.int64), "c": c, "letter": (grams & np.uint64(0xFFFF)) > 0})

    rows = docs.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(run, "rid long, doc_id long, own int, gram long, c long, letter boolean")
    rows = materialize(rows, "langid-texts")
    left = rows.where("c > 0").select("rid", "gram", "c")
    given = []
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # noqa: E731  a frequent n-gram is in most texts
    for k in range(ORDER, 0, -1):
        left = left.withColumn("salt", F.pmod(F.hash("rid"), F.lit(SALTS)))
        met = materialize(left.join(salted(model.grams[k - 1]), ["gram", "salt"], "left"), "langid-met")
        given.append(met.where("lp is not null").select("rid", "c", F.col("lp").alias("v")))
        missed = met.where("lp is null").drop("lp").withColumn("context", F.shiftrightunsigned("gram", 16))
        weighed = missed.join(salted(model.backs[k - 1]), ["context", "salt"])
        given.append(weighed.select("rid", "c", F.col("bow").alias("v")))
        left = missed.select("rid", shorter(F.col("gram"), k).alias("gram"), "c")
    given.append(left.select("rid", "c", F.array(*map(F.lit, model.floor)).alias("v")))
    every = reduce(DataFrame.union, given)
    total = every.groupBy("rid").agg(*(F.sum(F.col("c") * F.get("v", F.lit(i))).alias(f"t{i}") for i in range(width)))
    texts = rows.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("own").alias("own"), F.sum("c").alias("n"), F.bool_or("letter").alias("letters"))
    none = F.lit(0).cast("long")
    both = texts.join(total, "rid", "left")
    return both.select("doc_id", "own", F.array(*(F.coalesce(f"t{i}", none) for i in range(width))).alias("total"), "n", "letters")


def identify(docs: DataFrame, model: Tables | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected for every row."""
    rows = docs.select(solid_id(F.col("doc_id")).alias("doc_id"), "text", F.lit(-1).alias("own"))
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select(loose_id(F.col("doc_id")).alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("cross_entropy"), F.lit(True).alias("rejected"))
    return named(summed(rows, model), model)


def classify(docs: DataFrame, model_mb: float = MODEL_MB) -> DataFrame:
    """identify by what learn makes of the same documents; each text is scored once, to calibrate and to be named."""
    model = uncalibrated(docs, model_mb)
    if model is None:
        return identify(docs, None)
    found = materialize(summed(numbered(docs, model.langs), model), "langid-totals")
    calibrate(model, found)
    return named(found, model)


def named(found: DataFrame, model: Tables) -> DataFrame:
    """The columns of identify from those of summed."""
    top = F.array_max("total")
    nats = F.col("top") / (-UNIT * F.col("n"))
    spread = F.aggregate("total", F.lit(0.0), lambda a, t: a + F.exp((t - F.col("top")) / (F.lit(UNIT) * F.col("n")) * F.lit(model.sharpness)))
    lang = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("total", F.col("top")).cast("int"))
    out = found.withColumn("top", top)
    return out.select(
        loose_id(F.col("doc_id")).alias("doc_id"), F.when(F.col("letters"), lang).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.round(1 / spread, 9)).otherwise(0.0).alias("score"), F.when(F.col("letters"), nats).alias("cross_entropy"),
        (~F.col("letters") | (nats > F.lit(model.limit))).alias("rejected"),
    )
