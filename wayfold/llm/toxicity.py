"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is read as a string of word classes: INSULT, THREAT, PERSON, POINTER (articles and copulas, by which an insult is
said of something), NEGATION, REPORT and others. Four small weighted transducers, tables of states and arcs, are composed:

  negation   weakens the attacks among the next words after a negation
  report     weakens the attacks that follow a verb of reporting
  insult     accepts a clause that has an insult and, on either side of it, a person or a pointer, or a second insult
  threat     accepts a clause that has a threat and, on either side of it, a person

negation o report o insult and negation o report o threat read a clause side by side. A path's weight is the sum over its
words of the word's weight times the factors of its arcs; a machine gives a clause the greatest weight of its accepting
paths, and nothing if there is none. So a word alone scores nothing: only clauses do. A document's evidence is the sum over
its clauses, mapped to 0..1 by a logistic curve.

Weights of insults are learned: Spark counts, over labelled rows of the learning folds, in how many toxic and clean documents
each word and each word stem (4 or 5 leading letters) occurs, and keeps the terms whose smoothed log-odds are high and whose
log-likelihood ratio is significant for the number of terms tried. At most about `max_labelled` labelled rows, picked by hash, are
used: the classifier's documented bound. A term must occur in one of RARE toxic documents, so there are at most RARE times as
many terms as a toxic document has on average, at any size of the input.
Text alone enters a score. Defined cases: null and empty texts have no evidence and get the curve's base value; repeated rows
score alike; without labels only the built-in words count; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import crc_remainder, materialize

THRESHOLD = 0.3
MAX_LABELLED = 20_000
MIN_TOXIC = 3
RARE = 200  # a term must occur in one of so many toxic documents
MIN_LOG_ODDS = 2.5
CHANCE_TERMS = 50  # about so many of all terms may pass the significance test by chance
STEMS = (4, 5)

#: Fixed word lists (English, German, French, Spanish); insults beyond these are learned.
INSULTS = "idiot moron scum fool trottel dummkopf crétin imbécile tonto idiota".split()
THREATS = "kill hurt destroy beat töte schlage tue matar tuer frapper".split()
PERSONS = "i you your yours u ya he she we they him her us them du ihr dich dir er sie wir euch je tu toi te vous il elle nous ils lui leur yo él ella usted ustedes tú ti ellos".split()
POINTERS = "the a an this that these those such of it is are was were be been am der die das den dem des ein eine einen dieser diese im vom zum zur ist sind war bist seid le la les un une des du au aux ce cet cette de est es sont était êtes el los las lo del al una este esta son eres era".split()
NEGATIONS = "not no never isn't aren't nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says told reported quoted called claims sagte sagt meldete dit rapporte dijo dice citó".split()

CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
NEGATION_REACH = 3
#: Word classes, one letter each.
SYMBOLS = "IHPTNRO"


@dataclass
class Transducer:
    """arcs[state][symbol]: (next state, symbol written, factor). A symbol without an arc ends the path."""

    arcs: list[dict[str, list[tuple[int, str, float]]]]
    final: set[int]

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds what this one writes to `other`: states are pairs, factors multiply; state 0 starts."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:  # grows while pairs are found
            own: dict[str, list[tuple[int, str, float]]] = {}
            for symbol, steps in self.arcs[a].items():
                for to_a, middle, x in steps:
                    for to_b, out, y in other.arcs[b].get(middle, ()):
                        pair = (to_a, to_b)
                        if pair not in number:
                            number[pair] = len(number)
                            todo.append(pair)
                        own.setdefault(symbol, []).append((number[pair], out, x * y))
            arcs.append(own)
        return Transducer(arcs, {n for (a, b), n in number.items() if a in self.final and b in other.final})

    def best(self, symbols: str, weights: list[float]) -> float:
        """The greatest weight of an accepting path, 0 if there is none."""
        at = {0: 0.0}
        for symbol, w in zip(symbols, weights, strict=True):
            new: dict[int, float] = {}
            for state, had in at.items():
                for to, _, factor in self.arcs[state].get(symbol, ()):
                    got = had + w * factor
                    if got > new.get(to, -1.0):
                        new[to] = got
            at = new
        return max((w for state, w in at.items() if state in self.final), default=0.0)


def negation(reach: int, factor: float) -> Transducer:
    """State k: k words of negation are left. Attacks are weakened there; all is passed on."""
    arcs = []
    for k in range(reach + 1):
        step = {x: [(max(k - 1, 0), x, factor if k and x in "IH" else 1.0)] for x in SYMBOLS}
        step["N"] = [(reach, "N", 1.0)]
        arcs.append(step)
    return Transducer(arcs, set(range(reach + 1)))


def report(factor: float) -> Transducer:
    """State 1: something is reported."""
    before = {x: [(int(x == "R"), x, 1.0)] for x in SYMBOLS}
    after = {x: [(1, x, factor if x in "IH" else 1.0)] for x in SYMBOLS}
    return Transducer([before, after], {0, 1})


def aimed(attack: str, targets: str, piled: bool) -> Transducer:
    """Accepts clauses with an attack and a target in either order and, if `piled`, those with two attacks.

    States: nothing, a target, an attack, both.
    """
    arcs = []
    for state in range(4):
        step = {x: [(state, x, 0.0)] for x in SYMBOLS}
        step[attack] = [(3 if piled and state == 2 else state | 2, attack, 1.0)]
        for x in targets:
            step[x] = [(state | 1, x, 0.0)]
        arcs.append(step)
    return Transducer(arcs, {3})


@dataclass
class Grammar:
    """Terms map a word, or a stem given as 'stem*', to a weight."""

    terms: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    slope: float = 1.0
    negated: float = 0.3
    reported: float = 0.6
    threat: float = 3.0

    def machines(self) -> tuple[Transducer, Transducer]:
        """The composed machines for insults and for threats."""
        first = negation(NEGATION_REACH, self.negated).compose(report(self.reported))
        return first.compose(aimed("I", "PT", True)), first.compose(aimed("H", "P", False))

    def compiled(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, grammar: Grammar):
        self.words = {w: v for w, v in grammar.terms.items() if not w.endswith("*")}
        self.stems = {w[:-1]: v for w, v in grammar.terms.items() if w.endswith("*")}
        self.classes = {**dict.fromkeys(POINTERS, "T"), **dict.fromkeys(PERSONS, "P"), **dict.fromkeys(NEGATIONS, "N"), **dict.fromkeys(REPORTS, "R")}
        self.threats, self.threat = set(THREATS), grammar.threat
        self.insults, self.menaces = grammar.machines()
        self.index = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREATS}:
            self.index.add_word(w, len(w))
        self.index.make_automaton()

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def read(self, words: list[str]) -> tuple[str, list[float]]:
        """The classes of a clause's words and their weights."""
        classes, weights = [], []
        for w in words:
            weight = self.insult(w)
            kind = "I" if weight else "H" if w in self.threats else self.classes.get(w, "O")
            classes.append(kind)
            weights.append(self.threat if kind == "H" else weight)
        return "".join(classes), weights

    def clause(self, words: list[str]) -> float:
        classes, weights = self.read(words)
        score = self.insults.best(classes, weights) if "I" in classes else 0.0
        return score + self.menaces.best(classes, weights) if "H" in classes else score

    def evidence(self, text: str | None) -> float:
        low = (text or "").lower()
        total, upto, read = 0.0, -1, 0
        for end, n in self.index.iter(low):
            at = end - n + 1
            if at < upto or (at and (low[at - 1].isalpha() or low[at - 1] == "'")):
                continue  # inside a word, or in a clause that has been read
            b = CLAUSE.search(low, at)
            upto = b.start() if b else len(low)
            a = max(low.rfind(c, read, at) for c in ".!?;:\n") + 1 or read
            total += self.clause(WORD.findall(low, a, upto))
            read = upto
        return total


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope of the logistic curve over log1p(evidence): ridge Newton on labelled rows of the learning folds."""
    z = np.stack([np.ones(len(x)), np.log1p(x)], 1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w)
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Grammar:
    """A grammar from labelled rows whose fold (crc32 of the id, mod 4) is not 2."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    marks = marks.where(crc_remainder(F.col("doc_id"), 4) != 2)
    n = marks.count()
    share = min(1.0, max_labelled / max(n, 1))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000))
    # at most about max_labelled ids of two numbers: a bounded broadcast
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(marks), "doc_id").select("text", "y")
    rows = materialize(rows, "toxicity-labelled")  # the table is read once to learn
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    words = F.filter(words, lambda w: (F.length(w) >= 3) & (F.length(w) <= 40))
    stem = lambda k: F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))
    terms = F.array_distinct(F.concat(words, *(stem(k) for k in STEMS)))
    seen = rows.select("y", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("y").cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    seen = materialize(seen, "toxicity-terms")
    size = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    pos, neg = float(size[0] or 0), float((size[1] or 0) - (size[0] or 0))
    grammar = Grammar({w: 4.0 for w in INSULTS})
    if not pos or not neg:
        return grammar
    n_terms, rate = seen.count(), pos / (pos + neg)
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (neg + 1))
    part = lambda k, r: F.when(k > 0, k * F.log(k / (F.col("n") * r))).otherwise(0.0)
    ratio = 2 * (part(F.col("p"), rate) + part(F.col("n") - F.col("p"), 1 - rate))
    best = seen.where(F.col("p") >= max(MIN_TOXIC, math.ceil(pos / RARE))).withColumn("w", odds)
    best = best.where((F.col("w") >= MIN_LOG_ODDS) & (ratio >= 2 * math.log(max(n_terms / CHANCE_TERMS, 1.0))))
    grammar.terms |= {r.term: round(r.w, 6) for r in best.collect()}
    x, y = [], []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = grammar.compiled()
        for part in parts:
            yield pd.DataFrame({"x": [s.evidence(t) for t in part["text"]], "y": part["y"].astype("int64")})

    for r in rows.mapInPandas(run, "x double, y long").groupBy(F.round("x", 3).alias("x"), "y").count().collect():
        x += [r.x] * r["count"]
        y += [r.y] * r["count"]
    grammar.bias, grammar.slope = _fit_curve(np.array(x), np.array(y, float))
    return grammar


def with_score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs plus evidence and score; only the text goes to Python."""

    @F.pandas_udf("double")
    def evidence(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = grammar.compiled()
        for part in parts:
            yield pd.Series([scorer.evidence(t) for t in part], dtype="float64")

    at = F.least(F.greatest(grammar.bias + grammar.slope * F.log1p("evidence"), F.lit(-50.0)), F.lit(50.0))
    return docs.withColumn("evidence", evidence("text")).withColumn("score", 1 / (1 + F.exp(-at)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    out = with_score(docs.select("doc_id", "text"), learn(docs, labels, **bounds))
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
