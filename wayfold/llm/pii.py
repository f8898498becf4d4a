"""Personal data by bootstrapped contextual extraction (DataFrame operations only).

Seeds are the matches of four patterns (email, ip, card, phone). Positions come from splitting a text at a pattern: the
gaps between matches alternate with the matches, and a running sum of their lengths gives each start.

Bootstrapping then looks for identifiers that the patterns miss. Every seed and every other identifier-shaped token
(a run with a digit or @) has lexical contexts: the last one, two and three words before it and the first one and two behind it, a
punctuation mark being a word. They are the edges of a bipartite graph of context patterns and instances. Secrets, such as keys
and passwords, are a fifth kind; their seeds are the tokens behind a word that announces one. In rounds,
  - a pattern's confidence for a kind is the weight of its instances of that kind, divided by how often its words occur
    in the whole corpus (so that common words, which precede anything, score nothing), and it needs `min_support`
    different instances;
  - an unlabelled instance of a compatible shape gets 1 - prod(1 - confidence) over its patterns, and joins the kind when
    that reaches `accept`.
Rounds end when no instance joins and beliefs have settled; they only rise. Accepted instances add their occurrences
to the spans; base spans stay, and added spans never overlap a base span. Secrets have columns of their own.

All tables after the scan hold spans, not texts. The scan's table is written to the shared folder once; the rounds work
on aggregated edges. Defined cases: a null text is empty; a text without matches has empty strings; repeated rows are
separate rows; ties in score are all accepted; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Fixed base patterns, with possessive quantifiers and left guards that change no match but keep the search linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-shaped tokens: candidates for the bootstrapping.
TOKEN = r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+"
#: A word, or one mark of punctuation: what contexts are made of.
WORD = r"[\p{L}\p{N}_]++|[^\s\p{L}\p{N}_]"
BEFORE, BEHIND = 3, 2
#: Words that announce a secret, with an optional sign of assignment and an opening quote behind them.
SECRET = r"(?:^|[\s_])(?:token|secret|password|passwort|passwd|pwd|apikey|api_key|access_key|contraseña)(?: [:=])?(?: [\"'])?$"
SECRET_KIND = 4
SETTLED = 1e-6
CONFIDENCE = 0.5
ACCEPT = 0.75
MIN_SUPPORT = 3
MIN_TOKEN = 5
MARK = "struct<kind:int,ord:int,gap:bigint,hit:string,patterns:array<string>>"


def _words(text: Column, many: int) -> list[Column]:
    """The first `many` words of a text, lower-cased; empty where there are none."""
    one = rf"\s*+({WORD})"
    return [F.lower(F.regexp_extract(text, "^" + one * k, k)) for k in range(1, many + 1)]


def _patterns(before: Column, behind: Column) -> Column:
    """array<string>: the context patterns of an identifier from the text before and behind it."""
    left = [F.reverse(w) for w in _words(F.reverse(before), BEFORE)]  # nearest first
    right = _words(behind, BEHIND)
    runs = [("L:", left[k], left[k::-1]) for k in range(BEFORE)] + [("R:", right[k], right[: k + 1]) for k in range(BEHIND)]
    return F.array_compact(F.array(*(F.when(F.length(furthest) > 0, F.concat(F.lit(side), F.concat_ws(" ", *words))) for side, furthest, words in runs)))


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """array<MARK> of the matches; gap is the length of the text since the last one."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(gaps.alias("g"), hits.alias("h"), F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))).alias("r"))
    one = lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("ord"), F.length(x["g"]).cast("long").alias("gap"), x["h"].alias("hit"), _patterns(x["g"], x["r"]).alias("patterns")
    )
    return F.filter(F.transform(rows, one), lambda x: x["hit"].isNotNull())


def _luhn(digits: Column) -> Column:
    """Whether the digit string passes Luhn's test; doubling starts at the second digit from the right."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    summed = F.transform(numbers, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(summed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    bare = lambda p: F.ltrim(p, F.lit("0"))
    small = lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, F.forall(F.split(hit, r"\."), small))
        .when(kind == 2, F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == 3, F.length(digits).between(10, 15))
        .otherwise(F.length(hit) >= MIN_TOKEN)
    )


def occurrences(docs: DataFrame) -> DataFrame:
    """Valid base matches (kind 0..3) and candidate tokens (kind 4), and one row with a null kind for every document.

    (rid, doc_id, kind, start, end, hit, patterns); rid numbers the rows of docs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("rid"))
    every = [_matches(F.col("text"), PATTERNS[k], n) for n, k in enumerate(KINDS)] + [_matches(F.col("text"), TOKEN, 4)]
    needs = {0: "@", 3: "+"}  # what any match of the kind holds; all others hold a digit
    none = F.array().cast(f"array<{MARK}>")
    every = [F.when(F.contains("text", F.lit(needs[n])), m).otherwise(none) if n in needs else m for n, m in enumerate(every)]
    marks = F.when(F.col("text").rlike("[0-9@]"), F.concat(*every)).otherwise(none)
    # one scan gives the marks and the row that every document has, so that rid is numbered once
    marks = rows.select("rid", "doc_id", F.explode(F.concat(marks, F.array(F.lit(None).cast(MARK)))).alias("m")).select("rid", "doc_id", "m.*")
    upto = F.sum(F.col("gap") + F.length("hit")).over(Window.partitionBy("rid", "kind").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.withColumn("end", upto).withColumn("start", F.col("end") - F.length("hit"))
    good = marks.where(F.col("kind").isNull() | _valid(F.col("kind"), F.col("hit")))
    base = F.col("kind") < 4
    order = Window.partitionBy("rid").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    good = good.withColumn("_b", before).withColumn("_a", after)
    free = F.col("kind").isNull() | base | ((F.coalesce("_b", F.lit(0)) <= F.col("start")) & (F.coalesce("_a", F.col("end")) >= F.col("end")))
    return good.where(free).select("rid", "doc_id", "kind", "start", "end", "hit", "patterns")


def _contexts(marks: DataFrame) -> DataFrame:
    """(hit, kind, pattern, n): aggregated edges between instances and their contexts."""
    one = marks.where("kind is not null").select("hit", "kind", F.explode("patterns").alias("pattern"))
    return one.groupBy("hit", "kind", "pattern").agg(F.count(F.lit(1)).alias("n"))


def _key(words: Column) -> Column:
    """Hash of one to three words."""
    out = F.xxhash64(F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.get(words, F.lit(2)))
    return F.when(F.size(words) == 1, F.xxhash64(F.get(words, F.lit(0)))).when(F.size(words) == 2, F.xxhash64(F.get(words, F.lit(0)), F.get(words, F.lit(1)))).otherwise(out)


def _corpus_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(w, often): how often each wanted sequence of words, given by its hash, occurs in all texts.

    wanted is a written table of 8 bytes a pattern: Spark broadcasts it under its threshold, and nothing else is then shuffled.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    t = docs.select(words.alias("t"))
    at = lambda k: F.when(F.size("t") > k, F.sequence(F.lit(0), F.size("t") - 1 - k)).otherwise(F.array().cast("array<int>"))
    get = lambda i, k: F.get("t", i + k)
    runs = F.concat(
        F.transform("t", lambda w: F.xxhash64(w)), F.transform(at(1), lambda i: F.xxhash64(get(i, 0), get(i, 1))), F.transform(at(2), lambda i: F.xxhash64(get(i, 0), get(i, 1), get(i, 2)))
    )
    return t.select(F.explode(runs).alias("w")).join(wanted, "w").groupBy("w").agg(F.count(F.lit(1)).alias("often"))


def _shape(kind: Column, hit: Column) -> Column:
    """Whether an unlabelled token can be of a kind."""
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    secret = (F.length(hit) >= 8) & hit.rlike("[A-Za-z]")
    return F.when(kind == 0, hit.contains("@")).when(kind == 1, (digits >= 4) & hit.contains(".")).when(kind == 2, digits >= 12).when(kind == 3, digits >= 7).otherwise(secret)


def bootstrap(docs: DataFrame, marks: DataFrame, confidence: float = CONFIDENCE, accept: float = ACCEPT, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(hit, as_kind, belief): instances that the patterns' contexts reveal."""
    edges = materialize(_contexts(marks), "pii-edges")
    announced = edges.where((F.col("kind") == 4) & F.col("pattern").startswith("L:") & F.expr("substring(pattern, 3)").rlike(SECRET) & _shape(F.lit(SECRET_KIND), F.col("hit")))
    seeds = edges.where("kind < 4").select("hit", F.col("kind").alias("as_kind"))
    seeds = materialize(seeds.union(announced.select("hit", F.lit(SECRET_KIND).alias("as_kind"))).distinct().withColumn("belief", F.lit(1.0)), "pii-seeds")
    # a pattern can only ever count if that many instances, of any kind, share it
    shared = edges.groupBy("pattern").agg(F.countDistinct("hit").alias("hits")).where(F.col("hits") >= min_support)
    keyed = materialize(shared.select("pattern", _key(F.split(F.expr("substring(pattern, 3)"), " ")).alias("w")), "pii-patterns")
    often = _corpus_counts(docs, materialize(keyed.select("w").distinct(), "pii-wanted"))
    often = materialize(keyed.join(often, "w").select("pattern", "often"), "pii-often")
    edges = materialize(edges.join(often, "pattern"), "pii-graph")
    known, found, had, sum_ = seeds, None, 0, 0.0
    while True:
        support = edges.join(known, "hit").groupBy("pattern", "as_kind").agg(F.sum(F.col("n") * F.col("belief")).alias("mass"), F.countDistinct("hit").alias("support"), F.first("often").alias("often"))
        support = support.where(F.col("support") >= min_support)
        sure = support.select("pattern", "as_kind", F.least(F.col("mass") / F.col("often"), F.lit(0.999)).alias("c")).where(F.col("c") >= confidence)
        open_ = edges.where("kind = 4").select("hit", "pattern").distinct()
        scored = open_.join(sure, "pattern").where(_shape(F.col("as_kind"), F.col("hit")))
        scored = scored.groupBy("hit", "as_kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("belief")).where(F.col("belief") >= accept)
        found = materialize(scored, "pii-found", instead=found)
        n, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("belief"), F.lit(0.0))).first()
        if n == had and total - sum_ <= SETTLED:  # beliefs only rise from round to round, so their sum tells of any change
            break
        had, sum_ = n, total
        known = seeds.unionByName(found.join(seeds, ["hit", "as_kind"], "left_anti"))
    return found.unionByName(seeds.where(F.col("as_kind") == SECRET_KIND))


def find(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans as text, and secrets."""
    docs = docs.select("doc_id", "text")
    marks = materialize(occurrences(docs), "pii-marks")
    spans = marks.where("kind < 4 or kind is null").select("rid", "doc_id", "kind", "start", "end", F.lit(True).alias("base"))
    found = bootstrap(docs, marks, **settings)
    best = found.groupBy("hit").agg(F.max_by("as_kind", F.struct("belief", -F.col("as_kind"))).alias("as_kind"))
    added = marks.where("kind = 4").join(best, "hit").select("rid", "doc_id", F.col("as_kind").alias("kind"), "start", "end", F.lit(False).alias("base"))
    name = F.element_at(F.array(*map(F.lit, (*KINDS, "secret"))), F.col("kind") + 1)
    shown = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("s"))
    secret = F.col("kind") == SECRET_KIND
    per = spans.union(added).groupBy("rid", "doc_id").agg(
        *(F.count(F.when((F.col("kind") == n) & F.col("base"), 1)).alias(f"n_{k}") for n, k in enumerate(KINDS)),
        F.sort_array(F.collect_list(F.when(F.col("base") & F.col("kind").isNotNull(), shown))).alias("b"),
        F.sort_array(F.collect_list(F.when(~secret, shown))).alias("a"),
        F.sort_array(F.collect_list(F.when(secret, shown))).alias("x"),
    )
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["s"]), ",")
    number = lambda c: c.cast("long")
    return per.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("b")), 256).alias("base_sha256"), joined(F.col("a")).alias("spans"),
        number(F.size("a") - F.size("b")).alias("n_added"), number(F.size("x")).alias("n_secret"), joined(F.col("x")).alias("secrets"), number(F.size("a") + F.size("x")).alias("n_found"),
    )
