"""Line dedup by site-relative frequency (DataFrame operations only).

A line is boilerplate for a host when the pages of the host that contain it, divided by all its pages, exceed `ratio`
and number at least `min_pages`. Pages are counted per (host, line key) with partial aggregation, so neither a hot host
nor a hot line meets in one task before it is summed. A host has at most lines-per-page / ratio such lines, so they are
carried to its pages as one array per host; only that table, one row per host with boilerplate, is joined: by broadcast
while it is small, else by a sort-merge join whose hot partitions Spark splits.

Sources of documents are large sites of unlike texts, where no line comes near half of them. For these, `site_rules` add
to the rule above: (chars, ratio, least) drops a line of at least `chars` characters that stands in more than `ratio` of
the site's unlike documents and in `least` of them or more. Documents with the same least and the same greatest line key,
such as copies, are alike and count once, so that copies don't lose their text. The ratios don't depend on a site's size.

A line's key is one long: 62 bits of its xxhash64, and how many of the rules' lengths it reaches. A page's own mark, a null key, is
counted beside its lines, so that one pass gives lines and totals. Lines are compared after trimming spaces and tabs; blank
lines stay.

Defined cases: null text has no lines and stays null; null hosts form one host; repeated rows count as pages of their
own; a page all of whose lines go keeps its row with an empty text. Extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize

RATIO = 0.5
MIN_PAGES = 3
#: For sources as sites: any line in over 2 % of the unlike documents, 20 at least; passages (250 characters, some 50
#: words, which hardly repeat by chance) in over 0.1 %, 100 at least.
SOURCE_RULES = ((0, 0.02, 20), (250, 0.001, 100))

#: Fixed patterns that turn a page into lines; applied in this order.
SCRIPT = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[^>]*>"
HOST = r"^[a-z]+://([^/:?#]+)"


def page_lines(html: Column) -> Column:
    """The page's text, one line per run between tags."""
    text = F.regexp_replace(F.regexp_replace(html, SCRIPT, "\n"), COMMENT, "\n")
    return F.regexp_replace(text, TAG, "\n")


def _shown(line: Column) -> Column:
    return F.trim(line, F.lit(" \t"))


def _key(line: Column, lengths: list[int]) -> Column:
    reached = sum((F.when(F.length(_shown(line)) >= n, 1).otherwise(0) for n in lengths), F.lit(0))
    return F.shiftleft(F.xxhash64(_shown(line)), 2).bitwiseOR(reached.cast("long"))


def dedup_lines(pages: DataFrame, text: str = "text", host: str = "host", ratio: float = RATIO, min_pages: int = MIN_PAGES, site_rules: tuple = ()) -> DataFrame:
    """pages with `text` reduced, and _n_lines, _n_dropped (non-blank lines seen and dropped). At most three site_rules of different lengths."""
    lengths = sorted({r[0] for r in site_rules if r[0] > 0})
    lines = F.split(F.col(text), "\n")
    some = F.filter(lines, lambda x: F.length(_shown(x)) > 0)
    keys = F.coalesce(F.array_distinct(F.transform(some, lambda x: _key(x, lengths))), F.array().cast("array<bigint>"))
    own = pages.select(F.col(host).alias("_h"), keys.alias("_ks"))
    mark = F.array(F.lit(None).cast("long"))
    least = min(min_pages, *(r[2] for r in site_rules)) if site_rules else min_pages
    if site_rules:
        alike = F.xxhash64(F.array_min("_ks"), F.array_max("_ks")).alias("_m")
        own = own.select("_h", alike, F.explode(F.concat(mark, "_ks")).alias("_k"))
        counts = own.groupBy("_h", "_k").agg(F.count(F.lit(1)).alias("_c"), F.count_distinct("_m").alias("_u"))
    else:
        counts = own.select("_h", F.explode(F.concat(mark, "_ks")).alias("_k")).groupBy("_h", "_k").agg(F.count(F.lit(1)).alias("_c")).withColumn("_u", F.col("_c"))
    counts = materialize(counts.where(F.col("_k").isNull() | (F.col("_c") >= least)), "lines-counts")
    totals = counts.where("_k is null").select(F.col("_h").alias("_h2"), F.col("_c").alias("_t"), F.col("_u").alias("_ut"))
    over = (F.col("_c") >= min_pages) & (F.col("_c") > ratio * F.col("_t"))
    for chars, share, fewest in site_rules:
        long_enough = F.col("_k").bitwiseAND(F.lit(3)) >= sum(n <= chars for n in lengths)
        over = over | (long_enough & (F.col("_u") >= fewest) & (F.col("_u") > share * F.col("_ut")))
    common = counts.where("_k is not null").join(totals, F.col("_h").eqNullSafe(F.col("_h2"))).where(over)
    # once written, the table's size is known: Spark broadcasts it under its threshold and pages stay where they are
    per_host = materialize(common.groupBy(F.col("_h").alias("_site")).agg(F.collect_list("_k").alias("_drop")), "lines-common")
    joined = pages.join(per_host, F.col(host).eqNullSafe(F.col("_site")), "left")
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.length(_shown(x)) == 0) | ~F.array_contains(F.col("_drop"), _key(x, lengths))))
    shown = lambda a: F.coalesce(F.size(F.filter(a, lambda x: F.length(_shown(x)) > 0)), F.lit(0)).cast("long")
    out = joined.withColumn("_kept", kept).withColumn("_n_lines", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(shown(lines)))
    out = out.withColumn("_n_dropped", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("_n_lines") - shown(F.col("_kept"))))
    return out.withColumn(text, F.array_join("_kept", "\n")).drop("_kept", "_drop", "_site")
