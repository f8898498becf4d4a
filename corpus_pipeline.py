"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm import linededup, mixing, packing, simhash, toxicity
from wayfold.llm.common import DOCUMENT_COLUMNS, prepare, run_dir, table

#: SimHash, language modelling weights and best-fit packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of toxicity.THRESHOLD or more go."""
    prepare(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, grammar).where(F.col("score") < toxicity.THRESHOLD).select(*DOCUMENT_COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common in their source (linededup.SOURCE_RULES) go; n_chars follows the text."""
    out = linededup.dedup_lines(docs.select(*DOCUMENT_COLUMNS), host="source", site_rules=linededup.SOURCE_RULES)
    return out.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays; documents without an id all stay."""
    prepare(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    stay = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars")  # a repeated row has the same id
    kept = kept.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return kept.select(*DOCUMENT_COLUMNS).union(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    key = ("doc_id", "source", "size")
    total = mixing.mix(docs).groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.sum("copies").alias("_total")).where("_total > 0")
    own = docs.withColumn("size", mixing.word_count(F.col("text")))
    both = own.join(total, own["doc_id"].eqNullSafe(F.col("_doc_id")) & own["source"].eqNullSafe(F.col("_source")) & (own["size"] == F.col("_size")))
    # repeated rows, alike to the mixture, share their copies as evenly as whole numbers allow
    alike = Window.partitionBy(*key)
    both = both.withColumn("_k", F.row_number().over(alike.orderBy("text"))).withColumn("_n", F.count(F.lit(1)).over(alike))
    both = both.withColumn("_copies", F.expr("(_total * _k) div _n - (_total * (_k - 1)) div _n"))
    return both.where("_copies > 0").select(*DOCUMENT_COLUMNS, F.explode(F.expr("sequence(1L, _copies)")).alias("_c")).select(*DOCUMENT_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most packing.CAPACITY ids with their sequence and offset."""
    prepare(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{run_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
