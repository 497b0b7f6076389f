"""From raw documents to tokens: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read again for the next one. All but
the last return the columns of ``documents``, extra ones included; ``n_chars`` follows the text. An empty table passes through empty.
A row with a null ``doc_id`` is a document of its own: it is given a surrogate key inside a stage that needs one, behind all real
identifiers, so of near duplicates an identified one stays; it leaves the stage with null again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, decontaminate, ngram_join, quality_gam, suffix_dedup
from webloom.llm.sieve import split, without
from webloom.operators.ranking import rank_within
from webloom.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

LENGTH = 400  #: bytes of a repeated string
PASSAGE = 51  #: words of a repeated passage: over 50, which are often below 400 bytes
WORDS, PERCENT = 5, 80  #: of near duplicates
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality_gam.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def identified(stage: Stage) -> Stage:
    """The stage on a table where every row has an identifier; only rows without one are written for it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = F.col("doc_id").cast("bigint")
        n, low, high = docs.agg(F.count(F.when(own.isNull(), 1)), F.min(own), F.max(own)).first()
        if not n:
            return stage(spark, docs, sf_dir)
        base = 0 if high is None else high  # surrogates are base + 1 to base + n
        if base + n >= 1 << 63:
            base = low - n - 1
        if base + 1 < -(1 << 63):
            raise ValueError("no room for surrogate keys beside the identifiers")
        null = docs.filter(own.isNull()).withColumn("null row", F.lit(0)).withColumn("null id", F.monotonically_increasing_id())
        ranked = rank_within(null, "null row", ["null id"], "null rank").withColumn("doc_id", F.col("null rank") + F.lit(base))
        keyed = docs.filter(own.isNotNull()).withColumn("doc_id", own).unionByName(written(ranked.select(docs.columns), "keyed"))
        found = stage(spark, keyed, sf_dir)
        made = F.col("doc_id").between(base + 1, base + n)
        return found.withColumn("doc_id", F.when(~made, F.col("doc_id")).cast(docs.schema["doc_id"].dataType))

    return run


@identified
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return ngram_join.deduplicated(docs, WORDS, PERCENT)


def benchmark_hits(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of documents with a window of the benchmark."""
    judged = written(decontaminate.judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "judged")
    return judged.filter("n_hit > 0").select("doc_id")


@identified
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without byte strings and passages of words that occur elsewhere.

    Benchmark items are passages too. A document that would still hold a window of one keeps its passages below ``LENGTH``, so the next stage finds and removes it.
    """
    spans = written(suffix_dedup.repeated_spans(docs, LENGTH), "spans")
    passages = written(suffix_dedup.repeated_spans(docs, PASSAGE, suffix_dedup.WORD_GRAM, words=True), "passages")
    some, _ = split(docs, passages.select("doc_id"))
    left = written(suffix_dedup.cut(some, spans), "left")  # as the judge reads them again and again
    leaks = benchmark_hits(spark, left, sf_dir).distinct()
    found = suffix_dedup.cut(docs, spans, passages.join(leaks, "doc_id", "left_anti"))
    return found.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else found


@identified
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return without(docs, benchmark_hits(spark, docs, sf_dir))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of each document, and whether they decode to its text."""
    return bpe.tokenized(docs, VOCABULARY, [c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Stages with trained tables and tokenizers are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
