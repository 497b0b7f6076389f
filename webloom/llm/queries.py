"""Registered queries of the first ten operators (the others are in ``more_queries``): each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import bpe, chat_roles, decontaminate, ngram_join, quality_gam, quality_rules, suffix_dedup, token_counts, training_order, url_cascade

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op8_decontamination(spark, sf):
    items = table(spark, sf, "benchmark")
    judged = decontaminate.judge(table(spark, sf, "documents"), items)
    return decontaminate.item_digest(written(judged, "judged"), decontaminate.benchmark_windows(items))


@query
def op9_quality_rules(spark, sf):
    return quality_rules.judge(table(spark, sf, "documents"))


@query
def op10_bpe(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), BYTE_BPE)


@query
def op6_ngram_join(spark, sf):
    return ngram_join.self_join(table(spark, sf, "documents"), words=4, percent=85)


@query
def op7_suffix_dedup(spark, sf):
    return suffix_dedup.digest(table(spark, sf, "documents"), length=400)


@query
def op1_quality_gam(spark, sf):
    return quality_gam.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


#: Given by the contract of op5.
RULES = (
    url_cascade.Rule("allow", "com", "/"),
    url_cascade.Rule("block", "example.com", "/en/"),
    url_cascade.Rule("allow", "www.example.com", "/en/"),
    url_cascade.Rule("block", "net", "/es/"),
    url_cascade.Rule("block", "net", "/fr/"),
)
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_ENDINGS = ("example.com", "example.net", "example.org")


def listed_sites(spark: SparkSession) -> DataFrame:
    """The list of sites to block: every name under every ending."""
    sites = [f"{name}.{ending}" for name in LISTED_NAMES for ending in LISTED_ENDINGS]
    return spark.range(1).select(F.explode(F.array(*map(F.lit, sites))).alias("key"))


@query
def op5_url_filters(spark, sf):
    return url_cascade.judge(table(spark, sf, "pages"), RULES, listed_sites(spark))


@query
def op2_training_order(spark, sf):
    return training_order.materialise(table(spark, sf, "documents"), BYTE_RANKS, end=50_256)


@query
def op3_token_counts(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"), BYTE_RANKS)


@query
def op4_chat_roles(spark, sf):
    return chat_roles.format_chats(table(spark, sf, "conversations"))
