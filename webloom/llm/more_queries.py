"""Registered queries of the operators from the eleventh on: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import conversation_repair, packing, periodic_runs
from .queries import WORD_BPE, Query, table

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op11_packing(spark, sf):
    packed = packing.pack(table(spark, sf, "documents"), WORD_BPE, end=2, window=4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by a hash of conversation and turn a row is dropped, emptied, cut off, repeated or said by the user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", space).alias("text"), (F.crc32(name) % 20).alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.coalesce("role", space))
    twice = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


@query
def op12_conversation_repair(spark, sf):
    conversations = table(spark, sf, "conversations")
    return conversation_repair.summary_of(conversations, damaged(conversations))


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the contract's planted periods: where h % 10 = 0, words from a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    docs = docs.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(sequence(0, n - 1), i -> get(words, cast(if(i < a, i, a + (i - a) % p) as int))), ' ')")
    return docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark, sf):
    return periodic_runs.digest(periodic_runs.periodic_runs(with_periods(table(spark, sf, "documents"))))
