"""A fixed-size bit set of identifiers, so that texts nobody asks for are not shuffled.

It holds all identifiers given and some others, so it only spares work: the joins that follow decide. Its size does not depend on the data; beyond some tens of
millions of identifiers it lets more and more through, and everything stays right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tasks import arrow_map

SIEVE_BITS = 1 << 24


def sieve(spark: SparkSession, ids: DataFrame) -> object:
    """A fixed-size bit set that holds the given identifiers and some others: it spares moving texts nobody asks for."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS)) + 1
    parts = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    whole = np.zeros(SIEVE_BITS, bool)
    for k, bits in parts.collect():  # at most SIEVE_BITS bits
        span = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")
        whole[(k - 1) * len(span) : k * len(span)] = span
    return spark.sparkContext.broadcast(np.packbits(whole))


def split(docs: DataFrame, ids: DataFrame, key: str = "doc_id", then: Callable | None = None, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(about the rows whose key is among ``ids.doc_id``: a superset; all other rows), both with all columns and without a shuffle.

    ``then`` turns the batches of the other rows into those of ``schema`` in the same Python worker.
    """
    sent = sieve(docs.sparkSession, ids)
    slot = "slot"
    while slot in docs.columns:
        slot += "_"

    def part(batches: Iterable[pa.RecordBatch], others: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            slots = batch.column(n).to_numpy()
            held = (sent.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
            yield batch.filter(pa.array((held == 1) != others)).select(list(range(n)))

    marked = docs.withColumn(slot, F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(SIEVE_BITS)))
    some = marked.transform(arrow_map, lambda batches: part(batches, False), docs.schema)
    if then is None:
        return some, marked.transform(arrow_map, lambda batches: part(batches, True), docs.schema)
    return some, marked.transform(arrow_map, lambda batches: then(part(batches, True)), schema)


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def wanted_texts(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, text`` of about the rows asked for (a superset), without a shuffle."""
    return split(texts_of(docs, key, text), ids)[0]


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows but those whose key is among ``ids.doc_id``, with all columns; only rows that pass the sieve are shuffled."""
    some, others = split(docs, ids, key)
    return some.join(ids.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns).unionByName(others)
