"""Quality rules with adaptive thresholds.

Each text is measured in one pass (whole texts, numpy inside Arrow batches). Per (language, source) a mergeable quantile
sketch is kept for each measure: log-linear bins of integers with 64 steps per power of two, and a count in each. Such
sketches merge by adding counts, so the result does not depend on partitions, order or retries; the error of a quantile is below 1/64 of its value.
Groups below ``MIN_GROUP`` texts use the merged sketch of their language, and languages below it that of the table. A fence
stands three quartile distances (and a slack) outside the quartiles; texts beyond a fence are dropped by a join
with the thresholds. The table of thresholds has a row per group; a hot source is combined before every exchange.

Contract: null is the empty text, which has no words and so fails the base rule; null language or source is a group of its
own; empty tables give no rows; rows are judged each by itself, repeated rows alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tasks import arrow_map
from . import text as tx

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
NOT_NEWLINE = np.ones(256, dtype=bool)
NOT_NEWLINE[10] = False

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 200
FENCE = 3
#: measure: (numerator, factor, denominator, slack, two-sided)
MEASURES = {
    "word_length": ("word_chars", 100, "n_words", 100, True),
    "symbols": ("n_symbols", 10_000, "word_chars", 300, False),
    "dup_lines": ("n_dup_lines", 10_000, "n_lines", 5_000, False),
    "repeats": ("n_repeat_words", 10_000, "n_words", 4_000, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Places whose key occurs more than once, in order of key and then of place."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return order[twice]


def measure_chunk(chunk: tx.Chunk) -> dict[str, np.ndarray]:
    data, offsets, rows = chunk.data, chunk.offsets, chunk.rows
    words = tx.find_words(data, offsets, tx.NOT_SPACE)
    prefix = tx.prefix_hash(data)
    n_words = np.diff(words.first)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    word_chars = total(tx.NOT_SPACE[data] & ((data & 0xC0) != 0x80))
    lines = tx.find_words(data, offsets, NOT_NEWLINE)
    has_word = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    of_line = lines.rows()[has_word]
    start, end = lines.start[has_word], lines.end[has_word]
    line_key = tx.span_keys(data, prefix, start, end) ^ tx.mix(of_line.astype(np.uint64) + np.uint64(1))
    n_lines = np.bincount(of_line, minlength=rows)
    _, once = np.unique(line_key, return_index=True)
    n_dup_lines = n_lines - np.bincount(of_line[once], minlength=rows)

    word_hash = tx.span_keys(data, prefix, words.start, words.end)
    grams = tx.shingle_hashes(word_hash, 3)
    row = words.rows()
    n_repeat = np.zeros(rows, np.int64)
    if len(grams):
        whole = np.flatnonzero(row[: len(grams)] == row[2:])
        at = whole[_repeated(grams[whole] ^ tx.mix(row[whole].astype(np.uint64) + np.uint64(1)))]
        covered = np.zeros(len(row), bool)
        for k in range(3):
            covered[at + k] = True
        n_repeat = np.bincount(row[covered], minlength=rows)
    values = (n_words, word_chars, total(SYMBOLS[data]), n_lines, n_dup_lines, n_repeat)
    return {k: v.astype(np.int64) for k, v in zip(COUNTS, values, strict=True)}


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang, source`` and the counts of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(3)):
                found = measure_chunk(chunk)
                kept = [batch.column(i).slice(chunk.first, chunk.rows) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found.values())], names=["doc_id", "lang", "source", *found])

    kind = docs.schema[key].dataType.simpleString()
    columns = [F.col(key).alias("doc_id"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col(text)]
    return docs.select(*columns).transform(arrow_map, run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def value_of(name: str) -> Column:
    over, factor, under, _, _ = MEASURES[name]
    return F.expr(f"({factor} * {over}) div greatest({under}, 1)")


def bin_of(value: Column) -> Column:
    """Lower end of the log-linear bin of an integer from 0 on."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0)).cast("int")
    step = F.pow(F.lit(2.0), shift).cast("bigint")
    return F.floor(value / step).cast("bigint") * step


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bin, n``: the quantile sketch of each group and measure."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), value_of(m).alias("v")) for m in MEASURES])
    each = measured.select("lang", "source", F.explode(pairs).alias("p"))
    return each.groupBy("lang", "source", F.col("p.measure").alias("measure"), bin_of(F.col("p.v")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, size, low, high`` of sketches merged to the level of the keys."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    counted = merged.withColumn("size", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bin")))
    q = counted.groupBy(*keys, "measure").agg(
        F.first("size").alias("size"),
        F.min(F.when(4 * F.col("upto") >= F.col("size"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("size"), F.col("bin"))).alias("q3"),
    )
    slack = F.create_map(*[x for m, v in MEASURES.items() for x in (F.lit(m), F.lit(v[3]))])[F.col("measure")]
    out = FENCE * (F.col("q3") - F.col("q1")) + slack
    return q.select(*keys, "measure", "size", (F.col("q1") - out).alias("low"), (F.col("q3") + out).alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``lang, source`` and for each measure its fences, taken from the smallest level with enough texts."""
    levels = [fences(sketch, keys) for keys in (["lang", "source"], ["lang"], [])]
    groups = sketch.select("lang", "source", "measure").distinct().alias("g")

    def same(level: str, keys: list[str]) -> Column:
        on = F.col("g.measure") == F.col(f"{level}.measure")
        for k in keys:
            on = on & F.col(f"g.{k}").eqNullSafe(F.col(f"{level}.{k}"))
        return on

    a, b, c = (level.alias(x) for level, x in zip(levels, "abc", strict=True))
    joined = groups.join(a, same("a", ["lang", "source"])).join(b, same("b", ["lang"])).join(c, same("c", []))

    def pick(name: str) -> Column:
        return (
            F.when(F.col("a.size") >= MIN_GROUP, F.col(f"a.{name}")).when(F.col("b.size") >= MIN_GROUP, F.col(f"b.{name}")).otherwise(F.col(f"c.{name}"))
        )

    flat = joined.select("g.lang", "g.source", "g.measure", pick("low").alias("low"), pick("high").alias("high"))
    ends = [F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}") for m in MEASURES for e in ("low", "high")]
    return flat.groupBy("lang", "source").agg(*ends)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each text, ``base_failed`` and ``kept``."""
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    measured = written(measure(docs, key, text).withColumn("base_failed", failed), "measured")
    limits = written(thresholds(sketches(measured.filter(~F.col("base_failed")))), "thresholds").alias("t")
    inside = F.lit(True)
    for m, (_, _, _, _, two_sided) in MEASURES.items():
        inside = inside & (value_of(m) <= F.col(f"t.{m}_high"))
        if two_sided:
            inside = inside & (value_of(m) >= F.col(f"t.{m}_low"))
    on = F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source"))
    joined = measured.alias("d").join(limits, on, "left")
    return joined.select("d.doc_id", *[f"d.{c}" for c in COUNTS], "d.base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
