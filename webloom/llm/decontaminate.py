"""Benchmark decontamination with a distributed positional inverted index.

1. Every benchmark item becomes windows of ``WIDTH`` consecutive words (a shorter item is one window).
2. One pass over the corpus counts the benchmark's terms in it. Per window the terms are ordered from the rarest on.
3. A second pass stores the postings (term, document, positions) of the ``PROBES`` rarest terms of each window: the index.
4. The rarest term's list gives places where a window may begin; the lists of the next terms, shifted by
   their place in the window, are intersected with it by equi-joins. What remains is compared with the whole window
   in the text itself, so results are exact.

Terms of the benchmark are sent to executors as sorted 64-bit hashes, at most ``MAX_TERMS`` at a time; a larger benchmark is
worked off in blocks of windows whose terms are counted. No list of documents is collected; a term or passage in a third of all documents is only many rows,
which are joined with the small side of windows.

Contract: null and empty texts have no words; null identifiers are kept; repeated rows are judged each by itself; an empty
benchmark leaves all clean; other columns are not read. Words are compared by 64-bit hashes, windows by hashes of their words.
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
from .sieve import split

WIDTH = 10
PROBES = 3
MAX_TERMS = 2_000_000


def _hashed(column: pa.Array) -> Iterator[tuple[tx.Chunk, tx.Words, np.ndarray]]:
    for chunk in tx.chunks(column):
        chunk.data = tx.LOWER[chunk.data]
        words = tx.find_words(chunk.data, chunk.offsets, tx.ALNUM)
        yield chunk, words, tx.word_hashes(chunk.data, words)


def window_keys(hashes: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, first word, size, key) of the windows of each row."""
    keys = tx.shingle_hashes(hashes, width)
    for row in range(len(first) - 1):
        lo, hi = int(first[row]), int(first[row + 1])
        if hi - lo >= width:
            for i in range(lo, hi - width + 1):
                yield row, i, width, int(keys[i].astype(np.int64))
        elif hi > lo:
            yield row, lo, hi - lo, int(tx.shingle_hashes(hashes[lo:hi], hi - lo)[0].astype(np.int64))


def benchmark_windows(items: DataFrame, width: int = WIDTH, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, window, size, terms``: a window's key is the hash of its words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, hashes in _hashed(batch.column(1)):
                found = list(window_keys(hashes, words.first, width))
                signed = hashes.astype(np.int64)
                rows, starts, sizes, keys = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([chunk.first + r for r in rows], pa.int64())),
                        pa.array(keys, pa.int64()),
                        pa.array(sizes, pa.int32()),
                        pa.array([signed[i : i + n] for i, n in zip(starts, sizes, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["item_id", "window", "size", "terms"],
                )

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, text).transform(arrow_map, run, f"item_id {kind}, window bigint, size int, terms array<bigint>")


def _find(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted vocabulary, or -1."""
    if not len(vocabulary):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def _sent(terms: DataFrame) -> object:
    """A column of terms, proved small before, as a sorted broadcast array."""
    rows = [r[0] for r in terms.collect()]
    return terms.sparkSession.sparkContext.broadcast(np.sort(np.array(rows, np.int64).astype(np.uint64)))


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """``term, n``: occurrences of given terms in the corpus."""
    sent = _sent(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for _, _, hashes in _hashed(batch.column(0)):
                at = _find(sent.value, hashes)
                total += np.bincount(at[at >= 0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[seen].astype(np.int64)), pa.array(total[seen])], names=["term", "n"])

    return docs.select(text).transform(arrow_map, run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, doc_id, positions``: the inverted index of given terms; positions count a document's words from 0."""
    sent = _sent(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, hashes in _hashed(batch.column(1)):
                at = _find(sent.value, hashes)
                hit = np.flatnonzero(at >= 0)
                row = words.rows()[hit]
                order = np.lexsort((hit, at[hit], row))
                hit, row = hit[order], row[order]
                term = at[hit]
                begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(hit) else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[begin, len(hit)].astype(np.int32)), pa.array((hit - words.first[row]).astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sent.value[term[begin]].astype(np.int64)), batch.column(0).take(pa.array(row[begin] + chunk.first)), lists],
                    names=["term", "doc_id", "positions"],
                )

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text).transform(arrow_map, run, "term bigint, doc_id bigint, positions array<int>")


def _probes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``window, size, k, term, place``: the rarest terms of each distinct window, from the rarest (k = 0) on."""
    each = windows.select("window", "size", "terms").dropDuplicates(["window", "size"]).select("window", "size", F.posexplode("terms").alias("place", "term"))
    ranked = each.join(counts, "term").withColumn(
        "k", F.row_number().over(Window.partitionBy("window", "size").orderBy("n", "term", "place")) - 1
    )
    # A term the corpus lacks ends its window here: fewer ranked places than words.
    whole = ranked.withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("window", "size"))).filter("known = size")
    return whole.filter(F.col("k") < PROBES).select("window", "size", "k", "term", "place")


def candidates(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, window, size, start``: where all probed terms of a window stand as they should."""
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    probes = written(_probes(windows, term_counts(docs, terms, text)), "probes")
    index = written(postings(docs, probes.select("term").distinct(), key, text), "postings")
    found = (
        probes.filter("k = 0")
        .join(index, "term")
        .select("doc_id", "window", "size", F.explode("positions").alias("at"), "place")
        .select("doc_id", "window", "size", (F.col("at") - F.col("place")).alias("start"))
        .filter("start >= 0")
    )
    for k in range(1, PROBES):
        probe = probes.filter(F.col("k") == k).select("window", "size", "term", "place")
        longer = found.filter(F.col("size") > k).join(probe, ["window", "size"])
        i = index.select(F.col("doc_id").alias("d"), F.col("term").alias("t"), "positions")
        met = longer.join(i, longer["doc_id"].eqNullSafe(i["d"]) & (longer["term"] == i["t"])).filter(
            F.array_contains("positions", F.col("start") + F.col("place"))
        )
        found = found.filter(F.col("size") <= k).unionByName(met.select("doc_id", "window", "size", "start"))
    return found


def _block(blocks: int) -> Column:
    """By their least terms: neighbouring windows share most of their terms, and mostly the least one."""
    return F.pmod(F.xxhash64(F.array_min("terms")), F.lit(blocks))


def _blocks(windows: DataFrame) -> int:
    """Blocks of windows by hash, as many as it takes that the terms of none are more than ``MAX_TERMS``; blocks share terms, so each is counted."""
    blocks = 1
    while True:
        terms = windows.select(_block(blocks).alias("block"), F.explode("terms").alias("term"))
        most = terms.groupBy("block").agg(F.count_distinct("term").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= MAX_TERMS:
            return blocks
        if blocks > 1 << 40:
            raise ValueError("a window has more terms than may be sent")
        blocks *= 1 << max(1, (most // MAX_TERMS).bit_length() - 1)


def judge(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_hit, windows``: words inside windows of the benchmark, and the windows that occur."""
    windows = written(benchmark_windows(items, width), "windows")
    blocks = _blocks(windows)
    found = candidates(docs, windows.filter(_block(blocks) == 0), key, text)
    for b in range(1, blocks):  # a benchmark beyond the bound of a broadcast: block after block
        found = found.unionByName(candidates(docs, windows.filter(_block(blocks) == b), key, text))
    found = written(found.distinct(), "candidates")
    # A document's list is bounded by its words: as many windows begin at a word as the benchmark has sizes of windows.
    lists = found.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("start", "size", "window")).alias("places"))
    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, n_words bigint, n_hit bigint, windows array<bigint>"
    some, others = split(texts, found.select("doc_id"), then=_compare, schema=schema)
    joined = some.join(lists, some["doc_id"].eqNullSafe(lists["d"]), "left").select("doc_id", "text", "places")
    return joined.transform(arrow_map, _compare, schema).unionByName(others)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count words and compare the texts at candidate places with whole windows; a batch without places has none."""
    for batch in batches:
        for chunk in tx.chunks(batch.column(1)):
            chunk.data = tx.LOWER[chunk.data]
            words = tx.find_words(chunk.data, chunk.offsets, tx.ALNUM)
            n_hit, seen = np.zeros(chunk.rows, np.int64), [[] for _ in range(chunk.rows)]
            if batch.num_columns > 2:
                hashes = tx.word_hashes(chunk.data, words)
                for row in range(chunk.rows):
                    lo, hi = words.first[row], words.first[row + 1]
                    hit, keys = np.zeros(hi - lo, bool), set()
                    for p in batch.column(2)[chunk.first + row].as_py() or ():
                        start, size, window = p["start"], p["size"], p["window"]
                        if start + size <= hi - lo and int(tx.shingle_hashes(hashes[lo + start : lo + start + size], size)[0].astype(np.int64)) == window:
                            hit[start : start + size] = True
                            keys.add(window)
                    n_hit[row] = hit.sum()
                    seen[row] = sorted(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, chunk.rows), pa.array(np.diff(words.first)), pa.array(n_hit), pa.array(seen, pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "n_hit", "windows"],
            )


def item_digest(judged: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``n_items`` and ``items_sha256`` by document identifier."""
    pairs = windows.select("window", F.col("item_id").cast("string").alias("item")).distinct()
    dirty = judged.filter("n_hit > 0").select("doc_id", F.explode("windows").alias("window"))
    items = dirty.join(pairs, "window").groupBy(F.col("doc_id").alias("d")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    joined = judged.join(items, judged["doc_id"].eqNullSafe(items["d"]), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def proximity(docs: DataFrame, phrases: DataFrame, span: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``item_id, doc_id, start, length``: the shortest stretch of at most ``span`` words with all words of a phrase, in any order.

    ``phrases`` has ``item_id, text``; repeated words of a phrase count once, phrases without words match nothing.
    """
    whole = written(benchmark_windows(phrases, 1), "phrases").select("item_id", "terms").withColumn("term", F.element_at("terms", 1)).select("item_id", "term").distinct()
    n_terms = whole.select("term").distinct().count()
    if n_terms > MAX_TERMS:
        raise ValueError(f"at most {MAX_TERMS} different words at a time; split the phrases")
    needed = whole.groupBy("item_id").agg(F.count(F.lit(1)).alias("needed"))
    index = postings(docs, whole.select("term").distinct(), key, text)
    met = (
        whole.join(index, "term").groupBy("item_id", "doc_id").agg(F.collect_list("positions").alias("lists")).join(needed, "item_id")
    ).filter(F.size("lists") == F.col("needed"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shortest_stretch(x) for x in batch.column("lists").to_pylist()]
            near = [i for i, f in enumerate(found) if f[1] <= span]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id").take(pa.array(near, pa.int64())),
                    batch.column("doc_id").take(pa.array(near, pa.int64())),
                    pa.array([found[i][0] for i in near], pa.int32()),
                    pa.array([found[i][1] for i in near], pa.int32()),
                ],
                names=["item_id", "doc_id", "start", "length"],
            )

    kinds = [met.schema[c].dataType.simpleString() for c in ("item_id", "doc_id")]
    return met.select("item_id", "doc_id", "lists").transform(arrow_map, run, f"item_id {kinds[0]}, doc_id {kinds[1]}, start int, length int")


def shortest_stretch(lists: list[list[int]]) -> tuple[int, int]:
    """First and number of words of the shortest stretch with a position of every list; the first of equals."""
    places = sorted((p, i) for i, positions in enumerate(lists) for p in positions)
    last: dict[int, int] = {}
    best = (0, 1 << 30)
    for p, i in places:
        last[i] = p
        if len(last) == len(lists):
            start = min(last.values())
            if p - start + 1 < best[1]:
                best = (start, p - start + 1)
    return best
