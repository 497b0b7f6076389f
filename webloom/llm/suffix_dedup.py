"""Removal of byte strings that occur more than once, by a hash-compared suffix sort.

A string of ``length`` bytes is a repeat if it also starts anywhere else in the corpus. Sorting every suffix of a corpus would shuffle
many times its size, so suffixes are sampled by their content: the *anchor* of a string is the first of its
least-hashed 64-byte grams. Equal strings have equal anchors at equal places, and strings that follow each other
mostly share one, so a document falls into runs (first start, last start, anchor), some 170 bytes apart.

1. One pass makes the runs, with the hash of the anchor and of the run's bytes.
2. Anchors are counted. An anchor seen once has no repeats. An anchor all of whose runs are equal makes them repeats as a whole.
3. Of the other anchors the different runs are fetched, one for each. Per anchor their suffixes from the anchor on, and
   their reversed prefixes before it, are sorted by merge sort. Two suffixes are compared by their longest common extension, found
   by binary search over prefix polynomial hashes, so in logarithmic time; neighbours are then compared byte by byte
   (a collision makes the group be sorted anew by bytes). With ``L`` and ``R`` the common extensions of two runs to both
   sides, the strings that begin ``length - R`` to ``L`` bytes before the anchor are repeats. Nearest neighbours suffice: runs are
   united from the longest common prefix down, smaller sets into larger, and only a new neighbour changes a result.
4. An anchor with more than ``GROUP`` different runs is not brought into one task: its strings are counted by hash,
   combined before the exchange.

The same is done for words (``words=True``): a string is then a number of words, whatever white space is between them, and each word is
compared by the eight bytes of its hash. Lengths and places are counted in words, and only strings that begin and end with a word count.

Contract: null is the empty text; texts shorter than ``length`` keep all bytes; copies, also of one row, remove each other
wholly; an empty table gives no rows; a document with a null identifier takes no part: it keeps all its bytes, and they are
no occurrences; identifiers are unique but for rows repeated as a whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .tasks import arrow_map
from . import text as tx
from .sieve import split, texts_of, wanted_texts

LENGTH = 400
GRAM = 64
WORD_GRAM = 8  #: words
GROUP = 2048
ROWS = 1024  #: sorted together, besides one whole group
PLACE_BITS = 24  #: of a place in a block, below the hash in a packed key
BLOCK = 1 << 18
CHUNK = 1 << 17  #: bytes of texts at a time; each byte takes some 100 bytes of arrays


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbours, by doubling."""
    done = 1
    while 2 * done <= size:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (size - done)], x[size - done :]) if done < size else x


def symbols(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """What strings are made of, the bytes or the hashes of the words, and where each row begins in it."""
    if not words:
        return data, offsets
    found = tx.find_words(data, offsets, tx.NOT_SPACE)
    return tx.word_hashes(data, found), found.first


def gram_hashes(block: np.ndarray, gram: int) -> np.ndarray:
    if block.dtype != np.uint8:
        return tx.shingle_hashes(block, gram)
    n = len(block) - gram + 1
    prefix = tx.prefix_hash(block)
    return tx.mix((prefix[gram:] - prefix[:n]) * tx.powers(n)[1])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor, anchor's hash) of the runs of strings inside rows."""
    parts = []
    for at in range(0, max(len(data) - length + 1, 0), BLOCK):
        block = data[at : at + BLOCK + length - 1]
        n = len(block) - gram + 1
        hashes = gram_hashes(block, gram)
        packed = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        place = (_sliding_min(packed, length - gram + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        starts = np.arange(len(place)) + at
        row = np.searchsorted(offsets, starts, "right")
        starts, place = starts[starts + length <= offsets[row]] if len(row) else starts, place[starts + length <= offsets[row]] if len(row) else place
        if len(starts):
            new = np.r_[True, place[1:] != place[:-1]]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(starts)] - 1
            parts.append((starts[first], starts[last], place[first] + at, hashes[place[first]]))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def anchored(docs: DataFrame, length: int, gram: int, key: str, text: str, words: bool = False) -> DataFrame:
    """``doc_id, first, last, anchor, ah, sh, until, times``: the runs of all documents, with hashes of the anchor and of the bytes.

    Equal runs that follow each other, as in text with a short period, are one row: the first of them, how many they are and where the last one's strings end.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(1), CHUNK):
                data, offsets = symbols(chunk.data, chunk.offsets, words)
                first, last, anchor, hashes = runs(data, offsets, length, gram)
                row = np.searchsorted(offsets, first, "right") - 1
                raw = memoryview(np.ascontiguousarray(data))
                ends = (last + length).tolist()
                whole = np.array(
                    [xxhash.xxh3_64_intdigest(raw[s:e], c) for s, e, c in zip(first.tolist(), ends, (anchor - first).tolist(), strict=True)], np.uint64
                )
                new = np.ones(len(first), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]) | (whole[1:] != whole[:-1]) | (first[1:] != last[:-1] + 1)
                at = np.flatnonzero(new)
                behind = np.append(at[1:], len(first))
                until, times = last[behind - 1] if len(at) else last, behind - at
                row, first, last, anchor, hashes, whole = (x[at] for x in (row, first, last, anchor, hashes, whole))
                base = offsets[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + chunk.first)),
                        *[pa.array((x - base).astype(np.int32)) for x in (first, last, anchor)],
                        pa.array(hashes.astype(np.int64)),
                        pa.array(whole.astype(np.int64)),
                        pa.array((until - base).astype(np.int32)),
                        pa.array(times.astype(np.int32)),
                    ],
                    names=["doc_id", "first", "last", "anchor", "ah", "sh", "until", "times"],
                )

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text).filter("doc_id is not null").transform(arrow_map,
        run, "doc_id bigint, first int, last int, anchor int, ah bigint, sh bigint, until int, times int"
    )


class Suffixes:
    """Byte strings with their prefix hashes."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        sizes = np.array([len(x) for x in texts], np.int64)
        begin = np.r_[0, np.cumsum(sizes + 1)][:-1]
        # A byte after each string leaves room for its whole prefix; sums are shifted as if each string stood at place 0.
        prefix = tx.prefix_hash(np.frombuffer(b"".join(x + b"\0" for x in texts), np.uint8))[:-1]
        prefix -= np.repeat(prefix[begin], sizes + 1)
        prefix *= np.repeat(tx.powers(len(prefix))[1][begin], sizes + 1)
        self.hashes = memoryview(prefix)
        self.at = begin.tolist()
        self.sizes = sizes.tolist()

    def common(self, i: int, j: int) -> int:
        """Longest common extension from the start: a binary search over prefix hashes."""
        h, a, b = self.hashes, self.at[i], self.at[j]
        low, high = 0, min(self.sizes[i], self.sizes[j])
        if h[a + high] == h[b + high]:
            return high
        while high - low > 1:
            middle = (low + high) // 2
            if h[a + middle] == h[b + middle]:
                low = middle
            else:
                high = middle
        return low

    def compare(self, i: int, j: int) -> int:
        n = self.common(i, j)
        x, y = self.texts[i][n : n + 1], self.texts[j][n : n + 1]
        return (x > y) - (x < y)

    def order(self, members: list[int]) -> tuple[list[int], list[int]]:
        """Members by merge sort, and the common extension of each with the one before."""
        ordered = sorted(members, key=cmp_to_key(self.compare))
        shared = [0] + [self.common(i, j) for i, j in zip(ordered, ordered[1:])]
        for k in range(1, len(ordered)):
            x, y, n = self.texts[ordered[k - 1]], self.texts[ordered[k]], shared[k]
            if x[:n] != y[:n] or not (x[n : n + 1] < y[n : n + 1] or (len(x) == n == len(y))):
                raise HashCollision
        return ordered, shared


class PlainSuffixes(Suffixes):
    """The same by bytes alone, for a group with a collision."""

    def common(self, i: int, j: int) -> int:
        x, y = self.texts[i], self.texts[j]
        low, high = 0, min(len(x), len(y))
        while low < high:
            middle = (low + high + 1) // 2
            if x[:middle] == y[:middle]:
                low = middle
            else:
                high = middle - 1
        return low


class HashCollision(Exception):
    pass


def repeats_of_group(before: Suffixes, after: Suffixes, members: list[int], length: int) -> dict[int, list[tuple[int, int]]]:
    """For different runs around one anchor: from where to where, in bytes before the anchor, strings begin that another run has too."""
    by_left, left = before.order(members)
    rank = {m: k for k, m in enumerate(after.order(members)[0])}
    member = {k: m for m, k in rank.items()}
    best: dict[int, int] = {}
    found: dict[int, list[tuple[int, int]]] = {}

    def met(i: int, j: int, reach: int) -> None:
        right = after.common(i, j)
        for m in (i, j):
            if right > best.get(m, 0):
                best[m] = right
                if length - right <= reach:
                    found.setdefault(m, []).append((length - right, reach))

    united = [[rank[m]] for m in by_left]  # right ranks of the set of each place in left order
    owner = list(range(len(by_left)))

    def root(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    for k in sorted(range(1, len(by_left)), key=lambda k: -left[k]):
        a, b = root(k - 1), root(k)
        if len(united[a]) < len(united[b]):
            a, b = b, a
        ranks = united[a]
        for r in united[b]:
            p = bisect_left(ranks, r)
            for q in (p - 1, p):
                if 0 <= q < len(ranks):
                    met(member[r], member[ranks[q]], left[k])
            ranks.insert(p, r)
        united[b], owner[b] = [], a
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _whole_symbols(spans: list[tuple[int, int]], size: int) -> Iterator[tuple[int, int]]:
    """Places in bytes as places in symbols: those that are a symbol's first byte."""
    return ((-(-lo // size), hi // size) for lo, hi in spans if -(-lo // size) <= hi // size)


def sort_groups(segments: DataFrame, length: int, size: int = 1) -> DataFrame:
    """``ah, sh, spans`` of ``ah, sh, back, bytes``: the suffix sort of every anchor's different runs, streamed group by group; a symbol has ``size`` bytes."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        before = [r[3][: r[2]][::-1] for r in rows]
        after = [r[3][r[2] :] for r in rows]
        pair = Suffixes(before), Suffixes(after)
        out = []
        lo = 0
        while lo < len(rows):
            hi = lo
            while hi < len(rows) and rows[hi][0] == rows[lo][0]:
                hi += 1
            members = list(range(lo, hi))
            try:
                found = repeats_of_group(*pair, members, length * size)
            except HashCollision:
                plain = PlainSuffixes(before[lo:hi]), PlainSuffixes(after[lo:hi])
                found = {lo + i: s for i, s in repeats_of_group(*plain, list(range(hi - lo)), length * size).items()}
            places = ((i, _merged(list(_whole_symbols(s, size)))) for i, s in found.items())
            out += [(rows[i][0], rows[i][1], [{"lo": a, "hi": b} for a, b in s]) for i, s in places if s]
            lo = hi
        keys, hashes, spans = zip(*out, strict=True) if out else ((), (), ())
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(spans, kind)], names=["ah", "sh", "spans"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held += zip(*(batch.column(c).slice(at, ROWS).to_pylist() for c in ("ah", "sh", "back", "bytes")), strict=True)
                cut = len(held)  # all but the last group, which may go on
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut >= ROWS:
                    yield solve(held[:cut])
                    held = held[cut:]
        yield solve(held)

    ordered = segments.select("ah", "sh", "back", "bytes").repartition("ah").sortWithinPartitions("ah", "sh")
    return ordered.transform(arrow_map, run, "ah bigint, sh bigint, spans array<struct<lo:int,hi:int>>")


def count_strings(segments: DataFrame, length: int, size: int = 1) -> DataFrame:
    """The same result for anchors with very many different runs: every string by its hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ah, sh, back, raw in zip(*(batch.column(c).to_pylist() for c in ("ah", "sh", "back", "bytes")), strict=True):
                n = len(raw) // size - length + 1
                start = np.arange(n) * size
                strings = tx.span_hash(tx.prefix_hash(np.frombuffer(raw, np.uint8)), start, start + length * size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, ah)), pa.array(np.full(n, sh)), pa.array(((back - start) // size).astype(np.int32)), pa.array(tx.mix(strings).astype(np.int64))],
                    names=["ah", "sh", "o", "string"],
                )

    each = written(segments.select("ah", "sh", "back", "bytes").transform(arrow_map, run, "ah bigint, sh bigint, o int, string bigint"), "strings")
    twice = each.groupBy("ah", "o", "string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    hits = each.join(twice, ["ah", "o", "string"])  # a run has at most `length` strings of one anchor
    places = hits.groupBy("ah", "sh").agg(F.sort_array(F.collect_set("o")).alias("o"))
    # Neighbouring places are one span.
    low = F.filter("o", lambda x, i: (i == 0) | (F.get("o", i - 1) < x - 1))
    high = F.filter("o", lambda x, i: (i == F.size("o") - 1) | (F.get("o", i + 1) > x + 1))
    return places.select("ah", "sh", F.arrays_zip(low.alias("lo"), high.alias("hi")).alias("spans"))


def segments_of(classes: DataFrame, docs: DataFrame, length: int, key: str, text: str, words: bool = False) -> DataFrame:
    """``ah, sh, wide, back, bytes``: the bytes of one run of each class; ``back`` is where its anchor is."""
    wanted = classes.groupBy("doc_id").agg(F.collect_list(F.struct("ah", "sh", "wide", "first", "last", "anchor")).alias("cuts"))
    texts = wanted_texts(docs, classes.select("doc_id"), key, text).dropDuplicates(["doc_id"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_, cuts in zip(batch.column(0), batch.column(1), strict=True):
                raw, cuts = text_.as_py().encode(), cuts.as_py()
                data, _ = symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), words)
                size, raw = data.itemsize, data.tobytes() if words else raw
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c["ah"] for c in cuts], pa.int64()),
                        pa.array([c["sh"] for c in cuts], pa.int64()),
                        pa.array([c["wide"] for c in cuts], pa.bool_()),
                        pa.array([(c["anchor"] - c["first"]) * size for c in cuts], pa.int32()),
                        pa.array([raw[c["first"] * size : (c["last"] + length) * size] for c in cuts], pa.binary()),
                    ],
                    names=["ah", "sh", "wide", "back", "bytes"],
                )

    return texts.join(wanted, "doc_id").select("text", "cuts").transform(arrow_map, run, "ah bigint, sh bigint, wide boolean, back int, bytes binary")


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", group: int = GROUP, words: bool = False
) -> DataFrame:
    """``doc_id, begin, end``: byte spans of repeats, or their words from and to; they may overlap."""
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    size = 8 if words else 1
    marked = written(anchored(docs, length, gram, key, text, words), "runs")
    anchors = marked.groupBy("ah").agg(F.sum("times").alias("n"), F.min("sh").alias("lo"), F.max("sh").alias("hi")).filter("n > 1")
    shared = written(marked.join(anchors.select("ah", (F.col("lo") < F.col("hi")).alias("mixed")), "ah"), "shared")
    mixed = shared.filter("mixed")
    classes = mixed.groupBy("ah", "sh").agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "first", "last", "anchor")).alias("at"))
    classes = written(classes.select("ah", "sh", "n", "at.*"), "classes")
    sizes = classes.groupBy("ah").agg((F.count(F.lit(1)) > group).alias("wide"))
    segments = written(segments_of(classes.join(sizes, "ah"), docs, length, key, text, words), "segments")
    solved = sort_groups(segments.filter("not wide"), length, size).unionByName(count_strings(segments.filter("wide"), length, size))
    # One outcome for each different run: all of it (no spans), or some strings. Equal runs (n > 1) are repeats as a whole, rows of several among them.
    outcome = classes.join(solved, ["ah", "sh"], "left").filter("n > 1 or spans is not null")
    outcome = outcome.select("ah", "sh", F.when(F.col("n") == 1, F.col("spans")).alias("spans"), F.lit(True).alias("known"))
    joined = shared.join(outcome, ["ah", "sh"], "left").filter("not mixed or known")
    every = F.array(F.struct((F.col("anchor") - F.col("until")).alias("lo"), (F.col("anchor") - F.col("first")).alias("hi")))
    some = joined.select("doc_id", "anchor", F.explode(F.coalesce("spans", every)).alias("s"))
    return some.select("doc_id", (F.col("anchor") - F.col("s.hi")).alias("begin"), (F.col("anchor") - F.col("s.lo") + length).alias("end"))


def _union(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    at = 0
    for begin, end in spans:
        yield raw[at:begin]
        at = end
    yield raw[at:]


def digest(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode()
                spans = _union(batch.column(2)[i].as_py()) if batch.num_columns > 2 else []
                kept = hashlib.sha256()
                for part in kept_bytes(raw, spans):
                    kept.update(part)
                rows.append((len(raw), sum(e - b for b, e in spans), len(spans), kept.hexdigest()))
            n, removed, count, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (n, removed, count)], pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    spans = written(repeated_spans(docs, length, key=key, text=text), "spans")
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    some, others = split(texts_of(docs, key, text), spans.select("doc_id"), then=run, schema=schema)
    return some.join(lists, "doc_id", "left").select("doc_id", "text", "spans").transform(arrow_map, run, schema).unionByName(others)


def byte_spans(raw: bytes, spans: list[dict]) -> list[dict]:
    """Spans of words as spans of bytes, from the first word's begin to the last word's end; spans of bytes as they are."""
    if not any(s["words"] for s in spans):
        return spans
    found = tx.find_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), tx.NOT_SPACE)
    return [{"begin": int(found.start[s["begin"]]), "end": int(found.end[s["end"] - 1])} if s["words"] else s for s in spans if not s["words"] or s["end"] <= len(found.end)]


def cleaned(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, without their repeats; bytes of a character cut in two by a removal go as well."""
    return cut(docs, written(repeated_spans(docs, length, key=key, text=text), "spans"), key=key, text=text)


def cut(docs: DataFrame, spans: DataFrame, by_word: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the spans of bytes and, if given, of words; both are places in the texts as they come in."""
    spans = spans.withColumn("words", F.lit(False))
    if by_word is not None:
        spans = spans.unionByName(by_word.withColumn("words", F.lit(True)))
    lists = spans.groupBy(F.col("doc_id").alias("own id")).agg(F.collect_list(F.struct("begin", "end", "words")).alias("own spans"))
    some, others = split(docs, spans.select("doc_id"), key)
    joined = some.join(lists, F.col(key) == F.col("own id"), "left").drop("own id")
    place = joined.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            texts = []
            for t, s in zip(batch.column(place), batch.column(n), strict=True):
                whole, spans_ = t.as_py(), s.as_py()
                if spans_ is not None:
                    raw = (whole or "").encode()
                    whole = "".join(part.decode("utf-8", "ignore") for part in kept_bytes(raw, _union(byte_spans(raw, spans_))))
                texts.append(whole)
            columns = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n])

    return joined.transform(arrow_map, run, docs.schema).unionByName(others)
