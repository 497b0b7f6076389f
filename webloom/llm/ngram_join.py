"""N-gram Jaccard self-join with an R-tree of count vectors.

A document's set is its distinct ``words``-word shingles (64-bit hashes). Its *count vector* counts them in groups by hash.
The sum of coordinate minima bounds the overlap of two sets from above, and the minima with a node's largest
coordinates bound it for all sets below a node. Vectors fold: groups are hash values modulo a power of two, so halves add up.

1. One pass counts shingles in a fixed number of cells; it gives a global order in which shingles of hot cells come last.
2. A second pass makes each document's features: size, set key, vector, its least hashes, and its prefix in that
   order (of two sets that link, the prefixes share a shingle). Equal sets become one class.
3. First pass over links: documents with an equal least hash are each tried with the first of them (one candidate per
   document and hash, so groups of copies stay linear). Bounds, then exact sets decide; components are made.
4. Second pass, for all that is left: prefix shingles whose documents are in more than one component. Their
   documents stream, ordered by size, through an R-tree join per shingle; only pairs of different components whose bounds
   allow a link are exact-checked. A pair that shares the shingle before as well has been told there, and the places of the
   shingle in both prefixes bound the overlap too. No pair inside a component is made, no link between components is lost. Documents of a hot
   shingle are split into blocks by size and hash, and each two blocks near in size are a group of a shuffle, so a task holds two blocks.

Contract: null and empty texts and texts without words have an empty set, size 0, are linked with nothing and are their own
component; a text with fewer words than a shingle has one shingle of all its words; identifiers are unique, rows
that repeat as a whole give repeated result rows, a null identifier is returned unlinked with a null component; an empty
table gives no rows; other columns are not read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tasks import arrow_map
from . import text as tx
from .graph import components
from .sieve import split, wanted_texts

CELLS = 1 << 20  #: of the hotness sketch; a byte each is broadcast
CELL_BITS = 20
CELL_BLOCK = 1 << 10
HOT_FACTOR = 1.5  #: times the median cell
GROUPS = 128  #: coordinates of the vectors in the tree
FANOUT = 16
BLOCK = 4096  #: vectors per tree
SPLIT = 4 * BLOCK  #: documents of a prefix shingle in one task; more are split into blocks, and a task gets two of them
PAIRS_AT_ONCE = 1 << 14
BEFORE = 3  #: shingles before one in its prefix that go with it
LEAST = 4  #: hash orders of the first pass


def _by_row(row: np.ndarray, order: np.ndarray) -> np.ndarray:
    """An order, made one by row first; short integers are sorted by digits."""
    short = row.astype(np.uint16) if len(row) and row.max() < 1 << 16 else row
    return order[np.argsort(short[order], kind="stable")]


def _shingles(chunk: tx.Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of a chunk, as they come."""
    data = tx.LOWER[chunk.data]
    found = tx.find_words(data, chunk.offsets, tx.NOT_SPACE)
    hashes = tx.word_hashes(data, found)
    row, n = found.rows(), np.diff(found.first)
    grams = tx.shingle_hashes(hashes, words)
    whole = np.flatnonzero(row[: len(grams)] == row[words - 1 :]) if len(grams) else np.empty(0, np.int64)
    rows, keys = [row[whole]], [grams[whole]]
    for r in np.flatnonzero((n > 0) & (n < words)):
        lo, hi = found.first[r], found.first[r + 1]
        rows.append(np.array([r]))
        keys.append(tx.shingle_hashes(hashes[lo:hi], hi - lo) ^ np.uint64(hi - lo))
    return np.concatenate(rows), np.concatenate(keys)


def _sets(chunk: tx.Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of a chunk, distinct, ordered by row and shingle."""
    row, key = _shingles(chunk, words)
    order = _by_row(row, np.argsort(key))
    row, key = row[order], key[order]
    if len(row):
        new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]
        row, key = row[new], key[new]
    return row, key


def hot_cells(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """For each cell 0, or the power of two by which it exceeds the usual cell: a fixed-size summary of all shingles."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for chunk in tx.chunks(batch.column(0)):
                _, key = _shingles(chunk, words)
                total += np.bincount((key >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=CELLS)
        blocks = total.reshape(-1, CELL_BLOCK)
        packed = [b.astype("u1" if b.max() < 256 else "<u8").tobytes() for b in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array(packed, pa.binary())], names=["block", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(counts, "u1" if len(counts) == CELL_BLOCK else "<u8").astype(np.int64)
                total[block] = total[block] + got if block in total else got
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["block", "counts"])

    parts = docs.select(text).transform(arrow_map, count, "block bigint, counts binary").repartition("block")
    summed = parts.transform(arrow_map, add, "block bigint, counts binary").collect()  # CELLS numbers, whatever the table
    total = np.zeros((CELLS // CELL_BLOCK, CELL_BLOCK), np.int64)
    for block, counts in summed:
        total[block] = np.frombuffer(counts, np.int64)
    cells = total.ravel()
    usual = max(float(np.median(cells)), 8.0)
    return np.maximum(np.floor(np.log2(np.maximum(cells, 1) / (usual * HOT_FACTOR))) + 1, 0).astype(np.uint8)


def vector_size(n: int) -> int:
    return max(GROUPS, 1 << max(0, int(n // 4) - 1).bit_length())


def fold(vector: np.ndarray, size: int) -> np.ndarray:
    return vector.reshape(-1, size).sum(axis=0)


def features(docs: DataFrame, key: str, text: str, words: int, percent: int, hot: object) -> DataFrame:
    """``doc_id, n, h1, h2, least, prefix, tree, vector``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(1)):
                row, shingle = _sets(chunk, words)
                n = np.bincount(row, minlength=chunk.rows)
                first = np.r_[0, np.cumsum(n)]
                some = np.flatnonzero(n)
                sums = np.zeros((2 + LEAST, chunk.rows), np.uint64)
                if len(some):
                    sums[0][some] = np.add.reduceat(tx.mix(shingle), first[some])
                    sums[1][some] = np.add.reduceat(tx.mix(shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[some])
                    for k in range(LEAST):
                        sums[2 + k][some] = np.minimum.reduceat(tx.mix(shingle ^ np.uint64((k + 1) * 0x9E3779B97F4A7C1)), first[some])
                cell = hot.value[(shingle >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                ordered = shingle[_by_row(row, np.argsort(cell, kind="stable"))]
                prefix, tree, vector = [], [], []
                for r in range(chunk.rows):
                    lo, size = int(first[r]), int(n[r])
                    prefix.append(ordered[lo : lo + (size - (-(-percent * size // 100)) + 1 if size else 0)].astype(np.int64))
                    groups = vector_size(size)
                    counts = np.bincount((shingle[lo : lo + size] & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
                    vector.append(counts.astype("<u2" if size < 1 << 16 else "<u4").tobytes())
                    tree.append(np.minimum(fold(counts, GROUPS), 255).astype(np.uint8).tobytes())
                signed = sums.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.rows),
                        pa.array(n.astype(np.int64)),
                        pa.array(signed[0]),
                        pa.array(signed[1]),
                        pa.array(list(signed[2:].T), pa.list_(pa.int64())),
                        pa.array(prefix, pa.list_(pa.int64())),
                        pa.array(tree, pa.binary()),
                        pa.array(vector, pa.binary()),
                    ],
                    names=["doc_id", "n", "h1", "h2", "least", "prefix", "tree", "vector"],
                )

    schema = "doc_id bigint, n bigint, h1 bigint, h2 bigint, least array<bigint>, prefix array<bigint>, tree binary, vector binary"
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text).transform(arrow_map, run, schema)


class CountTree:
    """A bulk-loaded R-tree over count vectors of one shingle's documents, joined with itself or another level by level."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, groups: np.ndarray, vectors: np.ndarray, places: np.ndarray | None = None, before: np.ndarray | None = None):
        order = np.lexsort((vectors.argmax(axis=1), sizes)) if len(ids) else np.empty(0, np.int64)
        self.ids, self.groups = ids[order], groups[order]
        if places is not None:
            self.places, self.before = places[order], before[order]
        wide = vectors[order].astype(np.int32)
        wide[wide == 255] = 1 << 24  # a full byte stands for any count
        #: level 0 are points; (largest coordinates, least size, largest size, the one component or -1)
        self.levels = [(wide, sizes[order], sizes[order], self.groups)]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high, group = self.levels[-1]
            at = np.arange(0, len(top), FANOUT)
            g0, g1 = np.minimum.reduceat(group, at), np.maximum.reduceat(group, at)
            self.levels.append(
                (np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.where(g0 == g1, g0, -1))
            )

    def join(self, other: CountTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (mine, of other) that may link; with itself each pair once."""
        level = max(len(self.levels), len(other.levels)) - 1
        at = min(level, len(self.levels) - 1), min(level, len(other.levels) - 1)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(self.levels[at[0]][0])), np.arange(len(other.levels[at[1]][0])), indexing="ij"))
        yield from self._down(other, at, a, b, percent)

    def pairs(self, other: CountTree, percent: int) -> Iterator[pa.RecordBatch]:
        """The pairs of ``join`` that are to be told at this shingle."""
        sizes = self.levels[0][1], other.levels[0][1]
        for x, y in self.join(other, percent):
            new = _told_here(self.places[x], other.places[y], self.before[x], other.before[y], sizes[0][x], sizes[1][y], percent)
            if new.any():
                p, q = self.ids[x[new]], other.ids[y[new]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    def _down(self, other: CountTree, at: tuple[int, int], a: np.ndarray, b: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo in range(0, len(a), PAIRS_AT_ONCE):
            x, y = a[lo : lo + PAIRS_AT_ONCE], b[lo : lo + PAIRS_AT_ONCE]
            if self is other:
                x, y = x[x <= y], y[x <= y]
            x, y = self._may(other, at, x, y, percent)
            if at == (0, 0):
                if self is other:
                    x, y = x[x != y], y[x != y]
                yield x, y
            else:
                yield from self._down(other, (max(at[0] - 1, 0), max(at[1] - 1, 0)), *self._children(other, at, x, y), percent)

    def _may(self, other: CountTree, at: tuple[int, int], x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        top1, low1, high1, group1 = self.levels[at[0]]
        top2, low2, high2, group2 = other.levels[at[1]]
        fits = (100 * high1[x] >= percent * low2[y]) & (100 * high2[y] >= percent * low1[x]) & ((group1[x] != group2[y]) | (group1[x] == -1))
        x, y = x[fits], y[fits]
        most = np.minimum(top1[x], top2[y]).sum(axis=1)
        near = (100 + percent) * most >= percent * (low1[x] + low2[y])
        return x[near], y[near]

    def _children(self, other: CountTree, at: tuple[int, int], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of(tree: CountTree, level: int, nodes: np.ndarray) -> np.ndarray:
            if level == 0:
                return nodes[:, None]
            kids = nodes[:, None] * FANOUT + np.arange(FANOUT)
            return np.where(kids < len(tree.levels[level - 1][0]), kids, -1)

        p, q = of(self, at[0], x), of(other, at[1], y)
        shape = (len(x), p.shape[1], q.shape[1])
        p, q = np.broadcast_to(p[:, :, None], shape).ravel(), np.broadcast_to(q[:, None, :], shape).ravel()
        real = (p >= 0) & (q >= 0)
        return p[real], q[real]


def _told_here(
    place1: np.ndarray, place2: np.ndarray, before1: np.ndarray, before2: np.ndarray, size1: np.ndarray, size2: np.ndarray, percent: int
) -> np.ndarray:
    """Which pairs that meet at a shingle are told there.

    A pair with a shingle in common among the last few before this one has met there already. And if this is the first one that they share, they share
    nothing before it and at most what follows; where that is too little they do not link, or were told at an earlier one.
    """
    met = np.zeros(len(place1), bool)
    for i in range(BEFORE):
        for j in range(BEFORE):
            met |= (before1[:, i] == before2[:, j]) & (place1 > i) & (place2 > j)
    rest = np.minimum(size1 - place1, size2 - place2)
    return ~met & ((100 + percent) * rest >= percent * (size1 + size2))


def _before(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([tx.by_key(batch, f"before{k}") for k in range(BEFORE)], axis=1)


def _leaves(
    begin: np.ndarray, count: np.ndarray, ids: np.ndarray, sizes: np.ndarray, comps: np.ndarray, vectors: np.ndarray, places: np.ndarray, before: np.ndarray, percent: int
) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of groups that are one leaf each."""
    for n in range(2, FANOUT + 1):
        at = begin[count == n]
        i, j = np.triu_indices(n, 1)
        step = max(1, PAIRS_AT_ONCE // len(i))
        for lo in range(0, len(at), step):
            x = (at[lo : lo + step, None] + i).ravel()
            y = (at[lo : lo + step, None] + j).ravel()
            fits = (comps[x] != comps[y]) & (100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y]))
            x, y = x[fits], y[fits]
            new = _told_here(places[x], places[y], before[x], before[y], sizes[x], sizes[y], percent)
            x, y = x[new], y[new]
            least = np.minimum(vectors[x], vectors[y])
            most = least.sum(axis=1, dtype=np.int64) + ((least == 255).any(axis=1).astype(np.int64) << 40)
            near = (100 + percent) * most >= percent * (sizes[x] + sizes[y])
            p, q = ids[x[near]], ids[y[near]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])


def _tree_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: candidate pairs of ``token, doc_id, comp, n, tree, place, before0, ...``, from a stream ordered by token and size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held, parts, n_held = None, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            """Join the block at hand with itself and with earlier blocks of the token that are near in size."""
            nonlocal held, parts, n_held
            if not parts:
                return
            tree = CountTree(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            sizes = tree.levels[0][1]
            parts, n_held = [], 0
            if len(sizes) < 2 and not held:
                held = [tree]
                return
            held = [t for t in held if 100 * t.levels[0][2].max() >= percent * sizes.min()]
            for other in [tree, *held]:
                yield from tree.pairs(other, percent)
            held.append(tree)

        for batch in batches:
            tokens, ids, comps, sizes, places = (tx.by_key(batch, c) for c in ("token", "doc_id", "comp", "n", "place"))
            before = _before(batch)
            raw = batch.column("tree")
            vectors = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, GROUPS)
            begin = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            end = np.r_[begin[1:], len(tokens)]
            # Groups of one node that lie within the batch are joined together.
            single = (end - begin <= FANOUT) & (begin > 0) & (end < len(tokens))
            yield from _leaves(begin[single], (end - begin)[single], ids, sizes, comps, vectors, places, before, percent)
            for lo, hi in zip(begin[~single], end[~single], strict=True):
                if tokens[lo] != token:
                    yield from close()
                    token, held = tokens[lo], []
                for at in range(lo, hi, BLOCK):
                    end = min(hi, at + BLOCK)
                    parts.append(tuple(x[at:end] for x in (ids, sizes, comps, vectors, places, before)))
                    n_held += end - at
                    if n_held >= BLOCK:
                        yield from close()
        yield from close()

    ordered = rows.repartition("token").sortWithinPartitions("token", "n", "doc_id")
    return ordered.transform(arrow_map, run, "a bigint, b bigint").distinct()


def _split(rows: DataFrame, percent: int) -> DataFrame:
    """``token, i, j, side`` and the columns of ``token, doc_id, comp, n, tree, place, before0, ...``: for hot tokens each two blocks (i <= j) that are near in size, as one group.

    A block is a band of sizes, or a part by hash of a band with too many documents of one size. Sizes are ranked by their counts, not by rows.
    """
    sizes = rows.groupBy("token", "n").agg(F.count(F.lit(1)).alias("docs"))
    upto = F.sum("docs").over(Window.partitionBy("token").orderBy("n"))  # a row per size of a hot token
    banded = written(sizes.withColumn("band", F.floor((upto - F.col("docs")) / SPLIT)), "sizes")
    bands = banded.groupBy("token", "band").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.ceil(F.sum("docs") / SPLIT).alias("parts"))
    bands = written(bands, "bands")
    blocks = bands.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    block = F.struct("band", "part")
    i, j = (blocks.select("token", block.alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ij")
    met = i.join(j, "token").filter((F.col("i") <= F.col("j")) & (100 * F.col("high_i") >= percent * F.col("low_j"))).select("token", "i", "j")
    both = F.array(F.struct(F.col("i").alias("own"), F.lit(0).alias("side")), F.struct(F.col("j").alias("own"), F.lit(1).alias("side")))
    sides = met.select("token", "i", "j", F.explode(F.when(F.col("i") < F.col("j"), both).otherwise(F.slice(both, 1, 1))).alias("s"))
    sides = written(sides.select("token", "i", "j", "s.*"), "sides")
    placed = rows.join(banded.select("token", "n", "band"), ["token", "n"]).join(bands.select("token", "band", "parts"), ["token", "band"])
    placed = placed.withColumn("own", F.struct("band", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part")))
    return placed.join(sides, ["token", "own"]).select("token", "i", "j", "side", "doc_id", "comp", "n", "tree", "place", *[f"before{k}" for k in range(BEFORE)])


def _block_pairs(split: DataFrame, percent: int) -> DataFrame:
    """``a, b``: candidate pairs of the result of ``_split``; a task holds two blocks at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            trees = [CountTree(*(np.concatenate(x) for x in zip(*p, strict=True))) for p in parts if p]
            for p in parts:
                p.clear()
            if trees:
                yield from trees[0].pairs(trees[-1], percent)

        for batch in batches:
            keys = np.stack([tx.by_key(batch, c) for c in ("token", "i_band", "i_part", "j_band", "j_part", "side")], axis=1)
            ids, comps, sizes, places = (tx.by_key(batch, c) for c in ("doc_id", "comp", "n", "place"))
            before = _before(batch)
            vectors = np.frombuffer(b"".join(batch.column("tree").to_pylist()), np.uint8).reshape(-1, GROUPS)
            begin = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.empty(0, np.int64)
            for lo, hi in zip(begin, np.r_[begin[1:], len(keys)], strict=True):
                own = tuple(keys[lo, :-1].tolist())
                if own != group:
                    yield from close()
                    group = own
                parts[keys[lo, -1]].append(tuple(x[lo:hi] for x in (ids, sizes, comps, vectors, places, before)))
        yield from close()

    names = ["token", "i_band", "i_part", "j_band", "j_part"]
    flat = split.select("token", *[F.col(f"{x}.{y}").alias(f"{x}_{y}") for x in "ij" for y in ("band", "part")], F.col("side").cast("bigint"), "doc_id", "comp", "n", "tree", "place", *[f"before{k}" for k in range(BEFORE)])
    return flat.repartition(*names).sortWithinPartitions(*names, "side").transform(arrow_map, run, "a bigint, b bigint").distinct()


def bounded(pairs: DataFrame, feats: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their sizes and whole vectors."""
    f = feats.select("doc_id", "n", "vector")
    sides = pairs.join(f.select(F.col("doc_id").alias("a"), F.col("n").alias("n1"), F.col("vector").alias("v1")), "a").join(
        f.select(F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("vector").alias("v2")), "b"
    )

    def vector(raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, "<u2" if n < 1 << 16 else "<u4").astype(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            n1, n2 = batch.column("n1").to_pylist(), batch.column("n2").to_pylist()
            for i, (x, y) in enumerate(zip(n1, n2, strict=True)):
                if 100 * min(x, y) >= percent * max(x, y):
                    p, q = vector(batch.column("v1")[i].as_py(), x), vector(batch.column("v2")[i].as_py(), y)
                    size = min(len(p), len(q))
                    keep.append((100 + percent) * int(np.minimum(fold(p, size), fold(q, size)).sum()) >= percent * (x + y))
                else:
                    keep.append(False)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sides.select("a", "b", "n1", "n2", "v1", "v2").transform(arrow_map, run, "a bigint, b bigint")


def verify(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link by their sets."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    texts = wanted_texts(docs, sides.select("doc_id"), key, text).dropDuplicates(["doc_id"])
    met = sides.join(texts, "doc_id").repartition("a", "b").sortWithinPartitions("a", "b", "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None, None, None)
        for batch in batches:
            a, b, doc = (batch.column(c).to_pylist() for c in ("a", "b", "doc_id"))
            links = []
            for chunk in tx.chunks(batch.column("text")):
                row, shingle = _sets(chunk, words)
                cut = np.searchsorted(row, np.arange(chunk.rows + 1))
                for r in range(chunk.rows):
                    own = a[chunk.first + r], b[chunk.first + r]
                    here = shingle[cut[r] : cut[r + 1]]
                    if last[:2] != own:
                        last = (*own, doc[chunk.first + r], here)
                    elif last[2] != doc[chunk.first + r]:  # a pair may come twice, but a document is never its own other side
                        both = len(np.intersect1d(last[3], here, assume_unique=True))
                        if 100 * both >= percent * (len(last[3]) + len(here) - both) and both:
                            links.append(own)
                        last = (None, None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return met.select("a", "b", "doc_id", "text").transform(arrow_map, run, "a bigint, b bigint")


def _once(feats: DataFrame) -> DataFrame:
    """Features of each identifier once; only those of repeated rows are shuffled."""
    twice = written(feats.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    return feats.join(twice, "doc_id", "left_anti").unionByName(feats.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def self_join(docs: DataFrame, words: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id``: sizes, linked components, and classes of equal sets by their least identifiers."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_cells(docs, text, words))
    feats = written(features(docs, key, text, words, percent, hot), "features")
    same = feats.filter("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    same = written(same, "classes")
    once = _once(feats)
    reps = once.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    # First pass: each against the first with the same least hash.
    least = reps.select("doc_id", F.posexplode("least").alias("k", "token"))
    leaders = least.groupBy("k", "token").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("other")).filter("leader < other")
    tried = least.join(leaders, ["k", "token"]).filter("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = written(verify(written(bounded(tried, once, percent), "tried"), docs, key, text, words, percent), "stars")
    roots = components(stars)

    # Second pass: what prefixes of different components share.
    labelled = reps.join(roots.withColumnRenamed("u", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id"))
    tokens = written(labelled.select("doc_id", "comp", F.posexplode("prefix").alias("place", "token")), "prefixes")
    mixed = tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("docs")).filter("lo < hi")
    mixed = written(mixed.select("token", (F.col("docs") > SPLIT).alias("hot")), "mixed")
    vectors = once.select("doc_id", "n", "tree", "prefix")
    before = [F.coalesce(F.get("prefix", F.col("place") - k - 1), F.lit(0).cast("bigint")).alias(f"before{k}") for k in range(BEFORE)]
    columns = ["token", "doc_id", "comp", "n", "tree", F.col("place").cast("bigint").alias("place"), *before]
    near = _tree_pairs(tokens.join(mixed.filter("not hot"), "token").join(vectors, "doc_id").select(*columns), percent)
    hot_tokens = mixed.filter("hot").select("token")
    if not hot_tokens.isEmpty():
        placed = tokens.join(hot_tokens, "token").join(vectors, "doc_id").select(*columns)
        near = near.unionByName(_block_pairs(_split(placed, percent), percent)).distinct()
    pairs = bounded(near, once, percent)
    more = verify(written(pairs, "pairs"), docs, key, text, words, percent)
    links = written(stars.unionByName(more), "links")
    roots = components(links).withColumnRenamed("u", "rep")

    classes = same.join(roots, "rep", "left").select("n", "h1", "h2", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("component_id"))
    own = feats.select("doc_id", "n", "h1", "h2")
    return own.join(classes, ["n", "h1", "h2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
    )


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that are the first of their component; of rows that repeat as a whole one stays."""
    found = written(self_join(docs, words, percent, key, text), "components")
    gone = found.filter("component_id <> doc_id").select("doc_id")
    twice = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    some, others = split(docs, gone.unionByName(twice), key)
    kept = some.join(gone.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)
    # Null identifiers can pass the sieve as well; they are not one group.
    first = kept.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.filter(F.col(key).isNull()))
    return first.unionByName(others)
