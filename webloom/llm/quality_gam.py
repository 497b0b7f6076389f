"""Quality classifier: an additive model with pairwise interactions over measures of the text.

Each term is a lookup table over the bins of one measure, or of two. Training boosts the tables in turn: a step fits a
tree of a few leaves to the gradient histogram of one measure and adds a small part of it to its table, round after round;
then the pairs that still explain most are boosted the same way with trees that cut both measures once. A text's
score is the sum of the table cells of its bins, in numpy for whole batches.

Only measures of the text are inputs. Texts are measured once, in one pass over all rows; training takes at most ``MAX_TRAIN`` labelled
rows (a hash sample of identifiers, a documented bound), whose measures alone come to the driver.

Contract: null is the empty text and scores like one; a null identifier is not held out and not learned from; labels that are null or
for unknown documents are left out; repeated rows score alike; without labels of both kinds every score is the share of
label 1 (one half if there are none); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .tasks import arrow_map
from . import text as tx

MAX_TRAIN = 20_000
BINS = 32
ROUNDS = 200
PAIRS = 6
PAIR_ROUNDS = 60
RATE = 0.1
LEAVES = 3
RIDGE = 1.0


def _class(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[np.frombuffer(characters, np.uint8)] = True
    return found


NOT_NEWLINE = ~_class(b"\n")
COUNTED = {
    "symbols": _class(b"#*$%&|<>@^~_=+\\/{}[]"),
    "bars": _class(b"|"),
    "upper": _class(bytes(range(65, 91))),
    "digits": _class(bytes(range(48, 58))),
    "shouts": _class(b"!?"),
    "stops": _class(b".,;:"),
    "wide": _class(bytes(range(0xC0, 0x100))),
}
MEASURES = (
    *COUNTED, "words", "word_length", "long_words", "short_words", "distinct_words", "repeats", "top_word", "lines", "dup_lines", "line_words", "capitals"
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def measure_chunk(chunk: tx.Chunk) -> np.ndarray:
    """Rows by measures."""
    data, offsets, rows = chunk.data, chunk.offsets, chunk.rows
    words = tx.find_words(data, offsets, tx.NOT_SPACE)
    prefix = tx.prefix_hash(data)
    row, n = words.rows(), np.diff(words.first)
    size = np.diff(offsets)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def by_row(of: np.ndarray) -> np.ndarray:
        return np.bincount(of, minlength=rows)

    own = tx.mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    length = words.end - words.start
    hashes = tx.span_keys(data, prefix, words.start, words.end)
    _, once, count = np.unique(hashes ^ own[row], return_index=True, return_counts=True)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, row[once], count)
    grams = tx.shingle_hashes(hashes, 3)
    whole = np.flatnonzero(row[: len(grams)] == row[2:]) if len(grams) else np.empty(0, np.int64)
    _, gram_once = np.unique(grams[whole] ^ own[row[whole]], return_index=True)
    lines = tx.find_words(data, offsets, NOT_NEWLINE)
    line_row = lines.rows()
    _, line_once = np.unique(tx.span_keys(data, prefix, lines.start, lines.end) ^ own[line_row], return_index=True)
    n_lines, n_grams = by_row(line_row), by_row(row[whole])
    out = {name: _share(total(mask[data]), size) for name, mask in COUNTED.items()}
    out |= {
        "words": np.log2(n + 1.0),
        "word_length": _share(np.bincount(row, length, minlength=rows), n),
        "long_words": _share(by_row(row[length > 12]), n),
        "short_words": _share(by_row(row[length < 4]), n),
        "distinct_words": _share(by_row(row[once]), n),
        "repeats": 1 - _share(by_row(row[whole][gram_once]), n_grams),
        "top_word": _share(top, n),
        "lines": _share(n_lines, n),
        "dup_lines": 1 - _share(by_row(line_row[line_once]), n_lines),
        "line_words": np.log2(_share(n, n_lines) + 1),
        "capitals": _share(by_row(row[COUNTED["upper"][data[words.start]]]), n) if len(words.start) else np.zeros(rows),
    }
    return np.column_stack([out[m] for m in MEASURES])


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, x``: the measures of each text, in the order of ``MEASURES``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(1)):
                x = measure_chunk(chunk).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), lists], names=["doc_id", "x"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text).transform(arrow_map, run, f"doc_id {kind}, x array<float>")


@dataclass
class AdditiveModel:
    """Lookup tables over binned measures; ``score`` adds one cell per term."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]

    def logits(self, bins: list[np.ndarray], rows: int) -> np.ndarray:
        out = np.full(rows, self.start)
        for table, b in zip(self.tables, bins, strict=True):
            out += table[b]
        for (i, j), table in self.pairs.items():
            out += table[bins[i], bins[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(self.bins(x), len(x)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A step function over bins with at most LEAVES leaves, grown by the best cut."""
    cuts = [0, len(g)]
    sums = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]

    def worth(lo: np.ndarray | int, hi: np.ndarray | int) -> np.ndarray:
        return (sums[0][hi] - sums[0][lo]) ** 2 / (sums[1][hi] - sums[1][lo] + RIDGE)

    for _ in range(LEAVES - 1):
        best = (1e-9, None)
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                at = np.arange(lo + 1, hi)
                gain = worth(lo, at) + worth(at, hi) - worth(lo, hi)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = (sums[0][hi] - sums[0][lo]) / (sums[1][hi] - sums[1][lo] + RIDGE)
    return out


def _cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best tree that cuts each of two measures once."""

    def corners(x: np.ndarray) -> list[np.ndarray]:
        c = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
        c[1:, 1:] = x.cumsum(0).cumsum(1)
        low, rows, columns, all_ = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [low, rows - low, columns - low, all_ - rows - columns + low]

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = corners(g), corners(h)
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(gs, hs, strict=True)]
    table = np.empty(g.shape)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), table


def train(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of single measures, then of the pairs with the largest gain."""
    n = len(y)
    share = float(y.mean()) if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return AdditiveModel(float(np.log(share / (1 - share))))
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model = AdditiveModel(float(np.log(share / (1 - share))))
    for column in x.T:
        e = np.unique(np.quantile(column, quantiles))
        middle = np.unique(column)
        # Cut between the values, so that a value right at a quantile has room to both sides.
        at = np.searchsorted(middle, e)
        model.edges.append(np.unique(np.r_[e, (middle[at] + middle[np.minimum(at + 1, len(middle) - 1)]) / 2]))
    bins = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    z = np.full(n, model.start)
    for _ in range(ROUNDS):
        for i, b in enumerate(bins):
            p = sigmoid(z)
            step = RATE * _line_tree(np.bincount(b, y - p, sizes[i]), np.bincount(b, p * (1 - p), sizes[i]))
            model.tables[i] += step
            z += step[b]

    def histograms(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell, shape = sigmoid(z), bins[i] * sizes[j] + bins[j], (sizes[i], sizes[j])
        both = sizes[i] * sizes[j]
        return np.bincount(cell, y - p, both).reshape(shape), np.bincount(cell, p * (1 - p), both).reshape(shape)

    ranked = sorted(combinations(range(len(bins)), 2), key=lambda ij: -_cross_tree(*histograms(*ij))[0])
    model.pairs = {ij: np.zeros((sizes[ij[0]], sizes[ij[1]])) for ij in ranked[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            step = RATE * _cross_tree(*histograms(i, j))[1]
            table += step
            z += step[bins[i], bins[j]]
    return model


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", bound: int = MAX_TRAIN) -> AdditiveModel:
    """Train on the labelled rows that are not held out, at most about ``bound`` of them by a hash of their identifiers."""
    usable = labels.select("doc_id", F.col(label).alias("y")).filter("y in (0, 1) and doc_id is not null").filter(~held_out())
    n = usable.count()
    if n > bound:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    rows = measured.join(usable.dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "x", "y").dropDuplicates(["doc_id"]).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy())  # sums of floats in one order, whatever the partitions
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(MEASURES))[order]
    return train(x, rows.column("y").to_numpy().astype(float)[order])


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    measured = written(measure(docs, key, text), "measures")
    model = docs.sparkSession.sparkContext.broadcast(fit(measured, labels, label))  # tables of a fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(MEASURES))
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    kind = measured.schema["doc_id"].dataType.simpleString()
    return measured.select("doc_id", held_out().alias("held_out"), "x").transform(arrow_map, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score at least ``least``. They are measured again instead of shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(measure(docs, key, text), labels, label))
    place = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(place)):
                kept = model.value.score(measure_chunk(chunk).astype(np.float32).astype(np.float64)) >= least
                yield batch.slice(chunk.first, chunk.rows).filter(pa.array(kept))

    return docs.transform(arrow_map, run, docs.schema)
