"""Packing of documents into fixed windows by online sums of squares.

Each task reads its documents once, in order. A document's tokens are cut into whole windows and a rest. Rests meet a *level
array*, the number of partially filled windows at each fill level: a rest goes to the level that makes the sum of the squared
counts least (a new window is level 0; a filled one counts nothing; of ties the fullest result, so a rest that fits exactly is taken at
once). Few windows then stay open, at levels that later rests complement. Cutting is free, so two things bound what stays open:

* beyond ``OPEN`` windows a rest is cut, its head fills the fullest window and what is left is placed anew;
* at the end of a task its open windows are poured into each other, from the emptiest into the fullest, and the one that stays is cut into
  powers of two, which need no padding. A task adds at most 12 such short sequences to its full ones.

So no sequence is padded. Windows are held with their tokens until they are full: a task's memory is ``OPEN`` windows and its longest
text. Nothing is shuffled, and no key decides where a row goes. A sequence's number is its task's, shifted, and its place in the task; a task that
is run again reads the same split and gives the same rows.

Contract: null is the empty text, which is its end token alone; a null identifier stays null; every row is packed, rows that repeat as well; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import arrow_map
from .word_bpe import shipped

WINDOW = 4096
OPEN = 512  #: partially filled windows of a task
WIDTH = 4  #: bytes of a token
ROWS, BYTES = 64, 1 << 20  #: of texts encoded together
OUT_BYTES = 4 << 20  #: of tokens in a batch of results
TASK_SHIFT = 33

Piece = tuple[object, int, int, bytes]  # identifier, tokens of its document, start there, packed tokens


class Packer:
    """Pieces in, whole sequences of pieces out."""

    def __init__(self, window: int = WINDOW, limit: int = OPEN):
        if window < 1 or limit < 1:
            raise ValueError("a window and at least one open window are needed")
        self.window, self.limit = window, limit
        self.counts = np.zeros(window + 1, np.int64)  # the level array
        self.levels: dict[int, list[list[Piece]]] = {}  # windows at each level
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The fill level that a rest is added to; 0 for a new window."""
        levels = np.flatnonzero(self.counts[: self.window - size + 1])
        fresh = 2 * int(self.counts[size]) + 1
        if not len(levels):
            return 0
        after = levels + size
        # (count - 1)**2 - count**2 where it leaves, (count + 1)**2 - count**2 where it arrives, nothing for a full window
        change = np.where(after < self.window, 2 * self.counts[after] + 1, 0) + 1 - 2 * self.counts[levels]
        best = len(levels) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= fresh else 0

    def _put(self, level: int, piece: Piece) -> list[Piece] | None:
        """Add a piece to a window of a level; the window if it is full now."""
        if level:
            self.counts[level] -= 1
            held = self.levels[level].pop()
        else:
            self.n_open += 1
            held = []
        held.append(piece)
        after = level + len(piece[3]) // WIDTH
        if after == self.window:
            self.n_open -= 1
            return held
        self.counts[after] += 1
        self.levels.setdefault(after, []).append(held)
        return None

    def add(self, key: object, tokens: bytes) -> Iterator[list[Piece]]:
        """Place a document; gives the windows it fills."""
        total, whole = len(tokens) // WIDTH, self.window * WIDTH
        rest = len(tokens) // whole * whole
        for at in range(0, rest, whole):
            yield [(key, total, at // WIDTH, tokens[at : at + whole])]
        while rest < len(tokens):
            size = (len(tokens) - rest) // WIDTH
            level = self.level_for(size)
            if not level and self.n_open >= self.limit:
                level = int(np.flatnonzero(self.counts)[-1])
                size = min(size, self.window - level)
            full = self._put(level, (key, total, rest // WIDTH, tokens[rest : rest + size * WIDTH]))
            if full:
                yield full
            rest += size * WIDTH

    def finish(self) -> Iterator[list[Piece]]:
        """The open windows, poured into each other; the last in powers of two."""
        left = [held for level in sorted(self.levels, reverse=True) for held in self.levels[level]]
        self.counts[:], self.levels, self.n_open = 0, {}, 0
        low, high = 0, len(left) - 1
        while low < high:
            room = self.window - sum(len(p[3]) for p in left[low]) // WIDTH
            head, left[high][-1:] = _cut(left[high][-1], room)
            left[low].append(head)
            if room == len(head[3]) // WIDTH:
                yield left[low]
                low += 1
            if not left[high]:
                high -= 1
        if low == high:
            pieces = left[low]
            size = sum(len(p[3]) for p in pieces) // WIDTH
            for power in reversed(range(size.bit_length())):
                room, part = size & 1 << power, []
                while room:
                    head, pieces[:1] = _cut(pieces[0], room)
                    part.append(head)
                    room -= len(head[3]) // WIDTH
                if part:
                    yield part


def _cut(piece: Piece, size: int) -> tuple[Piece, list[Piece]]:
    """At most ``size`` tokens from the start of a piece, and what is left of it."""
    key, total, start, tokens = piece
    head = tokens[: size * WIDTH]
    return (key, total, start, head), [(key, total, start + size, tokens[len(head) :])] if len(head) < len(tokens) else []


def pack(docs: DataFrame, vocabulary: str, end: int, window: int = WINDOW, limit: int = OPEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: every piece with its tokens, as little-endian unsigned 32-bit numbers."""
    get, stop = shipped(docs.sparkSession, vocabulary), np.array([end], "<u4").tobytes()
    kind = docs.schema[key].dataType
    Packer(window, limit)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, number = get(), Packer(window, limit), TaskContext.get().partitionId() << TASK_SHIFT
        rows, size = [], 0

        def batch_of() -> pa.RecordBatch:
            keys, totals, starts, ids, numbers, offsets = zip(*rows, strict=True)
            lengths = [len(x) // WIDTH for x in ids]
            columns = [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())]
            columns += [pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *columns], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def sequences() -> Iterator[list[Piece]]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.column(0).type
                for keys, texts in _groups(batch):
                    for k, tokens in zip(keys, encoder.encode(texts), strict=True):
                        yield from packer.add(k, tokens + stop)
            yield from packer.finish()

        key_type = pa.null()
        for pieces in sequences():
            offset = 0
            for k, total, start, tokens in pieces:
                rows.append((k, total, start, tokens, number, offset))
                offset += len(tokens) // WIDTH
                size += len(tokens)
            number += 1
            if size >= OUT_BYTES:
                yield batch_of()
                rows, size = [], 0
        if rows:
            yield batch_of()

    schema = f"doc_id {kind.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).transform(arrow_map, run, schema)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Identifiers and texts of a batch in groups of bounded size, or of one long text."""
    keys, texts, size = [], [], 0
    for k, cell in zip(batch.column(0), batch.column(1), strict=True):
        keys.append(k.as_py())
        texts.append(cell.as_py() or "")
        size += len(texts[-1])
        if len(texts) >= ROWS or size >= BYTES:
            yield keys, texts
            keys, texts, size = [], [], 0
    if texts:
        yield keys, texts
