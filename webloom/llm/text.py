"""Text of Arrow batches as bytes: contiguous chunks of whole rows, words, and polynomial hashes, all in numpy.

A chunk holds whole texts up to ``CHUNK_BYTES``; one longer text is a chunk of its own, so memory is bounded by that
constant and the longest text, not by a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 17
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
LONG = 256  #: bytes from which a span is hashed by xxh3: modulo 2**64 any base has collisions that can be written down from some 1,000 bytes on

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
NOT_SPACE = ~SPACES
#: Digits, lower-case letters and every byte of a character outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((BASE, INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            grown = np.cumprod(factors)
            if size > 4 * CHUNK_BYTES:  # a rare huge text: do not keep its table
                if i == 0:
                    large = grown
                    continue
                return large, grown
            _powers[i] = grown
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Chunk:
    first: int  #: row of the batch
    data: np.ndarray  #: bytes of all its texts
    offsets: np.ndarray  #: len(rows) + 1 places in data

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts of a string column in order; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(len(column), max(row + 1, end))
        yield Chunk(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


@dataclass
class Words:
    start: np.ndarray  #: of each word, in the chunk's bytes
    end: np.ndarray
    first: np.ndarray  #: index of each row's first word, and the number of words

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes of a class, never across rows."""
    n = len(data)
    if not n:
        return Words(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64))
    word = inside[data]
    edge = np.zeros(n + 1, bool)  # a row begins or ends here
    edge[offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of ``(byte + 1) * BASE**place`` before each place."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of byte spans, the same wherever the bytes stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def span_keys(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Well-mixed hashes of byte spans: polynomial ones of short spans, xxh3 of long ones."""
    size = end - start
    out = mix(span_hash(prefix, start, end) + size.astype(np.uint64))
    long = np.flatnonzero(size >= LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return span_keys(data, prefix_hash(data), words.start, words.end)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive items; result i covers items i to i + size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(BASE)
        out += hashes[k : k + n]
    return mix(out)


def by_key(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A bigint column that cannot be null as numpy."""
    return batch.column(name).to_numpy(zero_copy_only=False)
