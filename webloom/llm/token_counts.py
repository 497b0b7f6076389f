"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The pieces are those of a public byte-level vocabulary; a piece's score is that of a Zipf law over its rank,
``-log(rank + SHIFT)`` in millionths, as an integer, so that results are exact everywhere. A text's pre-tokens are looked up among the terminals of a
trie. A new one is inserted: nodes on the way that exist already hold the best score and the least number of
pieces of their prefix, and only new nodes are computed, from at most ``longest piece`` ancestors. The trie of a Python
worker is bounded; when it is full it starts anew, which changes no result.

Contract: null is the empty text, with no tokens and score 0; of equally good segmentations that with fewer pieces counts;
repeated rows give equal results; an empty table gives no rows; only the named columns are read. A vocabulary without all
single bytes raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .tasks import arrow_map
from .bpe import MAX_FILE_BYTES, PATTERN

SHIFT = 10
MAX_NODES = 1_000_000
MAX_TERMINALS = 500_000
MAX_DEPTH = 96  #: of the trie; longer pre-tokens are computed with a window of this kind instead


def zipf_scores(raw: bytes) -> dict[bytes, int]:
    """Piece scores of a rank file (base64 piece and rank per line)."""
    scores = {}
    for line in raw.splitlines():
        if line.strip():
            piece, rank = line.split()
            scores[base64.b64decode(piece)] = -round(1e6 * math.log(int(rank) + SHIFT))
    if any(bytes([b]) not in scores for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return scores


SCALE = 1 << 32  #: a value is ``score * SCALE - pieces``: more is better, and values add up


def unpacked(value: int) -> tuple[int, int]:
    """(score, number of pieces) of a value."""
    pieces = -value % SCALE
    return (value + pieces) // SCALE, pieces


class PrefixTrie:
    """Prefixes of pre-tokens with the value of the best segmentation of each."""

    def __init__(self, scores: dict[bytes, int], max_nodes: int = MAX_NODES):
        self.max_nodes = max_nodes
        #: The value of every piece, and None for what is only the end of one: where that stops, no longer piece can end.
        self.ends: dict[bytes, int | None] = {piece[i:]: None for piece in scores for i in range(1, len(piece))}
        self.ends |= {piece: score * SCALE - 1 for piece, score in scores.items()}
        self.longest = max(map(len, scores))
        self.computed = 0
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best = [0]  # value of each node's prefix

    def count(self, piece: bytes) -> int:
        """Value of a pre-token."""
        if len(piece) > MAX_DEPTH:
            return self._long(piece)
        if len(self.best) > self.max_nodes:
            self.clear()
        node, values, children, best = 0, [0], self.children, self.best
        for depth, byte in enumerate(piece, 1):
            edge = node << 8 | byte
            node = children.get(edge, 0)
            if node:
                values.append(best[node])
            else:
                node = children[edge] = len(best)
                values.append(self._step(piece, depth, values))
                best.append(values[-1])
        return values[-1]

    def _step(self, piece: bytes, end: int, before: list[int]) -> int:
        """Best of all pieces that end here; ``before`` are the prefixes up to here, the nearest last."""
        self.computed += 1
        get, best = self.ends.get, None
        for size in range(1, len(before) + 1):
            own = get(piece[end - size : end], 0)
            if own is None:
                continue
            if own == 0:
                break
            value = before[-size] + own
            if best is None or value > best:
                best = value
        return best

    def _long(self, piece: bytes) -> int:
        before = [0]
        for end in range(1, len(piece) + 1):
            before.append(self._step(piece, end, before))
            if len(before) > self.longest:
                del before[0]
        return before[-1]


class _Terminals(dict):
    def __init__(self, trie: PrefixTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, piece: str) -> int:
        found = self.trie.count(piece.encode())
        if len(piece) <= MAX_DEPTH:
            if len(self) >= MAX_TERMINALS:
                self.clear()
            self[piece] = found
        return found


_tries: dict[bytes, _Terminals] = {}


def _shipped(spark: SparkSession, path: str) -> Callable[[], _Terminals]:
    raw = Path(path).read_bytes()
    if len(raw) > MAX_FILE_BYTES:
        raise ValueError(f"the vocabulary file is larger than {MAX_FILE_BYTES} bytes")
    name, sent = hashlib.sha256(raw).digest(), spark.sparkContext.broadcast(raw)

    def get() -> _Terminals:
        if name not in _tries:
            _tries.clear()
            _tries[name] = _Terminals(PrefixTrie(zipf_scores(sent.value)))
        return _tries[name]

    return get


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pre_tokens, n_tokens, score``: the best segmentation's size and its score in millionths."""
    get = _shipped(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminals, find = get(), regex.compile(PATTERN).findall
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                pieces = find(cell.as_py() or "")
                score, n = unpacked(sum(map(terminals.__getitem__, pieces)))
                rows.append((len(pieces), n, score))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_pre_tokens", "n_tokens", "score"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).transform(arrow_map, run, f"doc_id {kind}, n_pre_tokens bigint, n_tokens bigint, score bigint")
