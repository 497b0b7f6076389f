"""Detection of periodic runs of words, with a difference cover for longest common extensions.

A *run* is a stretch of words with smallest period q, at least ``MIN_WORDS`` words and ``MIN_TIMES`` periods long, that no
neighbouring word extends with the same period. Texts are taken in chunks of whole rows; a chunk's words become numbers (a dictionary of the
words themselves, no hashes), with a number of its own behind each text, so no extension crosses texts.

*Grid.* For each q, the places 0, q, 2q, ... of a text are compared with those q words on: n log n pairs in all. A run holds at least two such
places. At its first one it reaches back less than q words, so the extension to the right from there is more than its least length less
2q; pairs that differ earlier are gone after few comparisons of words.

*Extensions.* ``Extensions`` answers how far two suffixes agree. Only suffixes at places whose remainder is in a difference cover are
sorted (6 of 31), by prefix doubling over blocks of 31 words. For any two places some step below 31 leads both to sampled places: that many words are compared
directly, the rest is the least common prefix between two ranks, from a sparse table. It is built for the texts with pairs left over only.

*Runs.* The start is found by bisection: "the extension from x reaches the grid place" holds from some x on. Of equal stretches with
several periods the least is kept; by the periodicity lemma the others are its multiples.

Contract: null is the empty text and has no words and no runs; a null identifier stays null; texts of any length are whole, memory is
linear in a chunk of ``tx.CHUNK_BYTES`` or the longest text; rows that repeat give repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tasks import arrow_map

MIN_WORDS = 24
MIN_TIMES = 3
#: A perfect difference set; every remainder modulo 31 but 0 is the difference of one pair.
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)
PAIRS = 1 << 20  #: of grid pairs at a time


def _steps() -> np.ndarray:
    """For two remainders, the least step that leads both into the cover."""
    inside = np.isin((np.arange(MODULUS)[:, None] + np.arange(MODULUS)) % MODULUS, COVER)  # place, step
    return np.argmax(inside[:, None, :] & inside[None, :, :], axis=2)


STEPS = _steps()


class Extensions:
    """Longest common extensions of suffixes of a sequence of numbers from 0 on; its last ``MODULUS`` numbers must occur once."""

    def __init__(self, words: np.ndarray):
        self.words = words
        n = len(words)
        sampled = np.sort(np.concatenate([np.arange(c, n, MODULUS) for c in COVER]))
        m = len(sampled)
        self.slot = np.full(n + MODULUS, m, np.int64)  # of each sampled place; m behind the end
        self.slot[sampled] = np.arange(m)
        # Ranks by blocks of words, then by twice as many blocks in each round. Behind the end is rank 0.
        block = words[np.minimum(sampled[:, None] + np.arange(MODULUS), n - 1)]
        self.levels = [self._rank(np.lexsort(block.T[::-1]), lambda a, b: (block[a] != block[b]).any(axis=1))]
        size = MODULUS
        while self.levels[-1].max(initial=0) < m:
            own, after = self.levels[-1], self._after(sampled, size)
            self.levels.append(self._rank(np.lexsort((own[after], own[:m])), lambda a, b, o=own, f=after: (o[a] != o[b]) | (o[f[a]] != o[f[b]])))
            size *= 2
        self.sampled = sampled
        self.rank = self.levels[-1]
        order = np.empty(m, np.int64)
        order[self.rank[:m] - 1] = np.arange(m)
        self.table = [self._neighbours(order)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))
        self.levels = []

    def _after(self, sampled: np.ndarray, size: int) -> np.ndarray:
        return self.slot[np.minimum(sampled + size, len(self.words))]

    @staticmethod
    def _rank(order: np.ndarray, differ) -> np.ndarray:
        rank = np.zeros(len(order) + 1, np.int64)
        if len(order):
            rank[order] = 1 + np.concatenate([[0], np.cumsum(differ(order[1:], order[:-1]))])
        return rank

    def _neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common prefix, in words, of each sampled suffix with the next in order: whole blocks by the ranks of all rounds, the rest by words."""
        a, b = self.sampled[order[:-1]], self.sampled[order[1:]]
        length = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            rank, size = self.levels[k], MODULUS << k
            i, j = (self.slot[np.minimum(x + length, len(self.words))] for x in (a, b))
            length += np.where((rank[i] == rank[j]) & (rank[i] > 0), size, 0)
        return length + self._direct(a + length, b + length, np.full(len(a), MODULUS))

    def _direct(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from two places on, at most a limit."""
        out = np.zeros(len(i), np.int64)
        left = np.flatnonzero(limit > 0)
        end = len(self.words) - 1
        while len(left):
            at = out[left]
            x, y = i[left] + at, j[left] + at
            same = (y <= end) & (x <= end) & (self.words[np.minimum(x, end)] == self.words[np.minimum(y, end)])
            left = left[same]
            out[left] += 1
            left = left[out[left] < limit[left]]
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extensions of pairs of different places."""
        step = STEPS[i % MODULUS, j % MODULUS]
        out = self._direct(i, j, step)
        on = np.flatnonzero(out == step)
        last = len(self.words)
        a, b = (self.rank[self.slot[np.minimum(x[on] + step[on], last)]] for x in (i, j))
        on, a, b = on[(a > 0) & (b > 0)], a[(a > 0) & (b > 0)], b[(a > 0) & (b > 0)]
        low, high = np.minimum(a, b) - 1, np.maximum(a, b) - 1  # the least of table[0][low:high]
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(power):
            these = power == k
            row = self.table[k]
            out[on[these]] += np.minimum(row[low[these]], row[high[these] - (1 << int(k))])
        return out


def _grid(sizes: np.ndarray, first: np.ndarray, min_times: int, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grids of all texts, in parts; places 0, q, 2q, ... with a word q further on."""
    most = np.where(sizes >= min_words, sizes // min_times, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (sizes[text] - 1) // period
    upto = np.cumsum(count)
    at = 0
    while at < len(text):
        base = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
        n, q = count[at:end], period[at:end]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat(q, n)
        yield np.repeat(first[text[at:end]], n) + k * q, q
        at = end


def find_runs(words: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of some texts given as numbers, one after the other; by text, start and period."""
    n_words = len(words)
    sentinel = int(words.max(initial=0)) + 1
    ends = np.cumsum(sizes)
    # A number of its own behind each text, and a last block of such numbers.
    spaced = np.concatenate([np.insert(words, ends, np.arange(len(sizes)) + sentinel), np.arange(MODULUS) + sentinel + len(sizes)])
    first = ends - sizes + np.arange(len(sizes))
    place, period = [], []
    for i, q in _grid(sizes, first, min_times, min_words):
        need = np.maximum(np.maximum(min_words, min_times * q) - 2 * q + 1, 1)
        direct = np.arange(len(i))
        for t in range(int(max(need.min(initial=1), 1))):  # below every least extension
            direct = direct[spaced[i[direct] + t] == spaced[i[direct] + q[direct] + t]]
        place.append(i[direct])
        period.append(q[direct])
    none = np.empty(0, np.int64)
    i, q = (np.concatenate(x) if x else none for x in (place, period))
    if not n_words or not len(i):
        return none, none, none, none
    # Extensions for the texts with pairs left over, moved together.
    text = np.searchsorted(first, i, "right") - 1
    used = np.unique(text)
    parts = [spaced[first[t] : first[t] + sizes[t] + 1] for t in used.tolist()]
    moved = np.cumsum([0, *map(len, parts)])
    extensions = Extensions(np.concatenate([*parts, spaced[-MODULUS:]]))
    own = np.searchsorted(used, text)
    start_of = moved[:-1][own]
    i = i - first[text] + start_of
    reach = extensions.common(i, i + q)
    ahead = reach >= np.maximum(min_words, min_times * q) - 2 * q + 1
    before = np.flatnonzero(ahead & (i - q >= start_of))
    ahead[before] = extensions.common(i[before] - q[before], i[before]) < q[before]  # otherwise not the run's first grid place
    i, q, reach, own, start_of = (x[ahead] for x in (i, q, reach, own, start_of))
    low, high = np.maximum(i - q + 1, start_of), i.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        holds = extensions.common(middle, middle + q[open_]) >= i[open_] - middle
        high[open_[holds]] = middle[holds]
        low[open_[~holds]] = middle[~holds] + 1
    length = i + q + reach - low
    long = length >= np.maximum(min_words, min_times * q)
    own, start, length, q = own[long], (low - start_of)[long], length[long], q[long]
    order = np.lexsort((q, length, start, own))
    own, start, length, q = (x[order] for x in (own, start, length, q))
    least = np.ones(len(own), bool)
    least[1:] = (own[1:] != own[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    own, start, length, q = (x[least] for x in (own, start, length, q))
    order = np.lexsort((q, start, own))
    return used[own[order]], start[order], length[order], q[order]


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs by start and period, and the words joined by one space without what repeats.

    A word is left out if a run contains it behind the run's first period.
    """
    if min_times < 3 or min_words < 1:
        raise ValueError("runs of at least three periods are found")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(1)):
                raw = chunk.data.tobytes()
                own = [raw[a:b].split() for a, b in zip(chunk.offsets.tolist(), chunk.offsets[1:].tolist(), strict=False)]
                numbers: dict[bytes, int] = {}
                words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(own)), np.int64)
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                found = find_runs(words, sizes, min_words, min_times)
                runs: list[list[dict]] = [[] for _ in own]
                for t, start, length, period in zip(*(x.tolist() for x in found), strict=True):
                    runs[t].append({"start": start, "length": length, "period": period})
                collapsed = []
                for words_, these in zip(own, runs, strict=True):
                    if these:
                        drop = np.zeros(len(words_) + 1, np.int64)
                        for r in these:
                            drop[r["start"] + r["period"]] += 1
                            drop[r["start"] + r["length"]] -= 1
                        words_ = [words_[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(words_))
                kind_ = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                texts = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.rows), pa.array(sizes), pa.array(runs, kind_), texts], names=["doc_id", "n_words", "runs", "collapsed"]
                )

    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string")).transform(arrow_map, run, schema)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the run with most periods, and digests of all runs and of the collapsed text."""
    more = "case when best is null or r.length * best.period > best.length * r.period then r else best end"  # exact; the first of equals stays
    best = f"aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (best, r) -> {more})"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.withColumn("best", F.expr(best)).selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "best.start as start", "best.length as length", "best.period as period",
        "1000 * best.length div best.period as exponent_milli", f"sha2({lines}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256",
    )
