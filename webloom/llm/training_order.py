"""Training-order materialisation of token sequences.

1. Texts are encoded once with a rank file; each task writes its rows with the place of their first token among the task's tokens. The
   number of tokens per task is all that comes to the driver; with it every token has a global place.
2. The stream of all tokens (an end token after each text) is cut into sequences of ``length`` tokens, the last one filled up.
3. A keyed Feistel network over the next even number of bits, walked until it falls below the number of sequences, is a
   permutation; it gives every sequence its slot in training order. It needs no shuffle and no table.
4. Slots are dealt out by ranges: shard ``slot div per_shard``. Every record has the same size, so a
   reader finds slot ``s`` at ``(s mod per_shard) * stride`` of its shard and can stop and go on anywhere.

Contract: null and empty texts give an end token alone; the name of the end token in a text is ordinary text; repeated rows are texts of their own; an empty table gives no
records; other columns are not read. The order depends on the key, the length and the split of the input files into tasks; once the tokens are written it is
fixed, lost executors included. Token identifiers must fit 16 bits (``ValueError`` otherwise).
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .tasks import arrow_map
from .bpe import MAX_FILE_BYTES, PATTERN

LENGTH = 2048
PER_SHARD = 4096
ROUNDS = 6
KEY = 0x5DEECE66D
WIDTH = 2  #: bytes of a token


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def slots(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The keyed permutation of 0 to n - 1, for some places: a balanced Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index).astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for r in range(rounds):
            left, right = right, left ^ (_scramble(right, key * 2 + r * 0x632BE59BD9B4E019) & mask)
        out[walking] = left << shift | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


_encodings: dict[bytes, tiktoken.Encoding] = {}


def _shipped(spark: SparkSession, path: str) -> Callable[[], tiktoken.Encoding]:
    raw = Path(path).read_bytes()
    if len(raw) > MAX_FILE_BYTES:
        raise ValueError(f"the vocabulary file is larger than {MAX_FILE_BYTES} bytes")
    name, sent = hashlib.sha256(raw).digest(), spark.sparkContext.broadcast(raw)

    def get() -> tiktoken.Encoding:
        if name not in _encodings:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, sent.value.splitlines())}
            if max(ranks.values()) >= 1 << 16:
                raise ValueError("token identifiers must fit 16 bits")
            _encodings.clear()
            _encodings[name] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _encodings[name]

    return get


def packed_texts(docs: DataFrame, path: str, end: int, text: str) -> DataFrame:
    """``task, start, ids``: packed tokens of each text, with its place among its task's tokens."""
    get = _shipped(docs.sparkSession, path)
    if not 0 <= end < 1 << 16:
        raise ValueError("token identifiers must fit 16 bits")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = get().encode_ordinary, array("H", [end]).tobytes()
        task, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, starts = [], []
                for cell in batch.column(0).slice(at, 512):
                    ids.append(array("H", encode(cell.as_py() or "")).tobytes() + stop)
                    starts.append(start)
                    start += len(ids[-1]) // WIDTH
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), task, np.int32)), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["task", "start", "ids"]
                )

    return docs.select(text).transform(arrow_map, run, "task int, start bigint, ids binary")


def materialise(
    docs: DataFrame, path: str, end: int, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, text: str = "text"
) -> DataFrame:
    """``slot, shard, byte_offset, sequence, record``: every sequence once, each shard's records together and in order of slots."""
    spark = docs.sparkSession
    where = scratch_path(spark, "tokens")
    packed_texts(docs, path, end, text).write.option("compression", "zstd").parquet(where)
    tokens = spark.read.schema("task int, start bigint, ids binary").parquet(where)
    sizes = dict(tokens.groupBy("task").agg(F.sum(F.octet_length("ids")) / WIDTH).collect())  # one number per task
    begin, total = {}, 0
    for task in sorted(sizes):
        begin[task], total = total, total + int(sizes[task])
    n = -(-total // length)
    offsets = spark.sparkContext.broadcast(begin)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sequence, inside, pieces = [], [], []
                for task, start, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    first = offsets.value[task] + start
                    done, size = 0, len(ids) // WIDTH
                    while done < size:
                        s, p = divmod(first + done, length)
                        take = min(size - done, length - p)
                        sequence.append(s)
                        inside.append(p)
                        pieces.append(ids[done * WIDTH : (done + take) * WIDTH])
                        done += take
                order = np.array(sequence, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots(order, n, key)), pa.array(inside, pa.int32()), pa.array(order), pa.array(pieces, pa.binary())],
                    names=["slot", "inside", "sequence", "piece"],
                )

    fill = np.full(length, end, "<u2").tobytes()

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records(rows: list[tuple]) -> pa.RecordBatch:
            slot, sequence, record = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
            at = np.array(slot, np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(at),
                    pa.array(at // per_shard),
                    pa.array(at % per_shard * length * WIDTH),
                    pa.array(sequence, pa.int64()),
                    pa.array(record, pa.binary()),
                ],
                names=["slot", "shard", "byte_offset", "sequence", "record"],
            )

        own, held, done = None, [], []
        for batch in batches:
            for slot, sequence, piece in zip(*(batch.column(c).to_pylist() for c in ("slot", "sequence", "piece")), strict=True):
                if own is not None and own[0] != slot:
                    done.append((*own, (b"".join(held) + fill)[: length * WIDTH]))
                    held = []
                    if len(done) >= 256:
                        yield records(done)
                        done = []
                own = (slot, sequence)
                held.append(piece)
        if own is not None:
            done.append((*own, (b"".join(held) + fill)[: length * WIDTH]))
        yield records(done)

    shards = max(1, -(-n // per_shard))
    tasks = max(shards, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n)) if shards < 1 << 16 else 1 << 16
    # Ranges of slots, equal by construction: nothing has to be sampled to find their borders.
    ranged = (F.col("slot") * tasks / max(n, 1)).cast("int")
    dealt = tokens.transform(arrow_map, cut, "slot bigint, inside int, sequence bigint, piece binary").repartitionById(tasks, ranged)
    return dealt.sortWithinPartitions("slot", "inside").transform(arrow_map, join, "slot bigint, shard bigint, byte_offset bigint, sequence bigint, record binary")


def write_shards(records: DataFrame, folder: str) -> None:
    """Write ``shard-<number>.bin`` files of fixed stride into a folder that all executors mount.

    Records are written at their places in a shard's file, so repeated or resumed tasks write the same bytes again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        n = 0
        for batch in batches:
            for shard, offset, record in zip(*(batch.column(c).to_pylist() for c in ("shard", "byte_offset", "record")), strict=True):
                handle = os.open(os.path.join(folder, f"shard-{shard:06d}.bin"), os.O_CREAT | os.O_WRONLY, 0o644)
                try:
                    os.pwrite(handle, record, offset)
                finally:
                    os.close(handle)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    records.select("shard", "byte_offset", "record").transform(arrow_map, run, "n bigint").agg(F.sum("n")).collect()


@dataclass
class ShardReader:
    """Reads sequences by slot; a run that stopped after slot s goes on with s + 1."""

    folder: str
    length: int = LENGTH
    per_shard: int = PER_SHARD

    def read(self, slot: int, count: int = 1) -> Iterator[np.ndarray]:
        stride = self.length * WIDTH
        for s in range(slot, slot + count):
            with open(os.path.join(self.folder, f"shard-{s // self.per_shard:06d}.bin"), "rb") as f:
                f.seek(s % self.per_shard * stride)
                yield np.frombuffer(f.read(stride), "<u2")
