"""BPE encoding and decoding as streaming transducers.

Encoding. Text is split into pre-tokens; inside one, bytes are pushed into a transducer that holds a bounded buffer.
From the merge list alone it computes the *sufficient lookahead*: how far unread text can still move a token border. If
two continuations of the same text part, the place up to which both have the same tokens moves to the left only when a
merge takes the last common token, and each such merge has a later rank than the one before and joins either that
token or what became of it. The longest chain of such merges, in bytes of left tokens, bounds the reach, so every token
that ends that far before the end of the buffer is final: it is emitted and forgotten. A border of the encoding splits
it into two independent encodings, so the rest starts afresh. Memory is the lookahead and the longest token, whatever
the length of the text.

Decoding. Identifiers become bytes, and an incremental UTF-8 machine gives out characters as soon as they are whole;
bytes that are no text become U+FFFD as in the usual lossy decoding, also when they are split over tokens.

Contract: null is encoded as the empty text; an empty text has no tokens and decodes to the empty text; strings of added
tokens in a text give their identifiers; equal rows give equal results; only the named columns are read, so other
columns, whatever their names, have no effect. An unknown identifier raises ``KeyError`` or ``IndexError``. A merge list that uses a
token before it is made (which has no finite lookahead by this argument) raises ``ValueError``.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .tasks import arrow_map

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 1 << 16
MEMO_ENTRIES = 150_000  #: of short pre-tokens with their identifiers, per Python worker
MEMO_CHARS = 48
MAX_FILE_BYTES = 64 << 20  #: of a vocabulary file that is sent to executors
NONE = 1 << 60


def _byte_characters() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """A byte-level BPE vocabulary with its merge list."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"] is None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is needed")
        if spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"] or spec["normalizer"]:
            raise ValueError("prefix spaces, normalizers and other pre-token patterns are not supported")
        if model["dropout"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"] or model.get("ignore_merges"):
            raise ValueError("dropout, affixes and ignored merges are not supported")
        to_byte = _byte_characters()
        ids: dict[str, int] = model["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(to_byte[c] for c in token) for token, i in ids.items()}
        self.byte_ids = [ids[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        self.added: dict[str, int] = {}
        for token in spec["added_tokens"]:
            if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError("added tokens that take in their surroundings are not supported")
            self.added[token["content"]] = token["id"]
            self.token_bytes[token["id"]] = token["content"].encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(pairs):
            self.ranks.setdefault(ids[left] << 32 | ids[right], rank)
            self.made.append(ids[left + right])
        self.longest = max(map(len, self.token_bytes.values()), default=1)
        self.lookahead = self._lookahead([(ids[a], ids[b]) for a, b in pairs])

    def _lookahead(self, pairs: list[tuple[int, int]]) -> int:
        known = set(self.byte_ids)
        for (left, right), whole in zip(pairs, self.made, strict=True):
            if left not in known or right not in known:
                raise ValueError("a merge uses a token that no earlier merge makes")
            known.add(whole)
        reach: dict[int, int] = {}  # longest chain of later merges whose right part is this token
        longest = 0
        for (left, right), whole in zip(reversed(pairs), reversed(self.made), strict=True):
            own = len(self.token_bytes[left]) + max(reach.get(whole, 0), reach.get(left, 0))
            reach[right] = max(reach.get(right, 0), own)
            longest = max(longest, own)
        return longest

    def merge(self, data: bytes) -> list[int]:
        """All merges over some bytes: the earliest rank first, the leftmost of it first."""
        ids = [self.byte_ids[b] for b in data]
        find = self.ranks.get
        rank = [find(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while rank:
            least = min(rank)
            if least == NONE:
                break
            i = rank.index(least)
            new = ids[i] = self.made[least]
            del ids[i + 1], rank[i]
            if i < len(rank):
                rank[i] = find(new << 32 | ids[i + 1], NONE)
            if i:
                rank[i - 1] = find(ids[i - 1] << 32 | new, NONE)
        return ids


class PieceTransducer:
    """Bytes of one pre-token in, final tokens out; holds at most one window of bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.window = 2 * (vocabulary.lookahead + vocabulary.longest)
        self.held = b""

    def push(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            while len(self.held) >= self.window:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        part = self.held[: self.window]
        end, final = 0, len(part) - self.vocabulary.lookahead
        for token in self.vocabulary.merge(part):
            size = len(self.vocabulary.token_bytes[token])
            if end + size > final:
                break
            end += size
            yield token
        self.held = self.held[end:]

    def finish(self) -> list[int]:
        rest, self.held = self.held, b""
        return self.vocabulary.merge(rest)


class _Memo(dict):
    """Tokens of pre-tokens seen lately; a bounded stand-in for running the transducer again."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        transducer = PieceTransducer(self.vocabulary)
        ids = (*transducer.push(piece.encode()), *transducer.finish())
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: Vocabulary, chunk_chars: int = CHUNK_CHARS):
        self.vocabulary, self.chunk_chars = vocabulary, chunk_chars
        self.find = regex.compile(PATTERN).findall
        self.memo = _Memo(vocabulary)
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens, some at a time. The last two of a part are held back: what follows may still change them."""
        held, at = "", 0
        while True:
            part, at = text[at : at + self.chunk_chars], at + self.chunk_chars
            found = self.find(held + part)
            if at >= len(text):
                yield found
                return
            yield found[:-2]
            held = "".join(found[-2:])

    def stream(self, text: str) -> Iterator[list[int]]:
        """Token identifiers of a text, some at a time."""
        for i, part in enumerate(self.added.split(text) if self.added else [text]):
            if i % 2:
                yield [self.vocabulary.added[part]]
            elif part:
                for found in self.pieces(part):
                    yield list(chain.from_iterable(map(self.memo.__getitem__, found)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.stream(text)))


class Decoder:
    """Identifiers in, whole characters out."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.token_bytes.__getitem__
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of, ids)))

    def finish(self) -> str:
        out = self.machine.decode(b"", final=True)
        self.machine.reset()
        return out


_encoders: dict[bytes, Encoder] = {}


def shipped(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """A function that gives executors an encoder for a vocabulary file of the driver, built once per Python worker."""
    raw = Path(path).read_bytes()
    if len(raw) > MAX_FILE_BYTES:
        raise ValueError(f"the vocabulary file is larger than {MAX_FILE_BYTES} bytes")
    name = hashlib.sha256(raw).digest()
    sent = spark.sparkContext.broadcast(raw)

    def get() -> Encoder:
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(Vocabulary(json.loads(sent.value)))
        return _encoders[name]

    return get


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the token identifiers of each text."""
    get = shipped(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).transform(arrow_map, run, f"`{key}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text``: the text of each row's identifiers; null has none."""
    get = shipped(tokens.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(get().vocabulary)
        for batch in batches:
            texts = [decoder.push(x or ()) + decoder.finish() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(key, ids).transform(arrow_map, run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256, exact``: encode and decode again, in one pass and part by part."""
    get = shipped(docs.sparkSession, path)

    def one(encoder: Encoder, decoder: Decoder, text: str, names: dict[int, str]) -> tuple[int, str, str, bool]:
        n, ids_hash, text_hash, at, exact = 0, hashlib.sha256(), hashlib.sha256(), 0, True
        for ids in encoder.stream(text):
            if ids:
                ids_hash.update((("," if n else "") + ",".join(map(names.__getitem__, ids))).encode())
                n += len(ids)
                got = decoder.push(ids)
                exact = exact and text.startswith(got, at)
                at += len(got)
                text_hash.update(got.encode())
        got = decoder.finish()
        text_hash.update(got.encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest(), exact and not got and at == len(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        decoder = Decoder(encoder.vocabulary)
        names = {i: str(i) for i in encoder.vocabulary.token_bytes}
        for batch in batches:
            rows = [one(encoder, decoder, x.as_py() or "", names) for x in batch.column(1)]
            n, a, b, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
            )
        encoder.memo.clear()  # an idle worker holds no memory

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).transform(arrow_map, run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean")


def tokenized(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``ids``, ``n_tokens`` and ``exact``: whether decoding gives the text again."""
    get = shipped(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        decoder = Decoder(encoder.vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                n = part.num_columns - 1
                texts = [x or "" for x in part.column(n).to_pylist()]
                ids = [encoder.encode(x) for x in texts]
                exact = [decoder.push(i) + decoder.finish() == x for i, x in zip(ids, texts, strict=True)]
                made = [pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(exact, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=[*part.schema.names[:n], "ids", "n_tokens", "exact"])
        encoder.memo.clear()  # an idle worker holds no memory

    kept = docs.select(*keep).schema
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())])
    return docs.select(*keep, text).transform(arrow_map, run, schema)
