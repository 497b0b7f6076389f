"""Token identifiers of word-level BPE vocabularies, whose words end with ``</w>``, equal to those of the tokenizers library.

Tokens of such a vocabulary never cross white space, so a text is encoded word by word and words are remembered. Words of plain
characters (up to U+017F, where letters, numbers and lower case are the same in every Unicode version) go through a rank
encoder: each pre-token gets a NUL at its end, which stands for ``</w>``. All other words go through the library itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import tiktoken
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from .bpe import MAX_FILE_BYTES, _byte_characters

MEMO_WORDS = 150_000  #: remembered, per Python worker
MEMO_BYTES = 48  #: of a word that is remembered
PIECE_BYTES = 1 << 10  #: of a word that the rank encoder takes: its time is quadratic
BLOCK_BYTES = 1 << 20  #: of a text that is split into words at a time

#: Letters and numbers among the plain characters after lower-casing, white space, and endings that are pre-tokens.
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = "\x09-\x0d\x20\x85\xa0"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE = re.compile(rb"[ \t-\r]")
ODD = re.compile("[^\x01-\u012f\u0131-\u017f]")  # U+0130 becomes two characters in lower case
PRE_TOKEN = re.compile(f"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}{BLANKS}\0]+")
MARKED = rf"(?:{ENDINGS}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}\x00]+)\x00|\n"
#: The parts of a vocabulary file that the rank encoder follows.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Texts to little-endian unsigned 32-bit identifiers, without special tokens around them."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        spec["truncation"] = spec["padding"] = None
        self.library = Tokenizer.from_str(json.dumps(spec))
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"] if spec["pre_tokenizer"]["type"] == "Sequence" else []
        if (
            model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model["dropout"] or model["continuing_subword_prefix"] or model.get("ignore_merges")
            or (spec["normalizer"] or {}).get("normalizers") != NORMALIZERS or [s["type"] for s in steps] != ["Split", "ByteLevel"]
            or steps[0]["pattern"] != {"Regex": SPLIT} or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]
        ):
            raise ValueError("a lower-casing word-level BPE vocabulary with </w> is needed")
        self.added = [t["content"] for t in spec["added_tokens"]]
        if any(any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) or t["content"].split() != [t["content"]] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.ranks, self.ids = self._ranks(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.encoder = tiktoken.Encoding("words", pat_str=MARKED, mergeable_ranks=self.ranks, special_tokens={})
        self.line = self.ranks[b"\n"]
        self.memo: dict[bytes, bytes] = {}

    @staticmethod
    def _ranks(vocab: dict[str, int], merges: list[tuple[str, str]]) -> tuple[dict[bytes, int], np.ndarray]:
        """Byte strings by rank: single bytes, bytes at a word's end, merges; and the identifier of each."""
        to_byte = _byte_characters()
        character = {b: c for c, b in to_byte.items()}

        def raw(token: str) -> bytes:
            return bytes(to_byte[c] for c in token.removesuffix("</w>")) + (b"\0" if token.endswith("</w>") else b"")

        tokens = [character[b] for b in range(256)] + [character[b] + "</w>" for b in range(1, 256)] + [a.removesuffix("</w>") + b for a, b in merges]
        ranks = {raw(token): rank for rank, token in enumerate(tokens)}
        if len(ranks) != len(tokens):
            raise ValueError("two merges make the same token")
        return ranks, np.array([vocab[token] for token in tokens], np.uint32)

    def _odd(self, text: str) -> bool:
        return bool(ODD.search(text)) or any(a in text for a in self.added)

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        found, plain = {}, words
        joined = b"\n".join(words).decode()
        if max(map(len, words)) > PIECE_BYTES or self._odd(joined):
            odd = {word for word in words if len(word) > PIECE_BYTES or self._odd(word.decode())}
            for word in odd:
                found[word] = np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, np.uint32).tobytes()
            plain = [word for word in words if word not in odd]
            joined = b"\n".join(plain).decode()
        ranks = np.array(self.encoder.encode_ordinary(PRE_TOKEN.sub("\\g<0>\0", joined.lower())), np.int64)
        packed, at = self.ids[ranks].tobytes(), 0
        for word, end in zip(plain, [*(4 * np.flatnonzero(ranks == self.line)).tolist(), len(packed)], strict=bool(plain)):
            found[word] = packed[at:end]
            at = end + 4
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Identifiers of some texts; all are worked off in blocks cut at white space."""
        out = [[] for _ in texts]
        for encoded in self._blocks(texts):
            for parts, part in zip(out, encoded, strict=True):
                parts.append(part)
        return [b"".join(parts) for parts in out]

    def _blocks(self, texts: list[str]) -> Iterator[list[bytes]]:
        memo, raw = self.memo, [text.encode() for text in texts]
        at = [0] * len(raw)
        while True:
            words = []
            for i, data in enumerate(raw):
                end = at[i] + BLOCK_BYTES
                if end < len(data):
                    space = SPACE.search(data, end)
                    end = space.start() if space else len(data)
                words.append(data[at[i] : end].split())
                at[i] = end
            found = [list(map(memo.get, own)) for own in words]
            new = {w for own, ids in zip(words, found, strict=True) if None in ids for w, x in zip(own, ids, strict=True) if x is None}
            if new:
                learnt = self._learn(list(new))
                for own, ids in zip(words, found, strict=True):
                    if None in ids:
                        ids[:] = [learnt[w] if x is None else x for w, x in zip(own, ids, strict=True)]
                if len(memo) < MEMO_WORDS:
                    memo.update((w, ids) for w, ids in learnt.items() if len(w) <= MEMO_BYTES)
            yield [b"".join(ids) for ids in found]
            if all(end >= len(data) for end, data in zip(at, raw, strict=True)):
                return


_encoders: dict[bytes, WordEncoder] = {}


def shipped(spark: SparkSession, path: str) -> Callable[[], WordEncoder]:
    """The encoder of a vocabulary file, sent to executors as one broadcast and made once per Python worker."""
    raw = Path(path).read_bytes()
    if len(raw) > MAX_FILE_BYTES:
        raise ValueError(f"the vocabulary file is larger than {MAX_FILE_BYTES} bytes")
    name, sent = hashlib.sha256(raw).digest(), spark.sparkContext.broadcast(raw)

    def get() -> WordEncoder:
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = WordEncoder(sent.value)
        return _encoders[name]

    return get
