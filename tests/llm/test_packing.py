"""Packing against the tokenizers library, and the level array against its definition."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from webloom.llm import packing, word_bpe
from webloom.llm.more_queries import QUERIES, WORD_BPE

from .test_documents import SCHEMA, SF, awkward_rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def encoder():
    with open(WORD_BPE, "rb") as f:
        return word_bpe.WordEncoder(f.read())


ODD = [
    "", "plain Words, isn't it? we'll 'S 'sound !'s", "İstanbul ŉ ΑΣ Σ ẞ", "é ́x á̧b", "ª º µ ² ½ × ÷", "nul\0l \x1c\x1f!", "a b c\x85d",
    "<|endoftext|>x <|startoftext|> <|endoftext", "日本語テキスト한국어 ไทย", "😀👍🏽", "'" * 50, "a" * 5000, "A1b2 3.14 ١٢٣ ⅷ", "ÀÉÎŐŠŽſ ĳ", "x​y﻿z",
]


def test_encoder_equals_the_library(encoder, library):
    rng = random.Random(3)
    mixed = ["".join(rng.choice("aéİ Σ'.\t\n1²日́ Z<|") for _ in range(60)) for _ in range(300)]
    texts = ODD + mixed
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_blocks_of_long_texts(encoder, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "BLOCK_BYTES", 50)
    text = " ".join(t for t in ODD if t) * 3
    assert np.frombuffer(encoder.encode([text, "short"])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def plain_level(counts, size, window):
    """The level with the least sum of squares; of ties the fullest."""
    options = []
    for level in range(window - size + 1):
        if level == 0 or counts[level]:
            after = Counter({h: c for h, c in enumerate(counts) if c})
            after[level] -= level > 0
            after[level + size] += level + size < window
            options.append((sum(c * c for c in after.values()), -level))
    return -min(options)[1]


def test_least_sum_of_squares():
    rng = random.Random(5)
    packer = packing.Packer(24, 1000)
    for k in range(400):
        size = rng.randrange(1, 24)
        assert packer.level_for(size) == plain_level(packer.counts.tolist(), size, 24)
        list(packer.add(k, bytes(4 * size)))
        assert packer.n_open == packer.counts.sum() == sum(map(len, packer.levels.values()))


@pytest.mark.parametrize("limit", [1, 3, 500])
def test_every_token_once(limit):
    rng = random.Random(limit)
    packer = packing.Packer(32, limit)
    docs = {k: np.arange(rng.choice([1, 5, 17, 32, 33, 200])).astype("<u4").tobytes() for k in range(300)}
    windows = [w for k, d in docs.items() for w in packer.add(k, d)]
    assert packer.n_open <= limit
    windows += packer.finish()
    sizes = [sum(len(p[3]) // 4 for p in w) for w in windows]
    assert all(s == 32 for s in sizes if s & (s - 1)) and sizes.count(32) == sum(map(len, docs.values())) // 4 // 32
    seen = defaultdict(dict)
    for key, total, start, ids in (p for w in windows for p in w):
        assert total == len(docs[key]) // 4 and ids == docs[key][4 * start : 4 * start + len(ids)] and start not in seen[key]
        seen[key][start] = len(ids) // 4
    for key, pieces in seen.items():
        assert sorted(pieces) == [0, *np.cumsum([pieces[s] for s in sorted(pieces)]).tolist()[:-1]] and sum(pieces.values()) == len(docs[key]) // 4
    assert seen.keys() == docs.keys()


def check(rows, docs, library, window):
    """Pieces hold the library's tokens, each as often as its row; sequences have no gap and no padding."""
    want = {(d, t): [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in docs}
    by_id = defaultdict(list)
    for (d, _), ids in want.items():
        by_id[d].append(ids)
    covered, times = Counter(), Counter(d for d, _ in docs)
    sequences = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert any(len(x) == r.doc_tokens and x[r.start : r.start + r.length] == ids for x in by_id[r.doc_id])
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == Counter({d: 0 for d in times}) + Counter(_totals(docs, want))
    for pieces in sequences.values():
        pieces.sort()
        size = sum(n for _, n in pieces)
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces]).tolist()[:-1]]
        assert size == window or (size < window and not size & (size - 1))


def _totals(docs, want):
    total = Counter()
    for d, t in docs:
        total[d] += len(want[d, t])
    return total


def test_packing(spark, library):
    awkward = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    for df, window in ((awkward, 4096), (awkward, 64), (given, 4096)):
        check(packing.pack(df, WORD_BPE, 2, window).collect(), [(r.doc_id, r.text) for r in df.collect()], library, window)
    assert packing.pack(awkward.limit(0), WORD_BPE, 2).count() == 0


def test_query(spark, library):
    rows = QUERIES["op11_packing"](spark, SF).orderBy("doc_id", "start").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
