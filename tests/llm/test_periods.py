"""Periodic runs against all periods at all places."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from webloom.llm import periodic_runs
from webloom.llm.more_queries import QUERIES

from . import brute
from .test_documents import SCHEMA, SF, awkward_rows


def test_cover():
    size = periodic_runs.MODULUS
    assert {(a - b) % size for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(size))
    for i in range(size):
        for j in range(size):
            step = periodic_runs.STEPS[i, j]
            assert {(i + step) % size, (j + step) % size} <= set(periodic_runs.COVER)


def test_extensions():
    rng = random.Random(1)
    for n, k in ((40, 1), (700, 2), (300, 40), (2000, 1)):
        words = [rng.randrange(k) for _ in range(n)]
        words[n // 2 :] = words[: n - n // 2]
        words += range(k, k + periodic_runs.MODULUS)
        found = periodic_runs.Extensions(np.array(words))
        i = np.array([rng.randrange(n) for _ in range(400)])
        j = np.array([rng.choice([x for x in (rng.randrange(n), (a + 1) % n) if x != a] or [a + 1]) for a in i.tolist()])
        for a, b, got in zip(i.tolist(), j.tolist(), found.common(i, j).tolist(), strict=True):
            want = 0
            while max(a, b) + want < len(words) and words[a + want] == words[b + want]:
                want += 1
            assert got == want


def some_words(rng):
    n, k = rng.choice([0, 1, 23, 24, 25, 60, 150, 300]), rng.choice([1, 2, 3, 50])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(3) if n else 0):
        a = rng.randrange(n)
        p = 1 + rng.randrange((n - a) // 3 + 1)
        for i in range(a, rng.randrange(a, n + 1)):
            words[i] = words[a + (i - a) % p]
    return words


def test_find_runs(monkeypatch):
    rng = random.Random(2)
    for trial in range(300):
        monkeypatch.setattr(periodic_runs, "PAIRS", rng.choice([7, 1 << 20]))
        texts = [some_words(rng) for _ in range(rng.randrange(1, 6))]
        sizes = np.array([len(t) for t in texts])
        got = periodic_runs.find_runs(np.array([w for t in texts for w in t], np.int64), sizes)
        want = [(t, *r) for t, words in enumerate(texts) for r in brute.runs(words)]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect())
    want = []
    for r in awkward_rows():
        words = brute.SPACED.findall(r[1] or "")
        found = brute.runs(words) if len(words) < 10_000 else []  # the longest is random
        want.append(((r[0] is None, r[0] or 0), len(words), found, collapsed(words, found)))
    assert got == sorted(want)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_query(spark):
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    with_runs = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = brute.SPACED.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute.runs(words)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None, None, None)
        with_runs += bool(found)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, found))]
        assert got.pop(r.doc_id) == (r.doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *digests)
    assert not got and with_runs > 10
