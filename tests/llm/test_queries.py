"""Queries against their SQL twins, conversations, addresses, and the pipeline stage by stage."""

import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import chat_roles, url_cascade
from webloom.llm.oracles import ORACLES
from webloom.llm.queries import QUERIES, RULES, listed_sites

from . import brute

SF = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, sql, name):
    want = sql.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert ordered(got.select(*columns).collect()) == ordered(want.project(", ".join(columns)).fetchall())


# --- addresses -----------------------------------------------------------------------------------


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("pmod(xxhash64(key), 20) = 0").union(spark.createDataFrame([("not in the corpus",), ("k0",)], "key string"))
    levels = url_cascade.cascade(listed, universe)
    assert len(levels) > 2 and levels[-1].bits < levels[0].bits
    marked = universe.join(listed.distinct().withColumn("want", F.lit(True)), "key", "left")
    assert marked.filter(url_cascade.listed_by(levels, F.col("key")) != F.coalesce("want", F.lit(False))).count() == 0
    assert url_cascade.cascade(listed.limit(0), universe) == []
    assert universe.filter(url_cascade.listed_by([], F.col("key"))).count() == 0


ADDRESSES = [
    (1, None, "", ""), (2, "", "", ""), (3, "no scheme/en/", "", ""), (4, "http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1"),
    (5, "a://b.example.com?q=/en/", "b.example.com", ""), (6, "x://É.example.net/es/", "É.example.net", "/es/"), (7, "http://http://x/y", "http:", "//x/y"),
    (8, "https://spam-farm.example.org", "spam-farm.example.org", ""), (9, "http://m.spam-farm.example.org/a", "m.spam-farm.example.org", "/a"),
    (10, "http://notexample.com/en/", "notexample.com", "/en/"), (10, "http://com/", "com", "/"),
]
VERDICTS = {
    4: ("www.example.com/en/", "allow"), 6: ("net/es/", "block"), 8: (None, "block"), 9: (None, "block"), 10: ("com/", "allow"), 5: (None, "allow"), 1: (None, "allow"),
}


def test_addresses(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u, _, _ in ADDRESSES], "page_id long, url string, verdict string, site string")
    rows = url_cascade.judge(pages, RULES, listed_sites(spark)).collect()
    assert ordered((r.page_id, r.host, r.path) for r in rows) == ordered((i, h, p) for i, _, h, p in ADDRESSES)
    for r in rows:
        if r.page_id in VERDICTS:
            assert (r.rule, r.verdict) == VERDICTS[r.page_id]
    by_join = url_cascade.judge(pages, RULES, listed_sites(spark), max_listed=3)
    assert ordered(by_join.select(*rows[0].__fields__).collect()) == ordered(rows)
    assert url_cascade.judge(pages.limit(0), RULES, listed_sites(spark)).count() == 0


def test_addresses_stay_native(spark):
    plan = QUERIES["op5_url_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


# --- conversations -------------------------------------------------------------------------------


def plain_viterbi(model, rows):
    """Best roles of all lines of one conversation at once."""
    best, backs, sizes = [chat_roles.NEVER] * chat_roles.START + [0], [], []
    for text in rows:
        lines = (text or "").split("\n")
        sizes.append(len(lines))
        for i, line in enumerate(lines):
            best, back = chat_roles._extend(model, best, line, i == 0)
            backs.append(back)
    role = -max((s, -r) for r, s in enumerate(best))[1]
    out = []
    for back in reversed(backs):
        out.append(role)
        role = back[role]
    out.reverse()
    firsts, at = [], 0
    for n in sizes:
        firsts.append(chat_roles.ROLES[out[at]])
        at += n
    return firsts


CHATS = "conv_id long, turn long, role string, text string, block string, rendered string"


def test_blocks_equal_one_pass(spark, monkeypatch):
    monkeypatch.setattr(chat_roles, "BLOCK", 4)
    rng = random.Random(2)
    bits = ["hello?", "User: what", "Assistant: well.\n- one\n- two", "x" * 300, "", None, "a\nb\nHuman> c", "System: be good"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "other"]), rng.choice(bits), "b", "r") for c, n in ((1, 60), (2, 1), (3, 9)) for t in range(n)]
    df = spark.createDataFrame(rows, CHATS)
    keyed = df.withColumn("block", F.floor(F.col("turn") / 4)).withColumn("opens", chat_roles._opens())
    model = chat_roles.fit(keyed)
    got = {(r.conv_id, r.turn): r.role_found for r in chat_roles.format_chats(df).collect()}
    for conv in (1, 2, 3):
        own = [r for r in rows if r[0] == conv]
        assert [got[conv, t] for t in range(len(own))] == plain_viterbi(model, [r[3] for r in own])


def test_markers_and_rendering(spark):
    rows = [(1, 0, None, "User: hi\nthere\nAssistant: yes", "", ""), (1, 1, None, "[human]: more", "", "")]
    got = chat_roles.format_chats(spark.createDataFrame(rows, CHATS), labels=False).orderBy("turn").collect()
    assert got[0].rendered == "<|user|>\nhi\nthere\n<|end|>\n<|assistant|>\nyes\n<|end|>\n" and got[0].n_segments == 2
    assert got[1].rendered == "<|user|>\nmore\n<|end|>\n"


def test_awkward_conversations(spark):
    rows = [(None, None, None, None, "", ""), (None, 1, "user", "a", "", ""), (1, None, "user", "x", "", ""), (1, 0, "user", "y", "", ""), (1, 0, "user", "y", "", ""), (1, 0, "assistant", "z" * 200_000, "", "")]
    df = spark.createDataFrame(rows, CHATS)
    got = chat_roles.format_chats(df).collect()
    assert ordered((r.conv_id, r.turn) for r in got) == ordered((r[0], r[1]) for r in rows)
    assert all(r.role_found in chat_roles.ROLES for r in got)
    assert chat_roles.format_chats(df.limit(0)).count() == 0


def test_roles_of_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    hidden = F.crc32(F.col("conv_id").cast("string")) % 3 == 1
    blind = df.withColumn("role", F.when(~hidden, F.col("role")))
    got = {(r.conv_id, r.turn): r.role_found for r in chat_roles.format_chats(blind).collect()}
    rows = [r for r in df.collect() if zlib.crc32(str(r.conv_id).encode()) % 3 == 1]
    assert sum(got[r.conv_id, r.turn] == r.role for r in rows) > 0.95 * len(rows)


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("spans", F.lit(1)).withColumn("slot", F.lit("s"))
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "tokens"]

    good = corpus_pipeline.written(stages["quality"](spark, docs, SF), "quality")
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    n_good = labels.filter("quality = 1").join(docs, "doc_id").count()
    assert good.join(labels.filter("quality = 1"), "doc_id").count() >= 0.97 * n_good

    texts = {r.doc_id: r.text for r in good.collect()}
    one = corpus_pipeline.written(stages["near_duplicates"](spark, good, SF), "one")
    assert {r.doc_id for r in one.collect()} == {c for _, c in brute.components(texts, 5, 80).values()}
    assert one.columns == docs.columns

    rows = one.orderBy("doc_id").collect()
    clean = corpus_pipeline.written(stages["repeated_passages"](spark, one, SF), "clean")
    want = brute.repeats([r.text.encode() for r in rows], 400)
    got = {r.doc_id: r for r in clean.collect()}
    assert len(got) == len(rows)
    for r, (n, removed, _, _) in zip(rows, want, strict=True):
        assert n - removed - 6 <= len(got[r.doc_id].text.encode()) <= n - removed
        assert got[r.doc_id].n_chars == len(got[r.doc_id].text)

    safe = corpus_pipeline.written(stages["benchmark_leaks"](spark, clean, SF), "safe")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = sorted(got)
    leaks = brute.leaks([got[d].text for d in kept], items)
    assert {r.doc_id for r in safe.collect()} == {d for d, x in zip(kept, leaks, strict=True) if not x[4]}

    tokens = stages["tokens"](spark, safe, SF).collect()
    assert len(tokens) == safe.count() and all(r.exact and r.n_tokens == len(r.ids) for r in tokens)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_pipeline_rows_without_identifier(spark):
    """Null identifiers are documents like others: leaks go, copies go, passages count on both sides."""
    rng = random.Random(9)
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(brute.ALNUM.findall(r.text)) >= 12)
    own = [" ".join(f"z{rng.randrange(9000)}" for _ in range(120)) for _ in range(7)]
    passage = " ".join(f"p{rng.randrange(9000)}" for _ in range(120))
    texts = [
        (1, own[0]), (None, own[0]), (None, own[1]), (None, own[1]), (None, f"{own[2]} {item} {own[3]}"),
        (2, f"{own[4]} {passage}"), (None, f"{own[5]} {passage}"), (None, None), (9, own[6]),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("near_duplicates", "repeated_passages", "benchmark_leaks"):
        docs = corpus_pipeline.written(dict(corpus_pipeline.STAGES)[name](spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_duplicates":
            want = [*texts[:1], *texts[3:]]
            assert ordered((r.doc_id, r.text) for r in docs.collect()) == ordered(want)
    got = ordered((r.doc_id, (r.text or "").strip()) for r in docs.collect())
    assert [d for d, _ in got] == [d for d, _ in ordered([(1, 0), (2, 0), (9, 0), (None, 0), (None, 0), (None, 0)])]
    assert item not in " ".join(t for _, t in got) and passage[60:-60] not in " ".join(t for _, t in got)
    assert sum(own[1] in t for _, t in got) == 1 and sum(own[5] in t for _, t in got) == 1
