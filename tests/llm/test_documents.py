"""Operators on documents against plain versions: the smallest given tables, and a table of awkward rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from webloom.llm import bpe, decontaminate, ngram_join, quality_gam, quality_rules, suffix_dedup, token_counts, training_order
from webloom.llm.queries import BYTE_BPE, QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def awkward_rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = " ".join(rng.choice(words) for _ in range(300))
    near = base.replace("w7 ", "x ", 2)
    texts = [
        None, "", "   \n\t ", "one", "One  two\nthree", "!!! ??? ###", "a" * 3000, "é" * 900, "日本語 テキスト " * 60, long, long[:5000], base, base, near,
        base + " <|endoftext|> tail", "x\n" * 200, "   odd spaces", "tab\tand\x0bother\x1fcontrol\x00", base.upper(),
        "The " + base[:420] + " z", "Other " + base[:420] + " y", "nul\x00l " * 100, "😀" * 150, "it's we'll 12½³ ́combining _under_",
    ]
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "s"][i % 2], i, i, "n", -1) for i, t in enumerate(texts)]
    return [*rows, rows[11], (None, base, "en", "s", 1, 2, "n", 3), (None, None, None, None, None, None, None, None)]


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("slot", T.StringType()),
        T.StructField("spans", T.LongType()),
    ]
)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def table_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


# --- n-gram join ---------------------------------------------------------------------------------


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_ngram_join(given, awkward, words, percent):
    for df in (given, awkward):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.self_join(df, words, percent).collect() if r.doc_id is not None}
        assert got == brute.components({d: t for d, t in table_of(df) if d is not None}, words, percent)


def test_ngram_join_keeps_rows(awkward, empty):
    rows = ngram_join.self_join(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert ngram_join.self_join(empty).count() == 0
    kept = ngram_join.deduplicated(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in (11, 12, 13)) == [11]


def test_ngram_join_of_repeated_rows(spark):
    """Repeated rows beside texts that only their vectors bring near."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        words = [f"v{rng.randrange(5000)}" for _ in range(500)]
        other = list(words)
        for at in rng.sample(range(500), 13 + i % 3):
            other[at] = f"u{rng.randrange(5000)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    twice = rows + rows[::2] + rows[:6]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.self_join(spark.createDataFrame(twice, "doc_id long, text string"), 4, 85).collect()}
    want = brute.components(dict(rows), 4, 85)
    assert len({c for _, c in want.values()}) > 60
    assert got == want


def test_verify_takes_a_pair_twice(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c x y z"), (3, "a b c d e f g")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 3), (1, 3)], "a long, b long")
    assert {tuple(r) for r in ngram_join.verify(pairs, docs, "doc_id", "text", 1, 80).collect()} == {(1, 3)}


def test_count_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 6, (40, ngram_join.GROUPS))
    vectors = np.minimum(np.repeat(base, 8, 0) + (rng.random((320, ngram_join.GROUPS)) < 0.05), 255).astype(np.uint8)
    vectors[5, 0] = 255
    sizes, ids, comps = vectors.sum(1).astype(np.int64), np.arange(320), np.arange(320) // 3
    tree = ngram_join.CountTree(ids, sizes, comps, vectors)
    got = {tuple(sorted((int(tree.ids[a]), int(tree.ids[b])))) for x, y in tree.join(tree, 85) for a, b in zip(x, y)}
    wide = np.where(vectors == 255, 1 << 24, vectors.astype(np.int64))
    want = {
        (i, j)
        for i in range(320)
        for j in range(i + 1, 320)
        if comps[i] != comps[j]
        and 100 * min(sizes[i], sizes[j]) >= 85 * max(sizes[i], sizes[j])
        and 185 * np.minimum(wide[i], wide[j]).sum() >= 85 * (sizes[i] + sizes[j])
    }
    assert got == want


def test_tree_blocks(spark, given, monkeypatch):
    """Groups that span blocks and batches lose nothing."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "FANOUT", 2)
    got = {r.doc_id: r.component_id for r in ngram_join.self_join(given, 4, 85).collect()}
    assert got == {d: c for d, (_, c) in brute.components(dict(table_of(given)), 4, 85).items()}


def edited_copies(rng, n_texts, copies):
    """Texts with many edited copies, some near enough to link and some not."""
    rows = []
    for t in range(n_texts):
        words = [f"e{t}x{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(copies):
            other = list(words)
            for at in rng.sample(range(len(other)), rng.randrange(0, max(2, len(other) // 40))):
                other[at : at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [other[at], "again"]])
            rows.append((len(rows), " ".join(other)))
    return rows


def test_the_tree_alone_finds_all_links(spark, given, monkeypatch):
    """Without the first pass every link between different sets has to come from the trees."""
    plain, calls = ngram_join.bounded, []

    def second_pass_only(pairs, feats, percent):
        calls.append(1)
        return plain(pairs.limit(0) if len(calls) == 1 else pairs, feats, percent)

    rows = edited_copies(random.Random(8), 12, 9)
    for df, texts in ((spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)), (given, dict(table_of(given)))):
        calls.clear()
        monkeypatch.setattr(ngram_join, "bounded", second_pass_only)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.self_join(df, 4, 85).collect()}
        assert len(calls) == 2 and got == brute.components(texts, 4, 85)
        assert len({c for _, c in got.values()}) < len(got)


def test_a_pair_is_told_a_few_times(spark):
    """Near copies share most of their prefixes, and are candidates at the places after an edit only."""
    rows = edited_copies(random.Random(9), 1, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = spark.sparkContext.broadcast(ngram_join.hot_cells(docs, "text", 1))
    feats = ngram_join.features(docs, "doc_id", "text", 1, 50, hot)
    before = [f"coalesce(get(prefix, place - {k + 1}), 0L) as before{k}" for k in range(ngram_join.BEFORE)]
    tokens = feats.selectExpr("doc_id", "doc_id as comp", "n", "tree", "prefix", "posexplode(prefix) as (place, token)")
    tokens = tokens.selectExpr("token", "doc_id", "comp", "n", "tree", "cast(place as bigint) as place", *before)
    pairs = ngram_join._tree_pairs(tokens, 50)
    told = sum(1 for _ in pairs.collect())
    n = tokens.select("doc_id").distinct().count()
    assert told == n * (n - 1) // 2
    shared = tokens.alias("x").join(tokens.alias("y"), "token").filter("x.doc_id < y.doc_id").count()
    raw = pairs._jdf.queryExecution().logical().children().apply(0)
    assert DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, raw), spark).count() < shared / 4


def test_hot_tokens_are_split(spark, monkeypatch):
    """A template in all documents, just below the limit: no task holds more than two blocks, and nothing is lost."""
    rng = random.Random(4)
    template = [f"t{i}" for i in range(100)]
    rows = []
    for d in range(60):
        own = [f"o{d if d % 6 else d // 12}x{i}" for i in range(8 + d % 4)]
        rows.append((d, " ".join(template[:50] + own + template[50:])))
    rng.shuffle(rows)
    monkeypatch.setattr(ngram_join, "SPLIT", 8)
    sizes = []
    plain = ngram_join._block_pairs

    def seen(split, percent):
        sizes.extend((r.token, r["count"]) for r in split.groupBy("token", "i", "j").count().collect())
        return plain(split, percent)

    monkeypatch.setattr(ngram_join, "_block_pairs", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.self_join(docs, 4, 85).collect()}
    assert got == brute.components(dict(rows), 4, 85)
    assert len(sizes) > 10 and max(n for _, n in sizes) < 60


# --- suffix sort ---------------------------------------------------------------------------------


def check_spans(df, length, **options):
    rows = table_of(df)
    rows = [r for r in rows if r[0] is not None]
    want = brute.repeats([(t or "").encode() for _, t in rows], length)
    spans = suffix_dedup.repeated_spans(df, length, **options)
    by_doc = {}
    for r in spans.collect():
        by_doc.setdefault(r.doc_id, []).append({"begin": r.begin, "end": r.end})
    for (doc, text), (_, removed, n, digest) in zip(rows, want, strict=True):
        got = suffix_dedup._union(by_doc.get(doc))
        raw = (text or "").encode()
        assert (sum(e - b for b, e in got), len(got)) == (removed, n), doc
        assert hashlib.sha256(b"".join(suffix_dedup.kept_bytes(raw, got))).hexdigest() == digest


def test_repeated_spans(given, awkward):
    check_spans(awkward, 400)
    check_spans(awkward, 60, gram=16)
    check_spans(given.limit(80), 100, gram=32)


def test_periodic_texts_are_few_rows(spark):
    """Short periods make a run at every period; equal runs in a row are one, with the same result."""
    rng = random.Random(12)
    spam = "".join(rng.choice("abcdef") for _ in range(10))
    rows = [(d, f"start {d} " + spam * (80 + d) + f" end {d}" + " z" * d) for d in range(30)] + [(40, "ab" * 900), (41, "q" * 1000 + "r"), (42, "unique " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_spans(docs, 400)
    check_spans(docs, 60, gram=16, group=3)
    found = suffix_dedup.anchored(docs, 400, 64, "doc_id", "text")
    n = found.count()
    assert n < 30 * 20 and found.agg({"times": "sum"}).first()[0] > 4 * n
    assert suffix_dedup.repeated_spans(docs, 400).count() < 30 * 20


def test_many_different_runs_of_an_anchor(awkward):
    check_spans(awkward, 60, gram=16, group=1)


def test_suffix_digest_and_cleaning(awkward, empty):
    rows = suffix_dedup.digest(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.n_removed for r in rows if r.doc_id is None} == {0}
    assert suffix_dedup.digest(empty).count() == 0
    kept = suffix_dedup.cleaned(awkward)
    assert kept.schema == awkward.schema
    assert kept.filter("doc_id = 11").first().text == ""
    assert kept.filter("doc_id = 3").first().text == "one"


def check_word_spans(df, length, **options):
    rows = [r for r in table_of(df) if r[0] is not None]
    words = [brute.SPACED.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    by_doc = {}
    for r in suffix_dedup.repeated_spans(df, length, words=True, **options).collect():
        by_doc.setdefault(r.doc_id, set()).update(range(r.begin, r.end))
    n = 0
    for (doc, _), w in zip(rows, words, strict=True):
        want = {k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(i, i + length)}
        assert by_doc.get(doc, set()) == want, doc
        n += len(want)
    return n


@pytest.mark.parametrize(("length", "gram", "group"), [(51, 8, 2048), (12, 3, 2048), (12, 3, 1), (3, 1, 1)])
def test_repeated_words(spark, awkward, length, gram, group):
    rng = random.Random(length)
    stock = [[f"s{rng.randrange(40)}" for _ in range(90)] for _ in range(6)]
    parts = [rng.choice(stock)[rng.randrange(30) :][: rng.randrange(3, 80)] + [f"o{rng.randrange(900)}"] for _ in range(160)]
    rows = [(d, rng.choice((" ", "\n", " \t ")).join(w for p in parts[2 * d : 2 * d + 2] for w in p)) for d in range(80)]
    made = spark.createDataFrame([*rows, (80, None), (81, ""), rows[3]], "doc_id long, text string").repartition(6)
    assert check_word_spans(made, length, gram=gram, group=group) > 0
    assert check_word_spans(awkward, length, gram=gram, group=group) > 0


def test_passages_below_the_byte_length(spark, tmp_path):
    """51 equal words of some 300 bytes go, 50 stay; white space between them and letters of two bytes do not matter; leaks are left to the next stage."""
    rng = random.Random(5)
    own = [" ".join(f"o{rng.randrange(10**6)}" for _ in range(70)) for _ in range(11)]
    word = iter(f"p{i:04}" for i in range(9000))
    long, short = ([next(word) for _ in range(n)] for n in (51, 50))
    accents = ["é" * 2 + next(word) for _ in range(60)]
    assert len(" ".join(long)) == 305 and len(" ".join(accents).encode()) > 400
    rows = [
        (1, f"{own[0]} {' '.join(long)} {own[1]}"), (2, "\n".join(long) + "\n" + own[2]), (3, f"{own[3]} {' '.join(short)}"), (4, f"{' '.join(short)} {own[4]}"),
        (5, f"{own[5]} {' '.join(accents)}"), (6, "\t".join(accents)), (7, None), (8, own[6]), (9, f"x{' '.join(long)} {own[7]}"),
    ]
    item = " ".join(next(word) for _ in range(55))
    assert len(item) < 400
    leaks = [(10, f"{own[8]} {item}"), (11, f"{item} {own[9]}"), (12, f"{own[10]} {' '.join(long)} {item[:80]}")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("w")).repartition(4)
    want = dict(rows) | {1: f"{own[0]}  {own[1]}", 2: f"\n{own[2]}", 5: f"{own[5]} ", 6: ""}
    cleaned = suffix_dedup.cut(docs, suffix_dedup.repeated_spans(docs), suffix_dedup.repeated_spans(docs, 51, 8, words=True))
    assert cleaned.columns == docs.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == want
    numbered = docs.unionByName(spark.createDataFrame(leaks, "doc_id long, text string").withColumn("words", F.lit("w")))
    staged = corpus_pipeline.written(corpus_pipeline.repeated_passages(spark, numbered.withColumn("n_chars", F.lit(0)), str(tmp_path)), "staged")
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in staged.collect())
    got = {r.doc_id: r.text for r in staged.collect()}
    assert {d: t for d, t in got.items() if d < 10} == want
    assert {d: t for d, t in got.items() if d >= 10} == dict(leaks)
    assert {r.doc_id for r in corpus_pipeline.benchmark_leaks(spark, staged, str(tmp_path)).collect()} == set(want)


def test_hash_collision_falls_back_to_bytes(monkeypatch):
    texts = [b"abcx", b"abdy", b"abcz", b"b", b""]
    wrong = suffix_dedup.Suffixes(texts)
    wrong.hashes = memoryview(np.zeros(len(wrong.hashes), np.uint64))
    with pytest.raises(suffix_dedup.HashCollision):
        wrong.order(list(range(5)))
    order, shared = suffix_dedup.PlainSuffixes(texts).order(list(range(5)))
    assert [texts[i] for i in order] == sorted(texts) and shared == [0, 0, 3, 2, 0]
    assert suffix_dedup.Suffixes(texts).order(list(range(5))) == (order, shared)


# --- decontamination -----------------------------------------------------------------------------


def test_decontamination(spark, given, awkward, empty):
    items = [(1, "w7 w8"), (2, None), (3, ""), (4, " ".join(awkward_rows()[11][1].split()[40:70])), (5, "One, two THREE"), (5, "one two three"), (6, "one")]
    for df, bench in ((given, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]), (awkward, items)):
        b = spark.createDataFrame(bench, "item_id long, text string")
        judged = decontaminate.item_digest(decontaminate.judge(df, b), decontaminate.benchmark_windows(b))
        rows = table_of(df)
        want = [(d, *x) for (d, _), x in zip(rows, brute.leaks([t for _, t in rows], bench), strict=True) if d is not None]
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in judged.collect() if r.doc_id is not None]
        assert ordered(got) == ordered(want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge(awkward, none).filter("n_hit > 0").count() == 0
    assert decontaminate.judge(empty, b).count() == 0


def test_decontamination_in_blocks(spark, given, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_TERMS", 300)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = table_of(given)
    want = brute.leaks([t for _, t in rows], [tuple(r) for r in bench.collect()])
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.judge(given, bench).collect()}
    assert got == {d: x[:2] for (d, _), x in zip(rows, want, strict=True)}


def test_terms_sent_are_bounded(spark, given, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_TERMS", 400)
    sent, plain = [], decontaminate._sent
    monkeypatch.setattr(decontaminate, "_sent", lambda terms: sent.append(terms.count()) or plain(terms))
    windows = decontaminate.benchmark_windows(spark.read.parquet(f"{SF}/benchmark.parquet"), 10)
    blocks = decontaminate._blocks(windows)
    decontaminate.judge(given, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert 1 < blocks < 40 and 0 < max(sent) <= 400


def thue_morse(n, letters="ab"):
    """Texts of n bytes and their swap, which collide in every polynomial hash modulo 2**64 from some length on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


COLLIDING = [x for n in (256, 1024, 2048, 4096, 8192) for x in thue_morse(n)]


def test_constructed_collisions_are_told_apart(spark):
    words = [f"c{i}" for i in range(60)]
    texts = [*COLLIDING, *(" ".join([w, *words]) for w in COLLIDING), *("\n".join([*COLLIDING[i : i + 2], *words]) for i in range(0, 10, 2))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.self_join(docs, 4, 85).collect()}
    assert got == brute.components(dict(enumerate(texts)), 4, 85) and got[1] == (1, 1)
    rules = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for d, t in enumerate(texts):
        want = brute.base_rules(t)
        assert (rules[d].n_words, rules[d].word_chars, rules[d].n_symbols, rules[d].n_dup_lines, rules[d].n_repeat_words, rules[d].base_failed) == want
    items = [(0, COLLIDING[2]), (1, " ".join([COLLIDING[5], *words[:9]]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.judge(docs, bench).collect()}
    assert hits == {d: x[:2] for d, x in enumerate(brute.leaks(texts, items))}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red a fox b quick"), (2, "quick red c c c c fox"), (3, "red quick"), (4, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "quick red fox"), (2, None)], "item_id long, text string")
    near = decontaminate.proximity(docs, phrases, 5)
    assert [(r.item_id, r.doc_id, r.start, r.length) for r in near.collect()] == [(1, 1, 0, 5)]


# --- quality -------------------------------------------------------------------------------------


def test_quality_rules(given, awkward, empty):
    for df in (given, awkward):
        rows = quality_rules.judge(df).collect()
        got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
        assert ordered(got) == ordered((d, *brute.base_rules(t)) for d, t in table_of(df))
        assert not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.judge(empty).count() == 0


def test_fences_follow_the_group(spark):
    measured = spark.createDataFrame(
        [("en", "a", "x", v, 1) for v in range(1000)] + [("fr", None, "x", 5000 + v, 1) for v in range(100)], "lang string, source string, measure string, bin long, n long"
    )
    low = {(r.lang, r.source): (r.size, r.low, r.high) for r in quality_rules.fences(measured.replace("x", "symbols", "measure"), ["lang", "source"]).collect()}
    assert low["en", "a"] == (1000, 249 - 1500 - 300, 749 + 1500 + 300) and low["fr", None][0] == 100


def test_bins_are_close(spark):
    rows = spark.range(0, 5000).select("id", quality_rules.bin_of(quality_rules.F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id and (r.id - r.b) * 64 <= max(r.id, 1) for r in rows) and all(r.b == r.id for r in rows if r.id < 128)


def test_quality_gam(spark, given, awkward, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_gam.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    some = quality_gam.classify(awkward, labels)
    assert some.count() == awkward.count() and some.filter("score is null").count() == 0
    assert quality_gam.classify(empty, labels).count() == 0
    assert {r.score for r in quality_gam.classify(awkward, labels.filter("quality > 1")).collect()} == {0.5}
    assert quality_gam.accepted(awkward, labels).schema == awkward.schema


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality_gam.train(x[:1500], y[:1500])
    assert (1, 2) in model.pairs and ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95


# --- tokens --------------------------------------------------------------------------------------


def test_bpe_round_trip(given, awkward, empty):
    library = Tokenizer.from_file(BYTE_BPE)
    for df in (given, awkward):
        want = []
        for d, t in table_of(df):
            ids = library.encode(t or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), True))
        assert ordered(tuple(r) for r in bpe.round_trip(df, BYTE_BPE).collect()) == ordered(want)
    assert bpe.round_trip(empty, BYTE_BPE).count() == 0
    back = bpe.decode(bpe.encode(awkward.filter("doc_id is not null"), BYTE_BPE), BYTE_BPE)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(d, t or "") for d, t in table_of(awkward) if d is not None}


def vocabulary():
    import json
    from pathlib import Path

    return bpe.Vocabulary(json.loads(Path(BYTE_BPE).read_text()))


def test_transducer_is_exact_and_bounded():
    library, v = Tokenizer.from_file(BYTE_BPE), vocabulary()
    rng = random.Random(5)
    parts = ["a", "aa", "ing", "tion", "the", "er", "in", "q", "-", "----------", "=="]
    for text in ["a" * 4000, "=" * 3001, "ab" * 2000, *["".join(rng.choice(parts) for _ in range(900)) for _ in range(40)]]:
        pieces = bpe.Encoder(v).find(text)
        got = []
        for piece in pieces:
            t = bpe.PieceTransducer(v)
            for b in piece.encode():
                got += t.push(bytes([b]))
                assert len(t.held) < t.window
            got += t.finish()
        assert got == library.encode(text, add_special_tokens=False).ids


def test_pieces_do_not_depend_on_chunks():
    v = vocabulary()
    small, whole = bpe.Encoder(v, chunk_chars=3), bpe.Encoder(v)
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice(["a", " ", "  ", "'", "'r", "e", "'ve", "\n", "1", "!", "é", "<|endoftext|>"]) for _ in range(rng.randint(0, 25)))
        assert small.encode(text) == whole.encode(text)


def test_decoder_splits_characters():
    library, v = Tokenizer.from_file(BYTE_BPE), vocabulary()
    rng = random.Random(8)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(40)]
        d = bpe.Decoder(v)
        assert "".join(d.push([i]) for i in ids) + d.finish() == library.decode(ids, skip_special_tokens=False)


def test_improper_merges_are_refused():
    import json
    from pathlib import Path

    spec = json.loads(Path(BYTE_BPE).read_text())
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        bpe.Vocabulary(spec)


def test_token_counts(given, awkward, empty):
    from pathlib import Path

    import regex

    scores = token_counts.zipf_scores(Path(RANKS).read_bytes())
    split, memo = regex.compile(bpe.PATTERN), {}

    def plain(piece):
        if piece not in memo:
            best = [(0, 0)]
            for end in range(1, len(piece) + 1):
                start = max(0, end - 128)
                best.append(max((best[s][0] + scores[piece[s:end]], best[s][1] - 1) for s in range(start, end) if piece[s:end] in scores))
            memo[piece] = best[-1][0], -best[-1][1]
        return memo[piece]

    for df in (given.limit(60), awkward):
        want = []
        for d, t in table_of(df):
            found = [plain(p.encode()) for p in split.findall(t or "")]
            want.append((d, len(found), sum(n for _, n in found), sum(s for s, _ in found)))
        assert ordered(tuple(r) for r in token_counts.count_tokens(df, RANKS).collect()) == ordered(want)
    assert token_counts.count_tokens(empty, RANKS).count() == 0
    trie = token_counts.PrefixTrie(scores)
    trie.count(b"sharing")
    before = trie.computed
    trie.count(b"shared")
    assert trie.computed == before + 2  # "shar" is there already


def test_slots_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (1, 2):
            assert sorted(training_order.slots(np.arange(n), n, key).tolist()) == list(range(n))
    assert training_order.slots(np.arange(1000), 1000, 1).tolist() != training_order.slots(np.arange(1000), 1000, 2).tolist()


def test_training_order(spark, given, awkward, empty, tmp_path):
    library = Tokenizer.from_file(BYTE_BPE)
    library.encode_special_tokens = True
    for df in (given.limit(60), awkward):
        records = training_order.materialise(df, RANKS, 50256, length=64, per_shard=32)
        rows = sorted(records.collect(), key=lambda r: r.sequence)
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert [r.slot for r in rows] == training_order.slots(np.arange(len(rows)), len(rows)).tolist()
        stream = np.frombuffer(b"".join(r.record for r in rows), "<u2").tolist()
        want = [tuple(library.encode(t or "", add_special_tokens=False).ids) for _, t in table_of(df)]
        n = sum(len(w) + 1 for w in want)
        assert len(stream) == -(-n // 64) * 64 and set(stream[n:]) <= {50256}
        got, own = [], []
        for i in stream[:n]:
            if i == 50256:
                got.append(tuple(own))
                own = []
            else:
                own.append(i)
        assert ordered(got) == ordered(want)
    folder = str(tmp_path / "shards")
    training_order.write_shards(records, folder)
    training_order.write_shards(records.filter("slot < 5"), folder)  # a repeated task changes nothing
    reader = training_order.ShardReader(folder, 64, 32)
    for r in rows:
        assert next(reader.read(r.slot)).tobytes() == bytes(r.record)
    assert len(list(reader.read(3, 10))) == 10
    assert training_order.materialise(empty, RANKS, 50256).count() == 0


def test_all_ten_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))
