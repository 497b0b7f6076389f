"""Repair of conversations against every edit sequence, and against plain dynamic programming."""

import random
import zlib
from collections import defaultdict

import pytest

from webloom.llm import conversation_repair, role_grammar
from webloom.llm.more_queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
COLUMNS = "conv_id long, turn long, role string, text string, position string, edit string"


def test_grammar():
    own = conversation_repair.parser().grammar
    for word, good in {"": 1, "s": 0, "ua": 1, "sua": 1, "suaua": 1, "us": 0, "au": 0, "uaua": 1, "uas": 0, "ss": 0, "uau": 0}.items():
        at = 0
        for t in word:
            at = own.moves[at].get(t) if at is not None else None
        assert (at is not None and own.accepting[at]) == bool(good), word
    with pytest.raises(ValueError, match="bounded"):
        role_grammar.Grammar([("S", "uSa"), ("S", "")])


def test_every_edit_sequence():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "x", " "]), rng.choice(["a.", "b?", "c", "", "d!"])) for _ in range(rng.randrange(4))]
        assert brute.repair(rows)[:2] == brute.repair_by_trying(rows)


def some_conversations(rng):
    texts = ["one.", "two?", "three", "", " \t", "four!\n", "five. \x0b", None, "six", "a much longer line that ends.", "é…"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "User", "uncle"]
    rows = []
    for conv in [None, *range(25)]:
        n = rng.choice([1, 2, 3, 8, 17, 60])
        for k in range(n):
            odd = rng.random() < 0.15
            fair = ("user", "assistant")[k % 2]
            turn = None if rng.random() < 0.05 else rng.choice([k, k, k, k + 1, 2 * k])
            rows.append((conv, turn, rng.choice(roles) if odd else fair, rng.choice(texts) if rng.random() < 0.4 else f"text {conv} {k}.", "p", "e"))
    rows += rng.sample(rows, 20)  # rows that repeat as a whole
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 4, 512])
def test_repair_equals_plain(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows = some_conversations(random.Random(block))
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    own = defaultdict(list)
    for c, t, r, x, _, _ in rows:
        own[c].append((t, r, x))
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.summary_of(df, df).collect()}
    assert got == {c: brute.conversation(these) for c, these in own.items()}
    assert conversation_repair.summary_of(df.limit(0), df.limit(0)).count() == 0


def test_a_long_conversation(spark, monkeypatch):
    """One conversation of many blocks with long texts: chunks of its digest are sent on."""
    monkeypatch.setattr(conversation_repair, "BLOCK", 16)
    rng = random.Random(6)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), f"{k} " + "y" * rng.choice([5, 400_000]) + rng.choice([".", ""]), "", "") for k in range(60)]
    got = conversation_repair.summary_of(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(rows, COLUMNS)).collect()
    assert [tuple(r)[1:] for r in got] == [brute.conversation([r[1:4] for r in rows])]


def test_repaired_rows(spark):
    rows = [(5, 0, "user", "a."), (5, 1, "user", "b"), (5, 2, "system", "c."), (6, 0, "system", "s."), (7, 0, "user", ""), (8, 3, "assistant", "t.")]
    repair = conversation_repair.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((r.group, r.position, r.role, r.text, r.edit) for r in repair.rows().collect())
    assert got == [("5", 1, "user", "a.", "K"), ("5", 2, "assistant", "c.", "R"), ("8", 1, "user", "", "I"), ("8", 2, "assistant", "t.", "K")]
    audits = {r.group: (r.cost, r.audit) for r in repair.chains.selectExpr("group", "cost", "array_join(transform(cuts, c -> c.edits), '') as audit").collect()}
    assert audits == {str(c): brute.repair([(r[2], r[3]) for r in rows if r[0] == c])[:2] for c in (5, 6, 7, 8)}


def test_query(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    rows = defaultdict(list)
    for r in given:
        fate = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if fate == 1 else "".join(c for c in r.text if c not in ".!?") if fate == 2 else r.text
        rows[r.conv_id] += [(r.turn, "user" if fate == 4 else r.role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, SF).collect()}
    assert got == {c: brute.conversation(rows[c]) for c in {r.conv_id for r in given}}
