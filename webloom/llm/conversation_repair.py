"""Repair of conversations: the cheapest edits that give each a well-formed sequence of roles, by a generalised LR parse.

A well-formed conversation is empty, or pairs of a user's and an assistant's rows, perhaps behind one system row. A row may be kept, rerole'd, or deleted,
and rows without text may be put in; ``role_grammar`` merges equal stacks by the least (cost, audit).

1. Rows are numbered inside their conversation by ranges (``operators.ranking``), so one long conversation is spread over tasks. Equal turns are put in order of
   role and text, so the result does not depend on the order of the rows.
2. Faults, each row's first: *blank* text, *duplicate* of an earlier role and text (the least rank of each role and text digest), *truncated* text without
   a full stop, question mark or exclamation mark at its end.
3. Blocks of ``BLOCK`` rows are parsed apart: the first of a conversation from the empty stack, others from every stack.
4. The blocks of a conversation are chained in one stream of one narrow row per block, which gives cost and audit, and every block its edits.
5. Rows meet their block's edits again in a sorted stream, and the repaired rows come out. Their digest is made block by block; only
   conversations of several blocks send bytes on, to one stream each, as a digest has to be made in order.

Memory is a block's rows without texts, one text, and an audit (the result's own column: a letter per row). Nothing is collected on the driver.

Contract: null conversations are one conversation; in other columns null stands for one space, but in ``turn``, where nulls come first and count for no
gap; rows that repeat are rows of the conversation (and duplicates); a role other than system, user and assistant is known by its
initial, and is never kept if that is none of theirs; an empty table gives no rows. Other columns are not read. Turns further apart than a long have null gaps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_within
from ..session import written
from .role_grammar import DELETE, INSERT, KEEP, Edits, Grammar, Parser, letters, outputs, parse_part
from .tasks import arrow_map

BLOCK = 512
CHUNK_BYTES = 1 << 20  #: of repaired text sent on at once
BLANKS = "\t\n\x0b\x0c\r "  #: fixed value: what does not make a word
STOPS = ".!?"  #: fixed value: how a whole text ends
GRAMMAR = [("S", ""), ("S", "T"), ("T", "ua"), ("T", "sua"), ("T", "Tua")]
LEGAL = {"su", "ua", "au"}  #: initials of neighbours
ROLES = {"u": "user", "a": "assistant"}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
EMPTY_SHA256 = hashlib.sha256().hexdigest()
SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PARTS = "array<struct<before:int,after:int,cost:bigint,audit:string>>"
CUTS = "array<struct<block:bigint,before:bigint,edits:string>>"


def parser() -> Parser:
    return Parser(Grammar(GRAMMAR), Edits(roles="ua", inserts="ua"))


def group_of(key: str) -> Column:
    """A conversation's name; null has one of its own, as no number is a space."""
    return F.coalesce(F.col(key).cast("string"), F.lit(" "))


def numbered(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``group, turn, role, text, rank, block``: rows in order of turn, numbered from 1 in each conversation."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    named = rows.select(group_of(key).alias("group"), F.col(turn).cast("bigint").alias("turn"), *plain).withColumn("salt", F.monotonically_increasing_id())
    ranked = rank_within(named, "group", ["turn", "role", "text", "salt"]).drop("salt")
    return ranked.withColumn("block", F.expr(f"(rank - 1) div {BLOCK}"))


def faults(ranked: DataFrame) -> DataFrame:
    """``group, block, rank, initial, fault``."""
    said = F.rtrim("text", F.lit(BLANKS))
    own = F.when(said == "", BLANK).when(~F.right(said, F.lit(1)).isin(*STOPS), TRUNCATED).otherwise(SOUND)
    narrow = ranked.select("group", "block", "rank", F.left("role", F.lit(1)).alias("initial"), own.alias("own"))
    earliest = ranked.groupBy("group", "role", F.sha2("text", 256).alias("said")).agg(F.min("rank").alias("rank"))
    joined = narrow.join(earliest.select("group", "rank", F.lit(True).alias("new")), ["group", "rank"], "left")  # a rank is one row: no key is hot
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("new").isNull(), DUPLICATE).otherwise(F.col("own"))
    return joined.select("group", "block", "rank", "initial", fault.alias("fault"))


def parsed_blocks(judged: DataFrame) -> DataFrame:
    """``group, block, n, first, last, illegal, parts``: each block's rows, its outer initials, and its parses from each stack."""
    rows = judged.groupBy("group", "block").agg(F.sort_array(F.collect_list(F.struct("rank", "initial", "fault"))).alias("rows"))  # at most BLOCK

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser()
        for batch in batches:
            out = []
            for group, block, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                these = [(r["initial"], r["fault"]) for r in cell.as_py()]
                illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(these, these[1:]))
                stacks = range(len(own.grammar.stacks)) if block else [0]
                found = parse_part(own, [(i, f in (BLANK, DUPLICATE), f == TRUNCATED) for i, f in these], stacks)
                parts = [{"before": a, "after": b, "cost": c, "audit": s} for a, ends in found.items() for b, (c, s) in ends.items()]
                out.append({"group": group, "block": block, "n": len(these), "first": these[0][0], "last": these[-1][0], "illegal": illegal, "parts": parts})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(batch.schema.field(0).type))

    def _arrow(text: pa.DataType) -> pa.Schema:
        part = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", text)])
        return pa.schema([("group", text), ("block", pa.int64()), ("n", pa.int64()), ("first", text), ("last", text), ("illegal", pa.int64()), ("parts", pa.list_(part))])

    return rows.transform(arrow_map, run, f"group string, block bigint, n bigint, first string, last string, illegal bigint, parts {PARTS}")


def chained(blocks: DataFrame) -> DataFrame:
    """``group, illegal, cost, odd, n_blocks, cuts``: each conversation's least parse, with the edits of each block and the rows put out before it."""

    def finished(own: Parser, group: str, live: dict, numbers: list[int], illegal: int) -> dict:
        cost, _, more, link = own.best(live)
        found = letters(link)
        edits = found[: len(numbers)]
        edits[-1] += INSERT * more
        cuts, before = [], 0
        for block, audit in zip(numbers, edits, strict=True):
            cuts.append({"block": block, "before": before, "edits": audit})
            before += len(audit) - audit.count(DELETE)
        return {"group": group, "illegal": illegal, "cost": cost, "odd": before % 2 == 1, "n_blocks": len(numbers), "cuts": cuts}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser()
        group, live, numbers, illegal, last = None, {}, [], 0, ""
        kind = pa.string()
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for i in range(batch.num_rows):
                name, block, first, end, inner, parts = (batch.column(c)[i].as_py() for c in ("group", "block", "first", "last", "illegal", "parts"))
                if name != group:
                    if numbers:
                        out.append(finished(own, group, live, numbers, illegal))
                    group, live, numbers, illegal = name, own.start(), [], 0
                elif last + first not in LEGAL:
                    illegal += 1
                part: dict[int, dict[int, tuple[int, str]]] = {}
                for p in parts:
                    part.setdefault(p["before"], {})[p["after"]] = (p["cost"], p["audit"])
                live = own.joined(live, part)
                numbers.append(block)
                illegal, last = illegal + inner, end
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(kind))
        if numbers:
            yield pa.RecordBatch.from_pylist([finished(own, group, live, numbers, illegal)], schema=_arrow(kind))

    def _arrow(text: pa.DataType) -> pa.Schema:
        cut = pa.struct([("block", pa.int64()), ("before", pa.int64()), ("edits", text)])
        return pa.schema([("group", text), ("illegal", pa.int64()), ("cost", pa.int64()), ("odd", pa.bool_()), ("n_blocks", pa.int64()), ("cuts", pa.list_(cut))])

    ordered = blocks.repartition("group").sortWithinPartitions("group", "block")
    return ordered.transform(arrow_map, run, f"group string, illegal bigint, cost bigint, odd boolean, n_blocks bigint, cuts {CUTS}")


def repaired(ranked: DataFrame, chains: DataFrame) -> DataFrame:
    """``group, block, n_blocks, position, role, text, edit``: the rows of the repaired conversations, by block and position in each task."""
    cuts = chains.select("group", "odd", "n_blocks", F.explode("cuts").alias("c")).select("group", "c.block", "odd", "n_blocks", "c.before", "c.edits")
    plans = cuts.select("group", "block", F.lit(0).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "odd", "n_blocks", "before", "edits")
    both = ranked.select("group", "block", "rank", "role", "text").unionByName(plans, allowMissingColumns=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Iterator[tuple[str, str | None]] = iter(())
        where: tuple = ()

        def put_in(at: list) -> Iterator[dict]:
            """The rows put in before the next row, or at the end of the block; ``at`` takes the next row's edit."""
            nonlocal position
            for letter, initial in plan:
                if letter != INSERT:
                    at.append((letter, initial))
                    return
                position += 1
                yield {**where, "position": position, "role": ROLES[initial], "text": "", "edit": INSERT}

        position = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                out = []
                for r in batch.slice(lo, BLOCK).to_pylist():
                    if r["rank"] == 0:
                        out += put_in([])  # what is left of the block before
                        where = {"group": r["group"], "block": r["block"], "n_blocks": r["n_blocks"]}
                        plan, position = outputs(r["edits"], r["odd"], r["before"]), r["before"]
                        continue
                    at: list[tuple[str, str | None]] = []
                    out += put_in(at)
                    letter, initial = at[0]
                    if letter != DELETE:
                        position += 1
                        out.append({**where, "position": position, "role": r["role"] if letter == KEEP else ROLES[initial], "text": r["text"], "edit": letter})
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(batch.schema.field(0).type))
        if where:
            yield pa.RecordBatch.from_pylist(list(put_in([])), schema=_arrow(pa.string()))

    def _arrow(text: pa.DataType) -> pa.Schema:
        return pa.schema([("group", text), ("block", pa.int64()), ("n_blocks", pa.int64()), ("position", pa.int64()), ("role", text), ("text", text), ("edit", text)])

    ordered = both.repartition("group", "block").sortWithinPartitions("group", "block", "rank")
    return ordered.transform(arrow_map, run, "group string, block bigint, n_blocks bigint, position bigint, role string, text string, edit string")


def digests(rows: DataFrame) -> DataFrame:
    """``group, repaired_sha256`` of repaired rows as they come: ``role:text``, joined by line feeds."""

    def by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, where, at = [], 0, None, 0

        def sent() -> pa.RecordBatch:
            group, block, n_blocks = where
            data = b"".join(held)
            return _chunk(group, block, at, None if n_blocks == 1 and whole else data, hashlib.sha256(data).hexdigest() if n_blocks == 1 and whole else None)

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                for r in batch.slice(lo, BLOCK).to_pylist():
                    here = (r["group"], r["block"], r["n_blocks"])
                    if here != where:
                        if held:
                            whole = at == 0
                            yield sent()
                        held, size, where, at = [], 0, here, 0
                    line = f"{r['role']}:{r['text']}".encode()
                    held.append(line if r["position"] == 1 else b"\n" + line)
                    size += len(held[-1])
                    if size >= CHUNK_BYTES:
                        whole = False
                        yield sent()
                        held, size, at = [], 0, at + 1
        if held:
            whole = at == 0
            yield sent()

    def _chunk(group, block, at, data, sha) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((group, block, at, data, sha), kinds, strict=True)], names=["group", "block", "at", "data", "sha"])

    def in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            done = []
            for name, data, sha in zip(batch.column("group").to_pylist(), batch.column("data"), batch.column("sha").to_pylist(), strict=True):
                if name != group:
                    if state is not None:
                        done.append((group, state.hexdigest()))
                    group, state = name, None
                if sha is not None:
                    done.append((name, sha))
                else:
                    state = state or hashlib.sha256()
                    state.update(data.as_py())
            yield _pairs(done)
        if state is not None:
            yield _pairs([(group, state.hexdigest())])

    def _pairs(done: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["group", "repaired_sha256"])

    chunks = rows.transform(arrow_map, by_block, "group string, block bigint, at bigint, data binary, sha string")
    return chunks.repartition("group").sortWithinPartitions("group", "block", "at").transform(arrow_map, in_order, "group string, repaired_sha256 string")


class Repair:
    """The repair of some conversations; tables are written once, when made."""

    def __init__(self, rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.ranked = numbered(rows, key, turn, role, text)
        self.judged = written(faults(self.ranked), "faults")
        self.chains = written(chained(parsed_blocks(self.judged)), "chains")

    def rows(self) -> DataFrame:
        """``group, block, n_blocks, position, role, text, edit``; ``group`` is the conversation as text."""
        return repaired(self.ranked, self.chains)

    def summary(self) -> DataFrame:
        """``group, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation with rows."""
        turns = self.ranked.groupBy("group").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("turns"))
        gaps = F.when(F.col("turns") == 0, 0).otherwise(F.expr("try_subtract(try_add(try_subtract(high, low), 1L), turns)")).cast("bigint")
        counts = [F.count(F.when(F.col("fault") == f, 1)).alias(n) for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))]
        found = self.chains.select("group", "illegal", "cost", F.expr("array_join(transform(cuts, c -> c.edits), '')").alias("audit"))
        joined = found.join(turns.select("group", gaps.alias("gaps")), "group").join(self.judged.groupBy("group").agg(*counts), "group")
        joined = joined.join(digests(self.rows()), "group", "left")  # a conversation with no row left has no digest there
        return joined.select("group", *SUMMARY, "audit", F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))


def summary_of(conversations: DataFrame, rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each conversation of a table, for what is left of its rows in another."""
    names = conversations.select(key).distinct().withColumn("group", group_of(key))
    found = names.join(Repair(rows, key).summary(), "group", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) if c != "gaps" else F.when(F.col("cost").isNull(), 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in SUMMARY]
    return found.select(key, *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
