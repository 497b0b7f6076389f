"""Chat formatting: a hidden Markov model over lines recovers the speakers of a transcript, then turns are rendered.

States are the roles. A line is observed by its speaker marker (``User:``, ``Assistant>`` and the like), whether it begins a row,
its length, how it ends, and whether it is a list item or code. Start, transition and emission scores are smoothed log
shares of labelled rows, as integers in millionths, so that results do not depend on the order of sums.

Viterbi over conversations of any length, none of them in one task as a whole: rows are grouped in blocks of ``BLOCK`` turns. Each block gives a small
max-plus matrix (best score from each role before it to each role at its end); a conversation's blocks are
chained with these matrices alone, forward and back; with its two border roles fixed, each block is decoded by itself.

Rendering: a marker at the beginning of a line is removed; lines of one role that follow each other in a row form a segment
``<|role|>\\n`` + text + ``<|end|>\\n``. A conversation is the concatenation of its rows' renderings in order of turns.

Contract: a null text is an empty line; null turns come first; rows of the same conversation and turn are ordered by their text; null
conversations form one conversation; roles that are null or not among ``ROLES`` are not learned from; ties go to the role listed first; without
labelled rows markers still count and lines stay with their speaker; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .tasks import arrow_map

ROLES = ("system", "user", "assistant")
START = len(ROLES)
BLOCK = 256
NEVER = -(1 << 50)
#: Speaker markers and the roles they name.
MARKERS = {
    "system": 0, "sys": 0, "instructions": 0,
    "user": 1, "human": 1, "customer": 1, "question": 1, "q": 1,
    "assistant": 2, "ai": 2, "bot": 2, "agent": 2, "answer": 2, "a": 2,
}
MARKER = re.compile(r"\s*(?:<\|?|\[|\*\*|#+\s*)?(" + "|".join(MARKERS) + r")(?:\|?>|\]|\*\*)?\s*[:>]\s*", re.IGNORECASE)
MARKER_SCORE = 12_000_000  #: that a marker is worth for its role


def observe(line: str, first: bool) -> tuple[int, int, str]:
    """(role named by a marker or -1, length of the marker, what else is seen)."""
    found = MARKER.match(line)
    body = line[found.end() :] if found else line
    n = len(body)
    size = 0 if n == 0 else min(12, n.bit_length())
    last = body.rstrip()[-1:]
    end = "?" if last == "?" else "." if last in ".!" and last else ":" if last == ":" else "-"
    kind = "l" if re.match(r"\s*(?:[-*]|\d+[.)])\s", body) else "c" if body.startswith(("    ", "\t", "```")) else "t"
    return (MARKERS[found[1].lower()] if found else -1), (found.end() if found else 0), f"{'1' if first else '0'}{size}{end}{kind}"


def _untrained_steps() -> list[list[list[int]]]:
    """Inside a row a speaker rather goes on; else nothing is known."""
    inside = [[1_000_000 if a == b else 0 for b in range(len(ROLES))] for a in range(START + 1)]
    return [inside, [[0] * len(ROLES) for _ in range(START + 1)]]


@dataclass
class RoleModel:
    """Scores in millionths: ``step[0]`` inside a row, ``step[1]`` from row to row; rows are from, columns to."""

    step: list[list[list[int]]] = field(default_factory=_untrained_steps)
    emit: dict[str, list[int]] = field(default_factory=dict)
    unseen: list[int] = field(default_factory=lambda: [0] * len(ROLES))

    def scores(self, line: str, first: bool) -> list[int]:
        marker, _, seen = observe(line, first)
        own = list(self.emit.get(seen, self.unseen))
        if marker >= 0:
            own[marker] += MARKER_SCORE
        return own


def _shares(counts: dict, over: list, weight: float) -> dict:
    total = sum(counts.get(k, 0) for k in over) + weight * len(over)
    return {k: round(1e6 * math.log((counts.get(k, 0) + weight) / total)) for k in over}


def _ordered(chats: DataFrame, *more: str) -> DataFrame:
    keys = ("conv_id", "block", "turn", "text")
    return chats.select(*keys, *more).repartition("conv_id", "block").sortWithinPartitions(*keys)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, list[tuple]]]:
    """(key, whether the group ends here, rows) of a stream ordered by conversation and block; a large group comes in parts."""
    own, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = row[:2]
            if own is not None and key != own:
                yield own, True, held
                held = []
            own = key
            held.append(row)
            if len(held) >= 1024:
                yield own, False, held
                held = []
    if own is not None:
        yield own, True, held


def fit(chats: DataFrame) -> RoleModel:
    """Count labelled lines; the table of counts has a row per kind of line and pair of roles, whatever the data."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, str], int] = {}

        def add(kind: str, before: int, seen: str) -> None:
            counts[kind, before, seen] = counts.get((kind, before, seen), 0) + 1

        last: tuple = (None, None)
        for key, _, rows in _groups(batches):
            for row in rows:
                role = ROLES.index(row[4]) if row[4] in ROLES else None
                before = last[1] if last[0] == key else (START if row[5] else None)
                last = (key, role)
                if role is None:
                    continue
                if before is not None:
                    add("next", before, str(role))
                lines = (row[3] or "").split("\n")
                for i, line in enumerate(lines):
                    add("emit", role, observe(line, i == 0)[2])
                    if i:
                        add("same", role, str(role))
        items = sorted(counts.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[j] for k, _ in items], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.string()))] + [pa.array([n for _, n in items], pa.int64())],
            names=["kind", "before", "seen", "n"],
        )

    rows = _ordered(chats, "role", "opens").transform(arrow_map, run, "kind string, before int, seen string, n bigint")
    table: dict[str, dict[int, dict[str, int]]] = {"next": {}, "same": {}, "emit": {}}
    for kind, before, seen, n in rows.groupBy("kind", "before", "seen").agg(F.sum("n")).collect():
        table[kind].setdefault(before, {})[seen] = n
    model = RoleModel()
    if not any(table.values()):
        return model
    roles = [str(r) for r in range(len(ROLES))]
    for i, kind in enumerate(("same", "next")):
        for before in range(START + 1):
            shares = _shares(table[kind].get(before, {}), roles, 0.1)
            model.step[i][before] = [shares[r] for r in roles]
    kinds = sorted({s for c in table["emit"].values() for s in c})
    by_role = [_shares(table["emit"].get(r, {}), [*kinds, ""], 0.5) for r in range(len(ROLES))]
    model.emit = {k: [s[k] for s in by_role] for k in kinds}
    model.unseen = [s[""] for s in by_role]
    return model


def _extend(model: RoleModel, best: list[int], line: str, first: bool) -> tuple[list[int], list[int]]:
    """Best scores of the roles at a line, and the role before it on the way."""
    step, emit = model.step[1 if first else 0], model.scores(line, first)
    out, back = [], []
    for to in range(len(ROLES)):
        score, source = max((best[s] + step[s][to], -s) for s in range(len(best)))
        out.append(score + emit[to])
        back.append(-source)
    return out, back


def block_matrices(chats: DataFrame, model: object) -> DataFrame:
    """``conv_id, block, scores``: for each role before a block (and the start) the best score of each role at its end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start() -> list[list[int]]:
            return [[0 if i == j else NEVER for j in range(START + 1)] for i in range(START + 1)]

        vectors = start()
        for key, ended, rows in _groups(batches):
            for row in rows:
                for i, line in enumerate((row[3] or "").split("\n")):
                    vectors = [_extend(model.value, v, line, i == 0)[0] for v in vectors]
            if ended:
                flat = [x for v in vectors for x in v]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]], kind), pa.array([key[1]], pa.int64()), pa.array([flat], pa.list_(pa.int64()))], names=["conv_id", "block", "scores"]
                )
                vectors = start()

    kind = pa.int64()
    return _ordered(chats).transform(arrow_map, run, "conv_id bigint, block bigint, scores array<bigint>")


def block_borders(matrices: DataFrame) -> DataFrame:
    """``conv_id, block, before, after``: the roles at the borders of each block on the best way.

    A conversation's blocks are chained in one task: 12 numbers for ``BLOCK`` turns.
    """

    def chain(blocks: list[tuple]) -> list[tuple]:
        best, ways = [NEVER] * START + [0], []
        for _, _, flat in blocks:
            step = [flat[i * START : (i + 1) * START] for i in range(START + 1)]
            picks = [max((best[s] + step[s][to], -s) for s in range(len(best))) for to in range(START)]
            ways.append([-s for _, s in picks])
            best = [score for score, _ in picks]
        role = -max((score, -r) for r, score in enumerate(best))[1]
        out = []
        for (conv, block, _), way in zip(reversed(blocks), reversed(ways), strict=True):
            out.append((conv, block, way[role], role))
            role = way[role]
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[i], pa.int64() if i < 2 else pa.int32()) for i in range(4)], names=["conv_id", "block", "before", "after"]
            )

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += chain(held)
                    held = []
                held.append(row)
            yield emit(out)
        if held:
            yield emit(chain(held))

    return matrices.repartition("conv_id").sortWithinPartitions("conv_id", "block").transform(arrow_map, run, "conv_id bigint, block bigint, before int, after int")


def render(lines: list[str], roles: list[int]) -> tuple[str, int]:
    """Segments of one role each, and their number."""
    out, n = [], 0
    for i, (line, role) in enumerate(zip(lines, roles, strict=True)):
        cut = observe(line, i == 0)[1]
        if i == 0 or role != roles[i - 1]:
            out.append(("<|end|>\n" if i else "") + f"<|{ROLES[role]}|>\n")
            n += 1
        out.append(line[cut:] + "\n")
    return "".join(out) + "<|end|>\n", n


def decode_block(model: RoleModel, rows: list[tuple], before: int, after: int) -> list[list[int]]:
    """Roles of each row's lines with the roles at both borders fixed."""
    best = [NEVER] * (START + 1)
    best[before] = 0
    backs, sizes = [], []
    for row in rows:
        lines = (row[3] or "").split("\n")
        sizes.append(len(lines))
        for i, line in enumerate(lines):
            best, back = _extend(model, best, line, i == 0)
            backs.append(back)
    roles, role = [], after
    for back in reversed(backs):
        roles.append(role)
        role = back[role]
    roles.reverse()
    out, at = [], 0
    for n in sizes:
        out.append(roles[at : at + n])
        at += n
    return out


def format_chats(chats: DataFrame, labels: bool = True) -> DataFrame:
    """``conv_id, turn, role_found, n_segments, rendered``: one row per row of ``conv_id, turn, role, text``."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("bigint")
    rows = chats.select(
        F.col("conv_id").cast("bigint"), block.alias("block"), F.col("turn").cast("bigint"), F.col("text"), F.col("role"), _opens().alias("opens")
    )
    model = chats.sparkSession.sparkContext.broadcast(fit(rows) if labels else RoleModel())
    borders = written(block_borders(block_matrices(rows, model)), "borders")
    b = borders.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), "before", "after")
    joined = rows.join(b, rows["conv_id"].eqNullSafe(b["c"]) & (rows["block"] == b["k"]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for key, ended, part in _groups(batches):
            held += part
            if ended:  # a block: at most BLOCK different turns
                found = decode_block(model.value, held, held[0][4], held[0][5])
                rendered = [render((r[3] or "").split("\n"), roles) for r, roles in zip(held, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in held], pa.int64()),
                        pa.array([r[2] for r in held], pa.int64()),
                        pa.array([ROLES[roles[0]] for roles in found], pa.string()),
                        pa.array([n for _, n in rendered], pa.int32()),
                        pa.array([text for text, _ in rendered], pa.string()),
                    ],
                    names=["conv_id", "turn", "role_found", "n_segments", "rendered"],
                )
                held = []

    schema = "conv_id bigint, turn bigint, role_found string, n_segments int, rendered string"
    return _ordered(joined.select("conv_id", "block", "turn", "text", "before", "after"), "before", "after").transform(arrow_map, run, schema)


def _opens() -> Column:
    """Whether a row can open a conversation, for the start scores."""
    return F.coalesce(F.col("turn") == 0, F.lit(False))
