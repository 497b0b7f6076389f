"""A weighted generalised LR parser over short alphabets, as steps that can be cut anywhere.

``Grammar`` builds the LR(0) automaton of some productions. What a graph-structured stack can hold, read from the bottom, is one *stack* of
automaton states per way through it; for grammars whose stacks stay bounded (ours are regular: left recursion only) all stacks and the
moves between them are found once. A parse then is a map from live stacks to the least (cost, audit), where equal stacks have been merged.

*Audits without strings.* Audits are compared as strings but only ever grow at their end. Every edit has a cost that its letter and row fix,
and inserting costs something, so of two audits of the same rows and the same cost none is a proper prefix of the other. An audit is kept as
(rank of its part up to the last row's letter, number of inserts since): ranks are made anew after each row. The letters themselves are
on a chain of links, read once at the end. Memory is linear in the rows of a parse, time too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
MAX_STACKS = 64  #: of a grammar

#: live stack: (cost, rank of the audit up to the last row, inserts since, link)
Live = dict[int, tuple[int, int, int, "Link"]]
Link = tuple  # (link before, letters) or ()


class Grammar:
    """An LR(0) automaton with all its stacks; productions are (left, right) of one-character symbols, the first is the start."""

    def __init__(self, productions: list[tuple[str, str]]):
        self.productions = productions
        self.symbols = {left for left, _ in productions}
        self.states: list[frozenset[tuple[int, int]]] = []
        self.index: dict[frozenset, int] = {}
        start = self._state({(k, 0) for k, (left, _) in enumerate(productions) if left == productions[0][0]})
        self.stacks: list[tuple[int, ...]] = [(start,)]
        self.moves: list[dict[str, int]] = []  # stack, terminal -> stack
        terminals = sorted({s for _, right in productions for s in right} - self.symbols)
        for stack in self.stacks:  # grows while it is read
            moves = {}
            for t in terminals:
                shifted = self._goto(stack[-1], t)
                if shifted is not None:
                    reduced = self._reduce((*stack, shifted))
                    if reduced not in self.stacks:
                        self.stacks.append(reduced)
                    moves[t] = self.stacks.index(reduced)
            self.moves.append(moves)
            if len(self.stacks) > MAX_STACKS:
                raise ValueError("the stacks of this grammar are not bounded")
        self.accepting = [self._accepts(stack) for stack in self.stacks]

    def _state(self, kernel: set[tuple[int, int]]) -> int:
        items, todo = set(kernel), list(kernel)
        while todo:
            k, dot = todo.pop()
            right = self.productions[k][1]
            for j, (left, _) in enumerate(self.productions):
                if dot < len(right) and right[dot] == left and (j, 0) not in items:
                    items.add((j, 0))
                    todo.append((j, 0))
        key = frozenset(items)
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
        return self.index[key]

    def _goto(self, state: int, symbol: str) -> int | None:
        kernel = {(k, dot + 1) for k, dot in self.states[state] if self.productions[k][1][dot : dot + 1] == symbol}
        return self._state(kernel) if kernel else None

    def _complete(self, state: int) -> list[int]:
        return [k for k, dot in self.states[state] if dot == len(self.productions[k][1])]

    def _reduce(self, stack: tuple[int, ...]) -> tuple[int, ...]:
        """All reductions that need no decision: a state with one finished production and nothing else."""
        while len(self.states[stack[-1]]) == 1 and (done := self._complete(stack[-1])):
            left, right = self.productions[done[0]]
            below = stack[: len(stack) - len(right)]
            after = self._goto(below[-1], left)
            if after is None:
                break
            stack = (*below, after)
        return stack

    def _accepts(self, stack: tuple[int, ...]) -> bool:
        """Whether some reductions lead to the start symbol with nothing else on the stack."""
        for k in self._complete(stack[-1]):
            left, right = self.productions[k]
            below = stack[: len(stack) - len(right)]
            if len(below) == 1 and left == self.productions[0][0]:
                return True
            after = self._goto(below[-1], left)
            if after is not None and self._accepts((*below, after)):
                return True
        return False


@dataclass(frozen=True)
class Edits:
    """What may be done to a row, and what it costs."""

    roles: str  #: initials a row may be given
    inserts: str  #: initials of rows that may be put in
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1  #: of a kept or reroled row that is cut off


class Parser:
    def __init__(self, grammar: Grammar, edits: Edits):
        if min(edits.insert, edits.delete, edits.rerole) < 1:
            raise ValueError("edits must cost something")
        self.grammar, self.edits = grammar, edits

    def start(self, stack: int = 0) -> Live:
        return {stack: (0, 0, 0, ())}

    def inserted(self, live: Live) -> Live:
        """With rows put in wherever that is cheaper."""
        out, todo = dict(live), list(live)
        while todo:
            at = todo.pop()
            cost, rank, more, link = out[at]
            for t in self.edits.inserts:
                to = self.grammar.moves[at].get(t)
                found = (cost + self.edits.insert, rank, more + 1, (link, INSERT))
                if to is not None and (to not in out or found[:3] < out[to][:3]):
                    out[to] = found
                    todo.append(to)
        return out

    def row(self, live: Live, initial: str, must_go: bool, truncated: bool) -> Live:
        """After one more row."""
        extra = self.edits.truncated if truncated else 0
        best: dict[int, tuple[int, tuple[int, str], Link]] = {}

        def offer(to: int | None, cost: int, rank: int, letters: str, link: Link) -> None:
            if to is not None and (to not in best or (cost, (rank, letters)) < best[to][:2]):
                best[to] = (cost, (rank, letters), link)

        for at, (cost, rank, more, link) in self.inserted(live).items():
            ahead = INSERT * more
            offer(at, cost + self.edits.delete, rank, ahead + DELETE, link)
            if not must_go:
                moves = self.grammar.moves[at]
                offer(moves.get(initial), cost + extra, rank, ahead + KEEP, link)
                for t in self.edits.roles:
                    if t != initial:
                        offer(moves.get(t), cost + self.edits.rerole + extra, rank, ahead + REROLE, link)
        ranks = {key: r for r, key in enumerate(sorted({key for _, key, _ in best.values()}))}
        return {to: (cost, ranks[key], 0, (link, key[1][-1])) for to, (cost, key, link) in best.items()}

    def joined(self, live: Live, part: dict[int, dict[int, tuple[int, str]]]) -> Live:
        """After a part that was parsed from every stack on its own and ends with a row: stack before -> stack after -> (cost, audit)."""
        best: dict[int, tuple[int, tuple[int, str], Link, str]] = {}
        for at, (cost, rank, _, link) in live.items():
            for to, (own, audit) in part[at].items():
                found = (cost + own, (rank, audit))
                if to not in best or found < best[to][:2]:
                    best[to] = (*found, link, audit)
        ranks = {key: r for r, key in enumerate(sorted({key for _, key, _, _ in best.values()}))}
        return {to: (cost, ranks[key], 0, (link, audit)) for to, (cost, key, link, audit) in best.items()}

    def best(self, live: Live) -> tuple[int, int, int, Link]:
        """The least accepted parse."""
        return min((v for at, v in self.inserted(live).items() if self.grammar.accepting[at]), key=lambda v: v[:3])


def letters(link: Link) -> list[str]:
    """What the links of a chain hold, in order."""
    out = []
    while link:
        link, part = link
        out.append(part)
    out.reverse()
    return out


def parse_part(parser: Parser, rows: Iterable[tuple[str, bool, bool]], stacks: Iterable[int]) -> dict[int, dict[int, tuple[int, str]]]:
    """stack before -> stack after -> (cost, audit) of some rows ``(initial, must go, truncated)``; inserts behind the last row are left to what follows."""
    rows = list(rows)
    out = {}
    for stack in stacks:
        live = parser.start(stack)
        for row in rows:
            live = parser.row(live, *row)
        out[stack] = {to: (cost, "".join(letters(link))) for to, (cost, _, _, link) in live.items()}
    return out


def outputs(audit: str, odd: bool, before: int = 0) -> Iterator[tuple[str, str | None]]:
    """(letter, initial of the row it leaves) of each edit; initials alternate, the first of an odd number is the row's own (None)."""
    at = before
    for letter in audit:
        if letter == DELETE:
            yield letter, None
            continue
        yield letter, ("s" if at == 0 else "au"[at % 2]) if odd else "ua"[at % 2]
        at += 1
