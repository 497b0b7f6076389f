"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    words = SPACED.findall(lower(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components(texts: dict[int, str | None], n: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, component)."""
    sets = {d: shingles(t, n) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    holders: dict[tuple, list[int]] = {}
    for d in sorted(sets):
        shared = Counter(e for s in sets[d] for e in holders.get(s, ()))
        for e, both in shared.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, spans, hash of the rest) of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        kept = bytes(b for b, m in zip(t, mark) if not m)
        out.append((len(t), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def leaks(texts: list[str | None], items: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str, bool]]:
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        words = ALNUM.findall(lower(text))
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i : i + 10]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        words, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                key = tuple(words[i : i + n])
                if key in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def base_rules(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = SPACED.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered: set[int] = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def runs(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by trying every period at every place."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


WHOLE = re.compile("(s?(ua)+)?")


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """Each row's first fault."""
    out, seen = [], set()
    for role, text in rows:
        said = text.rstrip("\t\n\x0b\x0c\r ")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _choices(row: tuple[str, str], fault: str):
    """(letter, cost, role) of what may be done with a row."""
    yield "D", 3, None
    if fault not in ("blank", "duplicate"):
        extra = fault == "truncated"
        yield "K", extra, row[0]
        for role in ("user", "assistant"):
            yield "R", 2 + extra, role


def repair(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """(cost, audit, digest) by dynamic programming over strings; the state is what the last role allows."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def inserted(found):
        for _ in range(4):
            for state, (cost, audit, out) in list(found.items()):
                for role in ("user", "assistant"):
                    to = follow.get((state, role[0]))
                    if to and (to not in found or (cost + 2, audit + "I") < found[to][:2]):
                        found[to] = (cost + 2, audit + "I", (*out, f"{role}:"))
        return found

    for row, fault in zip(rows, faults(rows), strict=True):
        after = {}
        for state, (cost, audit, out) in inserted(best).items():
            for letter, price, role in _choices(row, fault):
                to = state if role is None else follow.get((state, role[:1]))
                new = (cost + price, audit + letter, out if role is None else (*out, f"{role}:{row[1]}"))
                if to is not None and (to not in after or new[:2] < after[to][:2]):
                    after[to] = new
        best = after
    found = inserted(best)
    cost, audit, out = min((found[s] for s in ("", "a") if s in found), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def repair_by_trying(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """The same for very few rows: every choice for each row, up to two inserts in each gap."""
    gaps = ["", "u", "a", "ua", "au"]
    found = [(0, "", "")]  # cost, audit, initials
    for row, fault in zip(rows, faults(rows), strict=True):
        found = [
            (cost + 2 * len(gap) + price, audit + "I" * len(gap) + letter, initials + gap + (role or "")[:1])
            for cost, audit, initials in found for gap in gaps for letter, price, role in _choices(row, fault)
        ]
    found = [(cost + 2 * len(gap), audit + "I" * len(gap), initials + gap) for cost, audit, initials in found for gap in gaps]
    return min((cost, audit) for cost, audit, initials in found if WHOLE.fullmatch(initials))


def conversation(rows: list[tuple[int | None, str | None, str | None]]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of ``(turn, role, text)`` rows."""
    plain = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    plain.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in plain if t is not None}
    said = [(r, x) for _, r, x in plain]
    kinds = faults(said)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, *repair(said))
