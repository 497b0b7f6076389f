"""URL filters: path rules, and exact membership in a list of sites by a cascade of Bloom filters.

Level 0 encodes the listed keys. Level 1 encodes those keys of the universe (all keys of the corpus) that are not listed
but pass level 0, level 2 the listed keys that pass level 1, and so on, until a level lets nothing wrong pass. A
key's answer is the parity of the first level that it fails, which is exact for every key of the universe and every listed key. The levels
are binary constants of the query, so rows are judged by expressions alone: no join, no Python.

The constants are bounded: at most ``MAX_LISTED`` keys are put in a cascade, beyond that `member` joins with the list
instead (Spark chooses the strategy). Levels above 0 are smaller than their predecessors.

Contract: a null url or one without ``://`` has an empty host and path, fits no rule and has the empty key; an empty list
blocks nothing; repeated rows are judged alike; an empty table gives no rows; columns of the input but ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

MAX_LISTED = 1_000_000
BITS_PER_BYTE = 6  #: of a constant; such bytes are ASCII characters


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.instr(url, "://") > 0, lower).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def site_of(host: Column) -> Column:
    """The last three labels of a host, or all if it has fewer."""
    return F.coalesce(F.nullif(F.regexp_extract(host, "[^.]+[.][^.]+[.][^.]+$", 0), F.lit("")), host)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def first_fit(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    return F.coalesce(*[F.when(r.fits(host, path), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))


@dataclass(frozen=True)
class Bloom:
    level: int
    bits: int
    hashes: int
    constant: bytes

    def passes(self, key: Column) -> Column:
        held = F.expr(f"X'{self.constant.hex()}'")
        found = F.lit(True)
        for place in slots(key, self.level, self.bits, self.hashes):
            code = F.ascii(F.substring(held, F.floor(place / BITS_PER_BYTE).cast("int") + 1, 1).cast("string")) - 48
            found = found & (F.getbit(code, (place % BITS_PER_BYTE).cast("int")) == 1)
        return found


def slots(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(bits)) for i in range(hashes)]


def build(keys: DataFrame, level: int, rate: float) -> Bloom:
    """A filter of the keys with about the given rate of false positives; at most one row per byte of the filter comes to the driver."""
    n = max(1, keys.count())
    bits = max(64, math.ceil(n * math.log2(1 / rate) * 1.4427))
    hashes = max(1, round(math.log2(1 / rate)))
    place = F.explode(F.array(*slots(F.col("key"), level, bits, hashes))).alias("place")
    bit = F.pow(F.lit(2), F.col("place") % BITS_PER_BYTE).cast("int")
    codes = keys.select(place).groupBy(F.floor(F.col("place") / BITS_PER_BYTE).alias("byte")).agg(F.bit_or(bit).alias("code"))
    held = bytearray(b"0" * (bits // BITS_PER_BYTE + 1))
    for byte, code in codes.collect():
        held[byte] = 48 + code
    return Bloom(level, bits, hashes, bytes(held))


def cascade(listed: DataFrame, universe: DataFrame) -> list[Bloom]:
    """Filters for the listed keys over the universe; both have a column ``key``, without repeats."""
    listed = written(listed.select("key").distinct(), "listed")
    others = written(universe.select("key").join(listed, "key", "left_anti"), "others")
    n, m = listed.count(), others.count()
    if n == 0:
        return []
    inside, outside, levels = listed, others, []
    rate = min(0.5, max(2**-16, n / max(m, 1) / math.sqrt(2)))
    while True:
        bloom = build(inside, len(levels), rate)
        levels.append(bloom)
        wrong = written(outside.filter(bloom.passes(F.col("key"))), "passed")
        if wrong.isEmpty():
            return levels
        inside, outside, rate = wrong, inside, 0.5


def listed_by(levels: Sequence[Bloom], key: Column) -> Column:
    """Whether a key is listed: the parity of the first level that it does not pass."""
    answer = F.lit(len(levels) % 2 == 1)
    for bloom in reversed(levels):
        answer = F.when(bloom.passes(key), answer).otherwise(F.lit(bloom.level % 2 == 1))
    return answer


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, max_listed: int = MAX_LISTED) -> DataFrame:
    """``page_id, host, path, rule, verdict, site, listed``: the longest rule's verdict, else block for a listed site."""
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("site", site_of(F.col("host")))
    if listed.count() > max_listed:
        marks = listed.select(F.col("key").alias("site")).distinct().withColumn("listed", F.lit(True))
        marked = parts.join(marks, "site", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        universe = parts.select(F.col("site").alias("key")).distinct()
        marked = parts.withColumn("listed", listed_by(cascade(listed, universe), F.col("site")))
    host, path = F.col("host"), F.col("path")
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select(
        "page_id",
        "host",
        "path",
        first_fit(rules, host, path, lambda r: r.name).alias("rule"),
        F.coalesce(first_fit(rules, host, path, lambda r: r.verdict), by_list).alias("verdict"),
        "site",
        "listed",
    )
