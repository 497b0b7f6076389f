"""Paths: winners, conflicts and the asset manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ranking import rank_within

BEHIND = "cast(X'FF' as string)"  #: sorts behind every text, as no text in UTF-8 has this byte
PAGES_A_ROW = 32_768  #: page numbers in a row of a posting list: offsets are of two bytes


def path_winner(files: DataFrame, keep: str = "last") -> DataFrame:
    """One row per (site, path): the first or the last writer by ``rank`` (ties by URL).

    An aggregate and not a window: it is combined before the exchange, so a path with many writers is no hot spot.
    """
    pick = F.min if keep == "first" else F.max
    rest = [c for c in files.columns if c not in ("site", "path", "rank", "url")]
    best = pick(F.struct("rank", "url", *rest)).alias("w")
    return files.groupBy("site", "path").agg(best).select("site", "path", "w.*")


def path_conflicts(files: DataFrame) -> DataFrame:
    """Where files would overwrite or block one another. ``files(site, path, url)``.

    ``same_path``: several URLs map to one path (``n`` URLs). ``file_is_folder``: the path is a file and also a
    folder of other files (``n`` of them).

    In the order of their steps the files below a path follow it without a gap. Each path is a mark where it opens and one where it closes,
    behind everything below it; what lies between the two ranks is two marks for each file below. So there are two rows a file, however deep it
    lies, and no folder is a hot key.
    """
    urls = files.select("site", "path", "url").distinct()
    paths = urls.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n_urls"), F.min("url").alias("first_url"))
    paths = written(paths.filter(F.col("path").isNotNull()), "paths")
    same = paths.filter(F.col("n_urls") > 1).select(
        "site", "path", F.lit("same_path").alias("conflict"), F.col("n_urls").alias("n"), "first_url"
    )
    steps = F.split("path", "/")
    marks = paths.select("site", "path", "first_url", F.explode(F.array(steps, F.concat(steps, F.array(F.expr(BEHIND))))).alias("mark"))
    between = F.max("rank") - F.min("rank") - 1
    blocked = (
        rank_within(marks, "site", ["mark"])
        .groupBy("site", "path", "first_url")
        .agg((between / 2).cast("bigint").alias("n"))
        .filter(F.col("n") > 0)
        .select("site", "path", F.lit("file_is_folder").alias("conflict"), "n", "first_url")
    )
    return same.unionByName(blocked)


def asset_manifest(assets: DataFrame) -> DataFrame:
    """Distinct saved assets with the number of references and of referencing pages."""
    per_page = assets.groupBy("site", "asset_url", "local_path", "kind", "page_id").agg(
        F.count(F.lit(1)).alias("refs")
    )
    return per_page.groupBy("site", "asset_url", F.col("local_path").alias("path"), "kind").agg(
        F.sum("refs").alias("n_refs"), F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page")
    )


def asset_pages(assets: DataFrame) -> DataFrame:
    """Which pages refer to each saved asset: ``(site, asset_url, block, n_pages, pages)``, posting lists of page numbers.

    ``pages`` are the distinct numbers from ``block * PAGES_A_ROW`` on, ascending, as offsets of two bytes. A list is split by blocks, so an asset on
    every page is many rows of at most 64 KB and no hot key; offsets are merged before the exchange. References from
    pages without a number are in no list.
    """
    placed = assets.filter(F.col("page_id").isNotNull()).select(
        "site",
        "asset_url",
        F.shiftright("page_id", 15).alias("block"),
        F.pmod("page_id", F.lit(PAGES_A_ROW)).cast("smallint").alias("offset"),
    )
    lists = placed.groupBy("site", "asset_url", "block").agg(F.sort_array(F.collect_set("offset")).alias("pages"))
    return lists.select("site", "asset_url", "block", F.size("pages").cast("bigint").alias("n_pages"), "pages")


def pages_of(postings: DataFrame) -> DataFrame:
    """``(site, asset_url, page_id)`` of posting lists. Filter the lists first."""
    number = F.col("block") * PAGES_A_ROW + F.col("offset")
    return postings.select("site", "asset_url", "block", F.explode_outer("pages").alias("offset")).select(
        "site", "asset_url", number.alias("page_id")
    )
