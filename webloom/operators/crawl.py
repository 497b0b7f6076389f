"""Bounded breadth-first reachability over the link graph, many sites at once.

One Spark job set per level, all data in executors and in the shared folder. Each level is a written table: lost
executors cost a re-read and not a re-crawl, and its true size lets Catalyst broadcast a small frontier and shuffle
a large one. The driver sees one row count per level.

What is visited is known by numbers. Linked URLs are numbered once, densely; the visited ones are bits of rows ``(site, chunk, bits)``, one
for 32,768 numbers, and only the numbers of the latest levels (some ``FOLD_ROWS`` at most) are looked up as rows. So a level moves
its frontier and what it reaches, whatever was visited before, and reads an eighth of a byte for each visited URL.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import nullable, scratch_path, written
from .ranking import rank_within

REBASE = 16
FOLD_ROWS = 1_000_000  #: numbers kept as rows; more are folded into bits
CHUNK = 32_768  #: numbers in a row of bits, as Spark's bitmap functions have it


def seed_level(seeds: DataFrame) -> DataFrame:
    """One row per (site, url) with its earliest place in the queue."""
    return seeds.groupBy("site", "url").agg(F.min("order").alias("order"))


def link_edges(links: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``edges(src, dst, pos)``: first position of each distinct link.

    ``index`` keeps the links of one page per canonical URL (and only of pages that were fetched as HTML). Links are
    then grouped by page as well, which the join has already placed together: one exchange does for both.
    """
    key = ["src", "dst"]
    if index is not None:
        links = links.join(index.select("page_id"), "page_id", "left_semi")
        key = ["page_id", *key]
    return links.groupBy(*key).agg(F.min("pos").cast("bigint").alias("pos")).select("src", "dst", "pos")


def numbered_edges(edges: DataFrame) -> DataFrame:
    """``edges(src, dst, pos, number)``: linked URLs numbered from 0, in the order of their text, so a site's numbers lie together."""
    edges = written(edges.select("src", "dst", "pos"), "links")
    urls = edges.select("dst").distinct().withColumn("all", F.lit(0))
    numbers = rank_within(urls, "all", ["dst"], "number").select("dst", (F.col("number") - 1).alias("number"))
    return edges.join(numbers, "dst").select("src", "dst", "pos", "number")


def folded(bits: DataFrame | None, numbers: DataFrame) -> DataFrame:
    """``site, chunk, bits`` of bits and some more numbers ``(site, number)``. Numbers are brought together first: a row of bits is wide."""
    placed = numbers.filter("number is not null").select("site", F.expr(f"number div {CHUNK}").alias("chunk"), (F.col("number") % CHUNK).alias("place"))
    new = placed.repartition("site", "chunk").groupBy("site", "chunk").agg(F.bitmap_construct_agg("place").alias("bits"))
    if bits is None:
        return new
    return new.unionByName(bits).groupBy("site", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))


def not_in(numbers: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows ``(site, number, ...)`` whose bit is not set."""
    bit = "(shiftright(cast(conv(hex(substring(bits, cast(number % {c} div 8 as int) + 1, 1)), 16, 10) as int), cast(number % 8 as int)) & 1) = 1"
    placed = numbers.withColumn("chunk", F.expr(f"number div {CHUNK}")).join(bits, ["site", "chunk"], "left")
    return placed.filter(F.col("bits").isNull() | ~F.expr(bit.format(c=CHUNK))).select(*numbers.columns)


@contextmanager
def stored_edges(edges: DataFrame, buckets: int | None = None) -> Iterator[DataFrame]:
    """Write the numbered link table once for all levels, bucketed by source page, so that no level shuffles it again.

    It is an external table of the session's catalog with its files in the shared folder, and leaves the catalog at the end.
    ``buckets`` is the session's number of shuffle partitions if it is not given.
    """
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"webloom_edges_{uuid.uuid4().hex}"
    (
        numbered_edges(edges)
        .repartition(buckets, "src")
        .write.option("path", scratch_path(spark, "edges"))
        .bucketBy(buckets, "src")
        .sortBy("src")
        .saveAsTable(name)
    )
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def crawl_reachability(
    seeds: DataFrame,
    edges: DataFrame,
    max_depth: int | None = None,
    max_pages: int | None = None,
) -> DataFrame:
    """``visited(site, url, order, depth)`` from ``seeds(site, url, order)`` over stored ``edges(src, dst, pos)``, numbered if they are not.

    ``order`` is the list of link positions that leads to a URL. Within a depth it sorts URLs exactly as a
    first-in-first-out queue would, so a level needs no sort. Every ``REBASE`` levels the list is replaced by the
    URL's rank within its level and site, so its width does not grow with the depth. ``max_pages`` stops sites that are full after
    a whole level; the exact cut is made by rank afterwards (everything up to the cap is in the result).
    """
    spark = seeds.sparkSession
    root = scratch_path(spark, "visited")
    if "number" not in edges.columns:
        edges = written(numbered_edges(edges), "edges")
    linked = edges.select(F.col("dst").alias("url"), "number")
    starts = seed_level(seeds)
    # Seeds that nothing links to have no number, and are never reached.
    known = linked.join(starts.select("url"), "url", "left_semi").distinct()
    level = starts.join(known, "url", "left").select("site", "url", "order", "number")
    schema = nullable(level.schema).add("depth", "integer")

    def visited(depth: int | None = None) -> DataFrame:
        path = root if depth is None else f"{root}/depth={depth}"
        return spark.read.schema(schema).option("basePath", root).parquet(path)

    depth, total, bits, since = 0, 0, None, 0  # levels from `since` on are not in the bits
    recent = 0
    while True:
        level.write.parquet(f"{root}/depth={depth}")
        found = visited(depth).count()  # from file footers
        total += found
        recent += found
        if found == 0 or depth == max_depth:
            break
        frontier = visited(depth).select("site", "url", "order")
        if depth % REBASE == REBASE - 1:
            ranked = rank_within(frontier, "site", ["order"])
            frontier = ranked.select("site", "url", F.array("rank").alias("order"))
        if max_pages is not None and total >= max_pages:
            full = visited().groupBy("site").count().filter(F.col("count") >= max_pages)
            frontier = frontier.join(full, "site", "left_anti")
        reached = (
            frontier.join(edges, frontier["url"] == edges["src"])
            .select("site", F.col("dst").alias("url"), F.concat("order", F.array("pos")).alias("order"), "number")
            # Combined before the exchange: a page that everything links to is one row per task.
            .groupBy("site", "number")
            .agg(F.min("order").alias("order"), F.first("url").alias("url"))
        )
        latest = visited().filter(F.col("depth") >= since).select("site", "number")
        if recent > FOLD_ROWS or depth - since >= REBASE:
            bits, since, recent = written(folded(bits, latest), "bits"), depth + 1, 0
            level = not_in(reached, bits)
        else:
            level = reached.join(latest, ["site", "number"], "left_anti")
            level = level if bits is None else not_in(level, bits)
        level = level.select("site", "url", "order", "number")
        depth += 1
    return visited().select("site", "url", "order", "depth")
