"""Exact per-group ranks that survive one group holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def rank_within(df: DataFrame, group: str, order: list[str], out: str = "rank") -> DataFrame:
    """Add the 1-based position of every row in its group. ``order`` must be unique within a group.

    Sort by ranges, number the rows of each range, and add what lies in the ranges before. The ranges are written once, so both readers below see the same boundaries even if executors are lost.
    """
    keys = [group, *order]
    chunks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(
        df.repartitionByRange(chunks, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_chunk", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranges",
    )
    # One row per (group, chunk): for any group at most as many rows as there are chunks.
    pieces = ranged.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        group, "_chunk", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        ranged.join(offsets, [group, "_chunk"])
        .withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + 1)
        .drop("_chunk", "_at", "_first", "_before")
    )


def crawl_rank(visited: DataFrame) -> DataFrame:
    """First-in-first-out position of each visited URL in its site: by depth, then discovery order."""
    return rank_within(visited, "site", ["depth", "order"])


def max_pages_cap(ranked: DataFrame, max_pages: int | None) -> DataFrame:
    """The first ``max_pages`` URLs of each site; all of them without a cap."""
    return ranked if max_pages is None else ranked.filter(F.col("rank") <= max_pages)
