"""The set look-ups of a crawl as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["site", "url"]


def distinct_urls(urls: DataFrame) -> DataFrame:
    return urls.dropDuplicates(KEY)


def unvisited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Frontier rows whose URL is not visited, with all their columns."""
    return frontier.join(visited.select(*KEY), KEY, "left_anti")


frontier_except = unvisited


def frontier_union(*parts: DataFrame) -> DataFrame:
    """Append to the queue: duplicates stay."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def visited_union(visited: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add to the set: only what is new."""
    return visited.unionByName(unvisited(distinct_urls(fresh), visited))


def fetch_join(frontier: DataFrame, index: DataFrame) -> DataFrame:
    """Look frontier URLs up in the page index; NULL ``page_id`` is a failed fetch."""
    return frontier.join(index.select("url", "page_id"), "url", "left")


def endpoint_semi(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    return candidates.join(hits, "url", "left_semi")


def existing_anti(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Skip what is already written at the same path."""
    return new.join(existing.select("site", "path"), ["site", "path"], "left_anti")


def crawl_count(visited: DataFrame) -> DataFrame:
    """Visited URLs per site. Failed and skipped ones count too: a URL is marked before it is fetched."""
    return visited.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
