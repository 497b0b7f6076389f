"""The crawl's queue, entry by entry: every seed and every link of every saved page, in the order in which a queue would take them.

An entry's place is (rank of the referring page, position in it), 0 for seeds. Places are unique in a site, so the first entry of a URL is found by one
aggregate per (site, url), which combines before the exchange, and told to its entry by an equi-join on the place: a page that everything links to
is no hot key. Entry numbers come from range partitions with carried counts (``operators.ranking``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_internal
from ..session import written
from .ranking import rank_within

PLACE = ["parent", "place"]


def queue_entries(seeds: DataFrame, links: DataFrame, saved: DataFrame) -> DataFrame:
    """``site, url, parent, place`` of ``seeds(site, url, order)`` and of ``links(page_id, pos, dst)`` of ``saved(site, page_id, rank)``.

    ``links`` are of every kind: those that lead off the site or are no URL (null) are entries too.
    """
    first = seeds.select("site", "url", F.lit(0).cast("bigint").alias("parent"), F.col("order").alias("place"))
    found = links.select("page_id", F.col("dst").alias("url"), "pos").join(saved.select("site", "page_id", F.col("rank").alias("parent")), "page_id")
    return first.unionByName(found.select("site", "url", "parent", F.array(F.col("pos").cast("bigint")).alias("place")))


def queue_log(entries: DataFrame, log: DataFrame, tries: DataFrame | None = None) -> DataFrame:
    """``site, entry, parent, url, outcome, attempts``: what became of each entry.

    ``log(site, url, outcome)`` has one row per reached URL, ``cap_reached`` among the outcomes; ``tries(url, attempts)`` how often a URL was asked for (null if
    not known). Entries that are no URL, lead off the site, or repeat an earlier one have outcomes of their own and no attempts.
    """
    entries = written(entries, "entries")  # seeds of one place and URL that come twice are two entries
    numbered = written(rank_within(entries.withColumn("row", F.monotonically_increasing_id()), "site", [*PLACE, "url", "row"], "entry").drop("row"), "numbered")
    inside = numbered.filter(is_internal("url", "site"))
    first = inside.groupBy("site", "url").agg(F.min("entry").alias("entry")).join(log.select("site", "url", "outcome"), ["site", "url"])
    if tries is not None:
        first = first.join(tries.select("url", "attempts"), "url", "left")
    else:
        first = first.withColumn("attempts", F.lit(None).cast("bigint"))
    told = numbered.join(first.select("site", "entry", "outcome", "attempts"), ["site", "entry"], "left")
    outcome = (
        F.when(F.col("url").isNull(), F.lit("not_crawlable"))
        .when(~is_internal("url", "site"), F.lit("off_site"))
        .otherwise(F.coalesce("outcome", F.lit("duplicate")))
    )
    return told.select("site", "entry", "parent", "url", outcome.alias("outcome"), "attempts")
