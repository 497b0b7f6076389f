"""XML and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.export import NAMESPACES, RSS_VERSION, wxr_item_columns
from .files import SITE_BUCKETS, site_bucket


def _by_site(rows: DataFrame, buckets: int):
    """Folders ``site_bucket=/site=``: a site's export is its folder. The rebalance splits a large site over files."""
    keyed = rows.withColumn("site_bucket", site_bucket("site", buckets)).hint("rebalance", "site")
    return keyed.write.mode("overwrite").partitionBy("site_bucket", "site")


def write_wxr(items: DataFrame, channel: DataFrame, path: str, buckets: int = SITE_BUCKETS) -> None:
    """Write ``<path>/items`` and ``<path>/channel`` as XML part files, each with a folder per site."""
    spaces = " ".join(f'xmlns:{prefix}="{uri}"' for prefix, uri in NAMESPACES.items())
    (
        _by_site(wxr_item_columns(items), buckets)
        .format("xml")
        .option("rowTag", "item")
        .option("rootTag", f"channel {spaces}")
        .option("validateName", "false")
        .save(f"{path}/items")
    )
    (
        _by_site(
            channel.select(
                "site",
                "title",
                "link",
                "description",
                F.col("pub_date").alias("pubDate"),
                "language",
                F.col("wxr_version").alias("wp:wxr_version"),
            ),
            buckets,
        )
        .format("xml")
        .option("rowTag", "channel")
        .option("rootTag", f'rss version="{RSS_VERSION}" {spaces}')
        .option("validateName", "false")
        .save(f"{path}/channel")
    )


def write_pages_json(records: DataFrame, path: str, buckets: int = SITE_BUCKETS) -> None:
    """One JSON object per page, in a folder per site."""
    _by_site(records.select("site", "title", "content", "slug", F.lit("publish").alias("status")), buckets).json(path)
