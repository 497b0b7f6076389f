"""Writing files as rows ``(site, path, kind, src_url, content)``.

Tables are partitioned by a hash bucket of the site: the number of folders does not grow with the number of sites, a
large site is split over many files, and a reader of one site still prunes (see :func:`of_site`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frontier import existing_anti
from ..operators.layout import path_winner
from ..session import written

SITE_BUCKETS = 64


def site_bucket(site: Column | str, buckets: int = SITE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(buckets)).cast("int")


def of_site(table: DataFrame, site: str, buckets: int = SITE_BUCKETS) -> DataFrame:
    """Rows of one site, reading its bucket only."""
    return table.filter((F.col("site_bucket") == site_bucket(F.lit(site), buckets)) & (F.col("site") == site))


def _write(rows: DataFrame, path: str, mode: str, buckets: int) -> None:
    """One bucket's rows go together, so a task opens few files; the rebalance splits a bucket that is too large."""
    (
        rows.withColumn("site_bucket", site_bucket("site", buckets))
        .hint("rebalance", "site_bucket")
        .write.mode(mode)
        .partitionBy("site_bucket")
        .parquet(path)
    )


def site_files_sink(files: DataFrame, path: str, buckets: int = SITE_BUCKETS, one_per_path: bool = False) -> None:
    """Write pages; the last writer of a path wins and an earlier run is overwritten.

    ``files(site, path, url, rank, ...)``. Winners are picked on the narrow key columns; page text is only filtered.
    With ``one_per_path`` they are picked already (as in ``SiteClone.page_files``), and text moves in the rebalance only.
    """
    if one_per_path:
        _write(files, path, "overwrite", buckets)
        return
    winners = path_winner(files.select("site", "path", "url", "rank")).select("site", "path", "url", "rank")
    kept = files.join(winners, ["site", "path", "url", "rank"], "left_semi")
    _write(kept, path, "overwrite", buckets)


def new_assets(assets: DataFrame, existing: DataFrame | None) -> DataFrame:
    """First writer per path among the assets that are not written yet."""
    fresh = assets if existing is None else existing_anti(assets, existing)
    return path_winner(fresh, keep="first")


def asset_sink(assets: DataFrame, resources: DataFrame, path: str, existing: DataFrame | None = None, buckets: int = SITE_BUCKETS) -> None:
    """Append the contents of assets whose path does not exist yet, so a second run adds nothing.

    ``assets(site, path, url, rank, ...)``; ``resources(url, content)`` are the captured bytes (for files, ``sources.captures.read_asset_files``);
    an asset without them failed and is left to a later run. ``existing`` is what an earlier run wrote to ``path``.

    Everything is decided on narrow rows: which assets are new, and which capture of a URL counts (the least ``file``, where captures have one; otherwise
    copies of a URL must be equal). Then one join fetches contents, of chosen captures only, and no aggregate sees them.
    """
    captured = assets.join(resources.select("url"), "url", "left_semi")
    chosen = written(new_assets(captured, existing), "chosen")
    if "file" in resources.columns:
        files = chosen.select("url").distinct().join(resources.select("url", "file"), "url").groupBy("url").agg(F.min("file").alias("file"))
        contents = files.join(resources.select("file", "content"), "file").select("url", "content")
    else:
        wanted = resources.select("url", "content").join(chosen.select("url").distinct(), "url", "left_semi")
        contents = wanted.dropDuplicates(["url"])
    _write(chosen.join(contents, "url"), path, "append", buckets)
