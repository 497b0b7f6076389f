"""File tables that are updated path by path, in snapshots.

A snapshot is a *manifest*: which folder holds each bucket of sites. An update writes the buckets it touches anew, the rows it does not replace copied, into a
folder of its own, and then a manifest with the next version, through Spark's own commit. A reader takes the latest committed manifest, so a run that fails
at any point leaves the snapshot before it as it was, and one that succeeds appears as a whole. Of two writers at a time one fails.

Only touched buckets are read and moved. A manifest has one row per bucket, so it is all the driver sees.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frontier import existing_anti
from ..operators.layout import path_winner
from .files import SITE_BUCKETS, site_bucket

MANIFEST = "version bigint, site_bucket int, folder string, buckets int"


def manifest(spark: SparkSession, path: str, version: int | None = None) -> list[dict]:
    """The rows of the latest snapshot, or of a given one; none if nothing was written yet."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifests")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    wanted = rows.agg(F.max("version")).first()[0] if version is None else version
    return [r.asDict() for r in rows.filter(F.col("version") == wanted).collect()]


def read_snapshot(spark: SparkSession, path: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The files of a snapshot, of some buckets only if asked for; None if there are none."""
    wanted = [r for r in manifest(spark, path, version) if buckets is None or r["site_bucket"] in buckets]
    if not wanted:
        return None
    folders: dict[str, list[str]] = {}
    for r in wanted:
        folders.setdefault(r["folder"], []).append(f"{path}/data/{r['folder']}/site_bucket={r['site_bucket']}")
    parts = [spark.read.option("basePath", f"{path}/data/{folder}").parquet(*places) for folder, places in sorted(folders.items())]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def upsert_files(files: DataFrame, path: str, buckets: int = SITE_BUCKETS, one_per_path: bool = False) -> int:
    """Replace the given paths and keep all others; the version of the new snapshot.

    ``files(site, path, url, rank, ...)`` as for ``site_files_sink``: the last writer of a path wins, on narrow columns. An empty table changes nothing.
    """
    spark = files.sparkSession
    held = manifest(spark, path)
    if held and held[0]["buckets"] != buckets:
        raise ValueError(f"this table has {held[0]['buckets']} buckets")
    version = held[0]["version"] if held else 0
    if not one_per_path:
        winners = path_winner(files.select("site", "path", "url", "rank")).select("site", "path", "url", "rank")
        files = files.join(winners, ["site", "path", "url", "rank"], "left_semi")
    files = files.withColumn("site_bucket", site_bucket("site", buckets))
    touched = {r[0] for r in files.select("site_bucket").distinct().collect()}  # at most one row per bucket
    if not touched:
        return version
    before = read_snapshot(spark, path, version, touched) if held else None
    rows = files if before is None else files.unionByName(existing_anti(before, files), allowMissingColumns=True)
    folder = uuid.uuid4().hex
    rows.hint("rebalance", "site_bucket").write.partitionBy("site_bucket").parquet(f"{path}/data/{folder}")
    now = {r["site_bucket"]: r["folder"] for r in held} | dict.fromkeys(touched, folder)
    _commit(spark, path, version + 1, [(version + 1, b, f, buckets) for b, f in sorted(now.items())])
    return version + 1


def _commit(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> None:
    """The atomic step: a folder per version that must not exist yet."""
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifests/number={version}")
