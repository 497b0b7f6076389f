"""Incremental link discovery over a stream of captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.links import link_table
from ..session import nullable, scratch_path

PAGES = T.StructType().add("page_id", "long").add("url", "string").add("html", "string")
CAPTURED = T.StructType([*PAGES.fields]).add("captured_at", "timestamp")
URLS = T.StructType().add("site", "string").add("url", "string")

BATCH_BYTES = 100 << 30  # of page files per micro-batch: a failure repeats at most that much


def page_stream(
    spark: SparkSession,
    folder: str,
    files: str = "*.parquet",
    batch_bytes: int = BATCH_BYTES,
    batch_files: int | None = None,
    schema: T.StructType = PAGES,
) -> DataFrame:
    """Page files as they arrive in a folder; ``files`` is a glob over their names. A backlog is taken in batches."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    limited = reader.option("maxFilesPerTrigger", batch_files) if batch_files else reader.option("maxBytesPerTrigger", batch_bytes)
    return limited.parquet(folder)


def discover_links(pages: DataFrame, strip_slash: bool = False, horizon: str | None = None) -> DataFrame:
    """Each internal URL the first time it is seen. State is keyed by URL, so no site is a hot spot.

    Without a ``horizon`` it never expires. With one (an interval such as ``"7 days"``), pages carry ``captured_at``: a URL is remembered until the
    watermark, the latest capture less the horizon, has passed its first capture by the horizon, and told again when it is seen after that.
    Pages captured before the watermark come too late and are left out. State then holds the URLs of some horizons and not of all time.
    """
    if horizon is None:
        return link_table(pages, strip_slash).selectExpr("site", "dst as url").dropDuplicates(["site", "url"])
    found = link_table(pages.withWatermark("captured_at", horizon), strip_slash, keep=("captured_at",))
    return found.selectExpr("site", "dst as url", "captured_at").dropDuplicatesWithinWatermark(["site", "url"])


def run_stream(found: DataFrame, out: str, whole: bool = False) -> StreamingQuery:
    """Append discovered URLs to ``<out>/urls`` until nothing is left to read now; continues from ``<out>/checkpoint``.

    With ``whole`` all that is there is one micro-batch, whatever its files and bytes, and no empty one follows it: state that the watermark has passed goes
    with the next arrival. (``availableNow`` keeps to the limits of the source and would end with an empty micro-batch.)
    """
    query = (
        found.writeStream.format("parquet")
        .option("path", f"{out}/urls")
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode("append")
        .trigger(**({"once": True} if whole else {"availableNow": True}))
        .start()
    )
    query.awaitTermination()
    return query


def stream_discover_links(
    spark: SparkSession,
    folder: str,
    files: str = "*.parquet",
    strip_slash: bool = False,
    out: str | None = None,
    batch_bytes: int = BATCH_BYTES,
    batch_files: int | None = None,
    horizon: str | None = None,
    whole: bool = False,
) -> DataFrame:
    """Drain what is in the folder now and return all URLs discovered so far; with a ``horizon`` also when.

    Give the same ``out`` again to continue from its checkpoint. ``whole`` takes what is new as one micro-batch, see :func:`run_stream`.
    The state store is the session's: see ``build_session``.
    """
    out = out or scratch_path(spark, "discovered")
    pages = page_stream(spark, folder, files, batch_bytes, batch_files, CAPTURED if horizon else PAGES)
    run_stream(discover_links(pages, strip_slash, horizon), out, whole)
    schema = T.StructType([*URLS.fields]).add("captured_at", "timestamp") if horizon else URLS
    return spark.read.schema(nullable(schema)).parquet(f"{out}/urls")
