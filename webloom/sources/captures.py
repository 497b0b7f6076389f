"""Captured pages in place of a network: fetching is a look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import content_type_gate, is_html, response_ok, route_page_or_resource
from ..functions.urls import canonicalize_url
from ..operators.attempts import retry_outcome
from ..options import CrawlOptions
from ..session import spread


def read_pages(spark: SparkSession, path: str, few_files: bool = False) -> DataFrame:
    """``pages(page_id, url, html)``; with ``few_files`` they are spread over all cores before any page is parsed."""
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    return spread(pages) if few_files else pages


def read_asset_files(spark: SparkSession, folder: str, scheme: str = "http") -> DataFrame:
    """``resources(url, file, length, content)`` of captured files at ``<folder>/<host>/<path of the URL>``.

    ``file`` tells captures of one URL apart (``/a//b`` and ``/a/b`` in some stores) and is what a join that fetches contents goes by. A query that does not
    ask for ``content`` lists the files and reads none of them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(f"{folder.rstrip('/').split(':', 1)[-1].lstrip('/')}/")
    below = F.expr("substring(path, locate(root, path) + length(root))")
    named = files.withColumn("root", root).withColumn("url", canonicalize_url(F.concat(F.lit(f"{scheme}://"), below)))
    return named.select("url", F.col("path").alias("file"), "length", "content").filter(F.col("url").isNotNull())


def page_index(pages: DataFrame, strip_slash: bool = False, with_branch: bool = False) -> DataFrame:
    """``(url, page_id)``: one page per canonical URL, the one with the lowest id.

    Reads identifiers and URLs only; ``with_branch`` also looks whether there is text and adds ``branch``. An aggregate
    and not a window, so copies of one URL combine before the exchange.
    """
    located = pages.select(
        canonicalize_url("url", strip_slash).alias("url"), "page_id", *([route_page_or_resource("html").alias("branch")] if with_branch else [])
    )
    return lowest_page(located)


def lowest_page(located: DataFrame) -> DataFrame:
    """:func:`page_index` of pages ``(url, page_id)``, or ``(url, page_id, branch)``, whose URLs are canonical."""
    branch = [F.min_by("branch", "page_id").alias("branch")] if "branch" in located.columns else []
    return located.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("page_id").alias("page_id"), *branch)


def page_source(frontier: DataFrame, pages: DataFrame, strip_slash: bool = False) -> DataFrame:
    """Frontier rows with their page text and an outcome; a URL without a captured page is a failed fetch.

    Misses are joined apart from hits: as NULL keys of one outer join they would all meet in one task.
    """
    index = page_index(pages, strip_slash)
    hits = frontier.join(index, "url").join(pages.select("page_id", "html"), "page_id")
    misses = frontier.join(index, "url", "left_anti")
    return hits.withColumn("outcome", F.lit("fetched")).unionByName(
        misses.withColumn("page_id", F.lit(None).cast("bigint"))
        .withColumn("html", F.lit(None).cast("string"))
        .withColumn("outcome", F.lit("failed"))
    )


def canonical_responses(responses: DataFrame, strip_slash: bool = False) -> DataFrame:
    """``(url, status, content_type)``: one response per canonical URL: a success before any other, then the lowest status."""
    good = F.coalesce(F.col("status").between(200, 399), F.lit(False))
    best = F.min(F.struct((~good).alias("bad"), "status", "content_type")).alias("r")
    return (
        responses.select(canonicalize_url("url", strip_slash).alias("url"), "status", "content_type")
        .filter(F.col("url").isNotNull())
        .groupBy("url")
        .agg(best)
        .select("url", "r.status", "r.content_type")
    )


def tried_fetches(attempts: DataFrame | None, options: CrawlOptions) -> DataFrame | None:
    """``url, attempts, first_success, exhausted`` of an attempt log ``(url, ts, attempt_id, ok)``."""
    if attempts is None:
        return None
    canonical = attempts.withColumn("url", canonicalize_url("url", options.strip_slash)).filter(F.col("url").isNotNull())
    return retry_outcome(canonical, options.max_retries)


def failed_fetches(attempts: DataFrame | None, options: CrawlOptions) -> DataFrame | None:
    """URLs without a success among the attempts that count."""
    tried = tried_fetches(attempts, options)
    return None if tried is None else tried.filter(F.col("first_success").isNull()).select("url")


def fetched_html(index: DataFrame, responses: DataFrame | None, options: CrawlOptions, failed: DataFrame | None = None) -> DataFrame:
    """Index rows whose response is fine and HTML. Without responses every captured page is."""
    if failed is not None:
        index = index.join(failed, "url", "left_anti")
    if responses is None:
        return index
    good = canonical_responses(responses, options.strip_slash).filter(
        response_ok("status") & F.coalesce(is_html("content_type"), F.lit(False))
    )
    return index.join(good, "url", "left_semi")


def fetch_outcome(
    visited: DataFrame, index: DataFrame, responses: DataFrame | None, options: CrawlOptions, failed: DataFrame | None = None
) -> DataFrame:
    """``crawl_log`` rows of visited URLs: saved, resource, skipped or failed.

    In the CMS layouts a page without text goes the way of a resource; the generic layout has no such branch.
    """
    log = visited.join(index, "url", "left")
    if responses is None:
        log = log.withColumn("status", F.when(F.col("page_id").isNotNull(), F.lit(200))).withColumn(
            "content_type", F.when(F.col("page_id").isNotNull(), F.lit("text/html"))
        )
    else:
        log = log.join(canonical_responses(responses, options.strip_slash), "url", "left")
    if failed is not None:
        log = log.join(failed.withColumn("gave_up", F.lit(True)), "url", "left")
    gave_up = F.coalesce(F.col("gave_up"), F.lit(False)) if failed is not None else F.lit(False)
    is_page = F.col("page_id").isNotNull()
    if options.layout == "cms":
        is_page = is_page & (F.col("branch") == "page")
    outcome = (
        F.when(gave_up | (F.col("page_id").isNull() & F.col("status").isNull()), F.lit("failed"))
        .when(~response_ok("status"), F.lit("failed"))
        .when(~content_type_gate("content_type", "url", options.url_endings), F.lit("skipped"))
        .when(F.coalesce(is_html("content_type"), F.lit(False)) & is_page, F.lit("saved"))
        .otherwise(F.lit("resource"))
    )
    return log.withColumn("outcome", outcome).drop("branch", "gave_up")
