"""Where a crawl starts: base URL, sitemaps, API endpoints and given paths.

Sites are rows ``sites(site, base_url)``. Path lists are literal arrays exploded next to each site: no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_json_hit
from ..functions.urls import canonicalize_url, is_internal, url_host
from ..operators.frontier import endpoint_semi, frontier_union
from ..operators.links import resolve_in_page, with_page
from ..options import POSTS_API_PATH, CrawlOptions
from .sitemaps import sitemap_tree, sitemap_urls, tree_roots


def site_table(base_urls: DataFrame) -> DataFrame:
    """``sites(site, base_url)``: one base URL per site, the first in order."""
    return (
        base_urls.select(url_host("base_url").alias("site"), "base_url")
        .filter(F.col("site") != "")
        .groupBy("site")
        .agg(F.min("base_url").alias("base_url"))
    )


def rest_endpoint_candidates(sites: DataFrame, options: CrawlOptions) -> DataFrame:
    """``(site, pos, url)`` of the API paths to try."""
    paths = [F.lit(p) for p in options.api_paths]
    if options.posts_api_if_named:
        named = F.contains(F.lower("base_url"), F.lit("wordpress"))
        paths = [F.when(named, F.lit(POSTS_API_PATH)), *paths]
    origin = F.regexp_extract("base_url", r"^[^:/]+://[^/?#]*", 0)
    return (
        sites.select("site", origin.alias("origin"), F.posexplode(F.array(*paths)).alias("pos", "path"))
        .filter(F.col("path").isNotNull())
        .select("site", "pos", F.concat("origin", "path").alias("url"))
    )


def rest_endpoint_hits(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Candidates answered with status 200 and JSON."""
    return endpoint_semi(candidates, responses.filter(is_json_hit("status", "content_type")))


def seed_paths(sites: DataFrame, paths: tuple[str, ...], strip_slash: bool = False) -> DataFrame:
    """``(site, pos, url)`` of relative paths joined to each base URL."""

    def joined(page: Column) -> Column:
        return F.transform(
            F.array(*[F.lit(path) for path in paths]),
            lambda path: canonicalize_url(resolve_in_page(page, path), strip_slash),
        )

    # The outer form keeps the optimizer from evaluating the array twice; see operators.links.
    listed = with_page(canonicalize_url("base_url"), joined)
    return (
        sites.select("site", listed.alias("urls"))
        .select("site", F.posexplode_outer("urls").alias("pos", "url"))
        .filter(is_internal("url", "site"))
    )


def _ordered(df: DataFrame, place: int, *position: str) -> DataFrame:
    keys = [F.col(c).cast("bigint") for c in position]
    keys += [F.lit(0).cast("bigint")] * (2 - len(keys))
    return df.select("site", "url", F.array(F.lit(place).cast("bigint"), *keys).alias("order"))


def seed_queue(
    sites: DataFrame, options: CrawlOptions, sitemaps: DataFrame | None = None, responses: DataFrame | None = None
) -> DataFrame:
    """The queue before the first page: ``(site, url, order)``, duplicates allowed.

    Sitemaps with an ``address`` are followed from each site's ``/sitemap.xml`` through their indexes; without, every document counts.
    """
    slash = options.strip_slash
    base = sites.select("site", canonicalize_url("base_url", slash).alias("url"))
    parts = [_ordered(base.filter(F.col("url").isNotNull()), 0)]
    if sitemaps is not None and options.follow_sitemap:
        if "address" in sitemaps.columns:
            tree = sitemap_tree(sitemaps, tree_roots(sites)).urls(slash, internal_only=True)
            parts.append(_ordered(tree, 1, "doc", "pos"))
        else:
            parts.append(_ordered(sitemap_urls(sitemaps, slash, internal_only=True), 1, "doc", "pos"))
    if responses is not None and options.fetch_json:
        hits = rest_endpoint_hits(rest_endpoint_candidates(sites, options), responses)
        # Queued URLs are canonicalized when they are taken out.
        hits = hits.withColumn("url", canonicalize_url("url", slash)).filter(is_internal("url", "site"))
        parts.append(_ordered(hits, 2, "pos"))
    if options.seed_paths:
        parts.append(_ordered(seed_paths(sites, options.seed_paths, slash), 3, "pos"))
    return frontier_union(*parts)


def seed_frontier(
    sites: DataFrame, options: CrawlOptions, sitemaps: DataFrame | None = None, responses: DataFrame | None = None
) -> DataFrame:
    """:func:`seed_queue` with one row per URL, at its first place."""
    return (
        seed_queue(sites, options, sitemaps, responses)
        .groupBy("site", "url")
        .agg(F.min("order").alias("order"))
    )
