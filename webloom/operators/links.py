"""From captured pages to narrow tables of links and asset references.

Both are map-only: every reference is resolved inside its page's row, so the page text is read once, is never
shuffled, and is gone before the first exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..functions.markup import extract_anchors, extract_asset_refs
from ..functions.predicates import asset_filter, route_page_or_resource
from ..functions.urls import (
    asset_name,
    base_parts,
    canonicalize_url,
    cms_path,
    is_canonical_path,
    is_internal,
    join_reference,
    relative_part,
    relative_path,
    site_path,
    tidy_url,
    url_host,
)
from ..options import CrawlOptions


def with_page(page: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a canonical page URL and its parts once per row, for use by every reference in the page."""

    def parted(url: Column) -> Column:
        parts = [part.alias(name) for name, part in base_parts(url).items()]
        return let(F.struct(url.alias("url"), url_host(url).alias("site"), *parts), body)

    return let(page, parted)


def resolve_in_page(page: Column, ref: Column) -> Column:
    """Absolute URL of a reference; ``page`` is the struct bound by :func:`with_page`."""
    return let(
        tidy_url(ref),
        lambda r: let(relative_part(page["scheme"], r), lambda rest: join_reference(page["url"], page, r, rest)),
    )


def _links(page: Column, strip_slash: bool) -> Column:
    """``array<struct<href, dst>>`` of the anchors in ``html``."""

    def target(href: Column) -> Column:
        general = canonicalize_url(resolve_in_page(page, href), strip_slash)
        return F.when(is_canonical_path(href, strip_slash), F.concat(page["root"], href)).otherwise(general)

    return F.transform(extract_anchors("html"), lambda href: F.struct(href.alias("href"), target(href).alias("dst")))


def _refs(page: Column) -> Column:
    """``array<struct<tag, attr, href, asset_url>>`` of the asset references in ``html``."""
    return F.transform(
        extract_asset_refs("html"),
        lambda ref: F.struct(
            ref["tag"].alias("tag"),
            ref["attr"].alias("attr"),
            ref["href"].alias("href"),
            resolve_in_page(page, ref["href"]).alias("asset_url"),
        ),
    )


def page_references(pages: DataFrame, strip_slash: bool = False) -> DataFrame:
    """``(page_id, src, branch, found)``: all that a job takes from the page text, in one scan of it.

    ``found.links`` and ``found.refs`` are what :func:`link_rows` and :func:`asset_rows` take; write the table, and each
    reads its own column.
    """

    def found(page: Column) -> Column:
        return F.struct(_links(page, strip_slash).alias("links"), _refs(page).alias("refs"))

    located = pages.select("page_id", canonicalize_url("url", strip_slash).alias("src"), "html")
    return located.select("page_id", "src", route_page_or_resource("html").alias("branch"), with_page(F.col("src"), found).alias("found"))


def link_table(pages: DataFrame, strip_slash: bool = False, internal_only: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``links(page_id, site, src, pos, href, dst)`` of pages ``(page_id, url, html)``.

    ``dst`` is canonical, NULL for references that are not crawlable (kept only without ``internal_only``). Other columns of the pages follow if named in ``keep``.
    """
    located = pages.select("page_id", canonicalize_url("url", strip_slash).alias("src"), "html", *keep)
    links = with_page(F.col("src"), lambda page: _links(page, strip_slash))
    return link_rows(located.select("page_id", "src", links.alias("links"), *keep), internal_only, keep)


def link_rows(found: DataFrame, internal_only: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`link_table` of ``(page_id, src, links)``."""
    # The outer form on purpose: for the plain one the optimizer would add a filter on the array's size below
    # the explode, and so scan every page twice.
    rows = found.select("page_id", "src", F.posexplode_outer("links").alias("pos", "link"), *keep).select(
        "page_id",
        url_host("src").alias("site"),
        "src",
        "pos",
        F.col("link.href").alias("href"),
        F.col("link.dst").alias("dst"),
        *keep,
    )
    if internal_only:
        return rows.filter(is_internal("dst", "site"))
    return rows.filter(F.col("href").isNotNull() & F.col("src").isNotNull())


def asset_kind(tag: Column, url: Column) -> Column:
    """Output folder by tag, with font files told apart from style sheets by their ending."""
    font = F.lower(url).rlike(r"\.(?:woff2?|ttf)(?:[?#].*)?\z")
    return (
        F.when((tag == "link") & font, F.lit("fonts"))
        .when(tag == "link", F.lit("css"))
        .when(tag == "script", F.lit("js"))
        .when(tag == "img", F.lit("images"))
        .otherwise(F.lit("media"))
    )


def page_path(url: Column, options: CrawlOptions) -> Column:
    return site_path(url) if options.layout == "generic" else cms_path(url, options.with_backup)


def asset_path(tag: Column, url: Column, options: CrawlOptions) -> Column:
    if options.layout == "generic":
        return F.concat(asset_kind(tag, url), F.lit("/"), asset_name(url))
    return cms_path(url, options.with_backup)


def asset_table(pages: DataFrame, options: CrawlOptions, saved_only: bool = True) -> DataFrame:
    """``assets(page_id, site, src_url, pos, tag, attr, href, asset_url, saved, kind, local_path, rel_path)``."""
    located = pages.select("page_id", canonicalize_url("url", options.strip_slash).alias("src"), "html")
    return asset_rows(located.select("page_id", "src", with_page(F.col("src"), _refs).alias("refs")), options, saved_only)


def asset_rows(found: DataFrame, options: CrawlOptions, saved_only: bool = True) -> DataFrame:
    """:func:`asset_table` of ``(page_id, src, refs)``."""
    rows = found.select("page_id", F.col("src").alias("src_url"), F.posexplode_outer("refs").alias("pos", "ref")).select(
        "page_id", url_host("src_url").alias("site"), "src_url", "pos", "ref.*"
    )
    saved = asset_filter("asset_url", "site", options)
    rows = rows.filter(saved) if saved_only else rows.filter(F.col("asset_url").isNotNull())
    tag, url = F.col("tag"), F.col("asset_url")
    return (
        rows.withColumn("saved", F.lit(True) if saved_only else saved)
        .withColumn("kind", asset_kind(tag, url))
        .withColumn("local_path", asset_path(tag, url, options))
        .withColumn("rel_path", relative_path(page_path(F.col("src_url"), options), F.col("local_path")))
    )

