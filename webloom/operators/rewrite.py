"""Pages with local, relative asset links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..functions.markup import asset_attr, asset_href, is_asset_tag, open_tag, page_pieces, replace_attr, tag_name
from ..functions.predicates import asset_filter
from ..functions.urls import canonicalize_url, relative_path, url_host
from ..options import CrawlOptions
from .links import asset_path, page_path, resolve_in_page, with_page


def rewrite_pages(pages: DataFrame, options: CrawlOptions) -> DataFrame:
    """``(page_id, site, url, path, content)``: saved assets point to their files, all other bytes stay.

    A page's references are all in its own row, so this is map-only: the text is cut at the asset tags, the tags
    are changed and everything is joined again. No page text is shuffled or grouped.
    """

    def new_tag(page: Column, path: Column, tag_text: Column) -> Column:
        tag = tag_name(tag_text)

        def replaced(url: Column) -> Column:
            local = relative_path(path, asset_path(tag, url, options))
            return F.when(
                asset_filter(url, page["site"], options), replace_attr(tag_text, asset_attr(tag), local)
            ).otherwise(tag_text)

        return let(
            asset_href(tag_text, tag),
            lambda href: F.when(href.isNull(), tag_text).otherwise(let(resolve_in_page(page, href), replaced)),
        )

    def new_piece(page: Column, path: Column, piece: Column) -> Column:
        # Of a script only the start tag changes; other asset pieces are start tags as a whole.
        changed = let(
            open_tag(piece),
            lambda start: F.concat(new_tag(page, path, start), F.substr(piece, F.length(start) + 1)),
        )
        return F.when(is_asset_tag(piece), changed).otherwise(piece)

    def content(page: Column) -> Column:
        return let(
            page_path(page["url"], options),
            lambda path: F.array_join(
                F.transform(page_pieces(F.col("html")), lambda piece: new_piece(page, path, piece)), ""
            ),
        )

    located = (
        pages.select("page_id", canonicalize_url("url", options.strip_slash).alias("url"), "html")
        .filter(F.col("url").isNotNull())
    )
    return located.select(
        "page_id",
        url_host("url").alias("site"),
        "url",
        page_path(F.col("url"), options).alias("path"),
        with_page(F.col("url"), content).alias("content"),
    )
