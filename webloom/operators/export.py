"""Page records and the rows of the XML and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import extract_main_content, extract_title
from ..functions.predicates import exportable_page
from ..functions.urls import canonicalize_url, page_slug, post_id, rfc822_date, sql_date, url_host
from ..options import CrawlOptions
from .links import page_path
from .ranking import rank_within

# Namespaces and constants of the export format.
NAMESPACES = {
    "excerpt": "http://wordpress.org/export/1.2/excerpt/",
    "content": "http://purl.org/rss/1.0/modules/content/",
    "wfw": "http://wellformedweb.org/CommentAPI/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "wp": "http://wordpress.org/export/1.2/",
}
RSS_VERSION = "2.0"
WXR_VERSION = "1.2"
CHANNEL_DESCRIPTION = "Exported WordPress content"
LANGUAGE = "en-US"
CREATOR = "admin"
POST_IDS = 1_000_000  # identifiers are below this


def page_data(pages: DataFrame, options: CrawlOptions, exportable_only: bool = False) -> DataFrame:
    """``(page_id, site, url, title, content, slug)`` from the unchanged page text. Map-only."""
    located = (
        pages.select("page_id", canonicalize_url("url", options.strip_slash).alias("url"), "html")
        .filter(F.col("url").isNotNull())
    )
    if exportable_only:
        # The path depends on the URL alone, so pages are dropped before their text is looked at.
        located = located.filter(exportable_page(page_path(F.col("url"), options)))
    return located.select(
        "page_id",
        url_host("url").alias("site"),
        "url",
        extract_title("html", "url").alias("title"),
        extract_main_content("html").alias("content"),
        page_slug("url").alias("slug"),
    )


def records_of(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """Page records of narrow rows ``(page_id, site, url, ...)``: one join attaches the text, and it is parsed after that."""
    text = chosen.join(pages.select("page_id", "html"), "page_id")
    return text.select(
        *chosen.columns, extract_title("html", "url").alias("title"), extract_main_content("html").alias("content"), page_slug("url").alias("slug")
    )


def with_collision_rank(items: DataFrame, id_col: str = "post_id", by: str = "link") -> DataFrame:
    """Number the URLs of a site that share an identifier. Pass narrow rows: a very large site has many per identifier."""
    window = Window.partitionBy("site", id_col).orderBy(by)
    return items.withColumn("collision_rank", F.row_number().over(window).cast("bigint"))


def numbered(chosen: DataFrame) -> DataFrame:
    """``post_id, collision_rank`` for narrow rows ``(site, url, ...)``, before any page text is attached."""
    return with_collision_rank(chosen.withColumn("post_id", post_id("url")), by="url")


def positioned(chosen: DataFrame, order: str = "rank") -> DataFrame:
    """``position``, from 1 in each site, for narrow rows ``(site, url, ...)``, before any page text is attached."""
    return rank_within(chosen, "site", [order, "url"], "position")


def wxr_items(records: DataFrame, as_of: str) -> DataFrame:
    """One export item per numbered page record, flat and map-only; :func:`wxr_item_columns` gives the XML names. A ``position`` is kept."""
    ts = F.lit(as_of).cast("timestamp_ntz")
    items = records.select(
        "site",
        "title",
        F.col("url").alias("link"),
        rfc822_date(ts).alias("pub_date"),
        F.lit(CREATOR).alias("creator"),
        F.col("url").alias("guid"),
        F.lit("").alias("description"),
        F.col("content").alias("content_encoded"),
        "post_id",
        sql_date(ts).alias("post_date"),
        sql_date(ts).alias("post_date_gmt"),
        F.lit("closed").alias("comment_status"),
        F.lit("closed").alias("ping_status"),
        F.col("slug").alias("post_name"),
        F.lit("publish").alias("status"),
        F.lit(0).cast("bigint").alias("post_parent"),
        F.lit(0).cast("bigint").alias("menu_order"),
        F.lit("page").alias("post_type"),
        F.lit("").alias("post_password"),
        F.lit(0).cast("bigint").alias("is_sticky"),
        "collision_rank",
        *[c for c in records.columns if c == "position"],
    )
    return items


def _xml_text(value: Column) -> Column:
    """Drop characters that XML 1.0 cannot hold."""
    return F.regexp_replace(value, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")


def export_id() -> Column:
    """An identifier that is distinct within a site: those of a collision are a million apart, beyond the range of the hash."""
    return F.col("post_id") + (F.col("collision_rank") - 1) * POST_IDS


def wxr_item_columns(items: DataFrame) -> DataFrame:
    """Rename a flat item to its element names, ready for the XML writer; ``site`` stays beside them as the key of the files."""
    return items.select(
        "site",
        _xml_text(F.col("title")).alias("title"),
        "link",
        F.col("pub_date").alias("pubDate"),
        F.col("creator").alias("dc:creator"),
        F.struct(F.lit("false").alias("_isPermaLink"), F.col("guid").alias("_VALUE")).alias("guid"),
        "description",
        _xml_text(F.col("content_encoded")).alias("content:encoded"),
        export_id().alias("wp:post_id"),
        F.col("post_date").alias("wp:post_date"),
        F.col("post_date_gmt").alias("wp:post_date_gmt"),
        F.col("comment_status").alias("wp:comment_status"),
        F.col("ping_status").alias("wp:ping_status"),
        _xml_text(F.col("post_name")).alias("wp:post_name"),
        F.col("status").alias("wp:status"),
        F.col("post_parent").alias("wp:post_parent"),
        F.col("menu_order").alias("wp:menu_order"),
        F.col("post_type").alias("wp:post_type"),
        F.col("post_password").alias("wp:post_password"),
        F.col("is_sticky").alias("wp:is_sticky"),
        *[c for c in items.columns if c == "position"],
    )


def wxr_channel(sites: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """One header per site ``(site, base_url)`` that has at least one page record."""
    return sites.join(records.select("site").distinct(), "site", "left_semi").select(
        "site",
        F.regexp_extract("base_url", r"^[^:/]+://([^/?#]*)", 1).alias("title"),
        F.col("base_url").alias("link"),
        F.lit(CHANNEL_DESCRIPTION).alias("description"),
        rfc822_date(F.lit(as_of).cast("timestamp_ntz")).alias("pub_date"),
        F.lit(LANGUAGE).alias("language"),
        F.lit(WXR_VERSION).alias("wxr_version"),
    )


def wxr_gate(records: DataFrame, options: CrawlOptions) -> DataFrame:
    """Sites that get an export: it is switched on and the site has pages."""
    counted = records.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    return counted.filter(F.lit(options.generate_xml) & (F.col("n_pages") > 0))
