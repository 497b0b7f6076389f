"""Row predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import as_col, ends_with_any
from .urls import is_internal


def is_asset_url(url: Column | str, asset_types: tuple[str, ...], strip_query: bool = False) -> Column:
    """The URL string ends with an allowed extension. Case counts, and so does a query unless it is stripped."""
    if strip_query:
        url = F.regexp_replace(as_col(url), r"(?s)[?#].*\z", "")
    return ends_with_any(url, asset_types)


def is_excluded(url: Column | str, patterns: tuple[str, ...]) -> Column:
    """Any pattern matches from the start of the URL. Applies to assets only."""
    if not patterns:
        return F.lit(False)
    return as_col(url).rlike("^(?:" + "|".join(patterns) + ")")


def asset_filter(url: Column | str, site: Column | str, options) -> Column:
    return F.coalesce(
        is_asset_url(url, options.asset_types, options.strip_query_for_ext)
        & ~is_excluded(url, options.exclude_patterns)
        & is_internal(url, site),
        F.lit(False),
    )


def is_html(content_type: Column | str) -> Column:
    return F.contains(F.lower(as_col(content_type)), F.lit("text/html"))


def content_type_gate(content_type: Column | str, url: Column | str, url_endings: tuple[str, ...] = ()) -> Column:
    """HTML, or a URL with one of the endings that the layout keeps whatever the header says."""
    return F.coalesce(is_html(content_type), F.lit(False)) | ends_with_any(url, url_endings)


def response_ok(status: Column | str) -> Column:
    return F.coalesce(as_col(status) < 400, F.lit(False))


def is_json_hit(status: Column | str, content_type: Column | str) -> Column:
    """Status 200 and a JSON header. This header test is case-sensitive, unlike the HTML one."""
    return F.coalesce(
        (as_col(status) == 200) & F.contains(as_col(content_type), F.lit("application/json")), F.lit(False)
    )


def route_page_or_resource(html: Column | str) -> Column:
    """An empty HTML body goes the way of a resource."""
    return F.when(F.coalesce(F.length(as_col(html)), F.lit(0)) > 0, F.lit("page")).otherwise(F.lit("resource"))


def exportable_page(path: Column | str) -> Column:
    """The mapped file has the suffix ``.html`` and a name before it. The root page (``index.php``) never qualifies."""
    return as_col(path).rlike(r"(?s)[^/]\.html\z")


def nonempty_loc(loc: Column | str) -> Column:
    return F.coalesce(F.trim(as_col(loc)) != "", F.lit(False))
