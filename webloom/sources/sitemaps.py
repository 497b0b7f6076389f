"""Sitemap documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..functions.markup import unescape
from ..functions.predicates import nonempty_loc
from ..functions.urls import canonicalize_url, is_internal, strip_fragment
from ..operators.crawl import crawl_reachability, link_edges
from ..session import written

_GUARD = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>, _corrupt_record string"
_CDATA = r"<!\[CDATA\[(.*?)\]\]>"
# Every "loc" at any depth and in any namespace; comments are skipped.
_LOC = rf"(?s)<(?:!--.*?-->|(?:[\w.\-]+:)?loc(?:\s[^>]*+)?+(?<!/)>((?:[^<]++|{_CDATA})*+)<)"

# The root element is an index of other sitemaps.
_INDEX = r"(?s)\A(?:[\x{FEFF}\s]++|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*+>)*+<(?:[\w.\-]+:)?sitemapindex[\s>]"


def well_formed(xml: Column) -> Column:
    return F.from_xml(xml, _GUARD)["_corrupt_record"].isNull()


def _text(raw: Column) -> Column:
    return F.trim(
        F.when(F.contains(raw, F.lit("<![CDATA[")), F.regexp_replace(raw, rf"(?s){_CDATA}", "$1")).otherwise(
            unescape(raw)
        ),
        F.lit(" \t\r\n"),
    )


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """Every non-empty ``loc`` of well-formed documents. ``sitemaps(site, doc, xml)``; a bad document yields no rows."""
    return (
        sitemaps.filter(well_formed(F.col("xml")))
        .select("site", "doc", F.posexplode_outer(F.regexp_extract_all("xml", F.lit(_LOC), F.lit(1))).alias("pos", "raw"))
        .filter(F.col("raw") != "")
        .select("site", "doc", "pos", let(F.col("raw"), _text).alias("loc"))
        .filter(nonempty_loc("loc"))
    )


def sitemap_urls(sitemaps: DataFrame, strip_slash: bool = False, internal_only: bool = False) -> DataFrame:
    """``(site, doc, pos, url)`` in document order, values that are no URL dropped."""
    urls = sitemap_locs(sitemaps).select(
        "site", "doc", "pos", canonicalize_url("loc", strip_slash).alias("url")
    )
    return urls.filter(is_internal("url", "site") if internal_only else F.col("url").isNotNull())


def sitemap_count(sitemaps: DataFrame) -> DataFrame:
    """URLs per site's sitemaps, counted before values that are no URL are dropped."""
    return sitemap_locs(sitemaps).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class SitemapTree:
    """Sitemaps reached from each site's roots.

    ``documents(site, address, depth, outcome)``: every address asked for, once a site, at its least depth; ``outcome`` is ``index``, ``urls``,
    ``bad`` (no well-formed XML) or ``missing`` (no such document in the table).
    ``locs(site, address, depth, doc, pos, loc)``: the entries of reached documents that are no index.
    """

    documents: DataFrame
    locs: DataFrame

    def urls(self, strip_slash: bool = False, internal_only: bool = False) -> DataFrame:
        """``(site, address, depth, doc, pos, url)``, values that are no URL dropped."""
        found = self.locs.select("site", "address", "depth", "doc", "pos", canonicalize_url("loc", strip_slash).alias("url"))
        return found.filter(is_internal("url", "site") if internal_only else F.col("url").isNotNull())


def sitemap_tree(sitemaps: DataFrame, roots: DataFrame, max_depth: int | None = None) -> SitemapTree:
    """Follow sitemap indexes. ``sitemaps(site, doc, xml, address)``, ``roots(site, address)``.

    An index's entries are addresses (queries kept, fragments not) of further documents; a breadth-first search reaches each once, so indexes
    that name one another end. Documents are parsed once, before the search, which then moves addresses only. Of several
    documents at one address the one with the lowest ``doc`` counts.
    """
    address = strip_fragment(F.trim("address"))
    placed = sitemaps.filter(F.col("address").isNotNull()).select(
        "doc", "xml", address.alias("address"), F.col("xml").rlike(_INDEX).alias("is_index"), well_formed(F.col("xml")).alias("good")
    )
    kind = F.when(~F.coalesce("good", F.lit(False)), F.lit("bad")).when(F.col("is_index"), F.lit("index")).otherwise(F.lit("urls"))
    chosen = placed.groupBy("address").agg(F.min_by(F.struct("doc", kind.alias("outcome")), "doc").alias("d")).select("address", "d.*")
    chosen = written(chosen, "sitemaps")
    # Entries carry their document's address as the name of the site, so they are known by address and number.
    parsed = sitemap_locs(sitemaps.select(address.alias("site"), "doc", "xml")).withColumnRenamed("site", "address")
    entries = written(parsed.join(chosen, ["address", "doc"]), "locs")
    links = entries.filter(F.col("outcome") == "index").select(F.col("address").alias("src"), strip_fragment(F.col("loc")).alias("dst"), "pos")
    seeds = roots.select("site", address.alias("url"), F.array(F.lit(0).cast("bigint")).alias("order")).filter(F.col("url").isNotNull())
    reached = crawl_reachability(seeds, link_edges(links), max_depth).select("site", F.col("url").alias("address"), F.col("depth").cast("bigint").alias("depth"))
    documents = reached.join(chosen.select("address", "outcome"), "address", "left").select(
        "site", "address", "depth", F.coalesce("outcome", F.lit("missing")).alias("outcome")
    )
    locs = reached.join(entries.filter(F.col("outcome") == "urls"), "address")
    return SitemapTree(documents, locs.select("site", "address", "depth", "doc", "pos", "loc"))


def tree_roots(sites: DataFrame) -> DataFrame:
    """``(site, address)``: the place where a site's first sitemap is looked for, below its base URL."""
    return sites.select("site", F.concat(F.rtrim("base_url", F.lit("/")), F.lit("/sitemap.xml")).alias("address"))
