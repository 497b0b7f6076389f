"""Whole jobs: crawl many sites, lay their files out, export their pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import exportable_page
from ..functions.urls import is_internal
from ..operators.crawl import crawl_reachability, link_edges, stored_edges
from ..operators.export import numbered, positioned, records_of, wxr_channel, wxr_gate, wxr_items
from ..operators.layout import asset_manifest, path_conflicts, path_winner
from ..operators.links import asset_rows, link_rows, page_path, page_references
from ..operators.queue import queue_entries, queue_log
from ..operators.ranking import crawl_rank, max_pages_cap
from ..operators.rewrite import rewrite_pages
from ..options import CMS, CMS_EXPORT, GENERIC, CrawlOptions
from ..session import written
from ..sources.captures import failed_fetches, fetch_outcome, fetched_html, lowest_page, tried_fetches
from ..sources.seeds import seed_queue


@dataclass(frozen=True)
class SiteCrawl:
    """Visited URLs with rank and outcome, and what the later steps share."""

    sites: DataFrame
    found: DataFrame  # page_id, src, branch, found: links and asset references of every page
    index: DataFrame
    ranked: DataFrame  # every reached URL, beyond the cap too
    log: DataFrame  # site, url, depth, rank, page_id, status, content_type, outcome
    seeds: DataFrame  # the queue before the first page
    tries: DataFrame | None  # url, attempts: of a log of attempts


def crawl_sites(
    pages: DataFrame,
    sites: DataFrame,
    options: CrawlOptions,
    sitemaps: DataFrame | None = None,
    responses: DataFrame | None = None,
    attempts: DataFrame | None = None,
) -> SiteCrawl:
    slash = options.strip_slash
    # The only parsing of the page text; everything after it reads the columns of this table.
    found = written(page_references(pages, slash), "references")
    branch = ["branch"] if options.layout == "cms" else []
    index = written(lowest_page(found.select(F.col("src").alias("url"), "page_id", *branch)), "index")
    failed = failed_fetches(attempts, options)
    html = fetched_html(index, responses, options, failed)
    links = link_rows(found.select("page_id", "src", "found.links"))
    seeds = seed_queue(sites, options, sitemaps, responses)
    with stored_edges(link_edges(links, html), options.edge_buckets) as edges:
        visited = crawl_reachability(seeds, edges, options.max_depth, options.max_pages)
    ranked = written(crawl_rank(visited).drop("order"), "ranked")
    log = written(fetch_outcome(max_pages_cap(ranked, options.max_pages), index, responses, options, failed), "log")
    return SiteCrawl(sites, found, index, ranked, log, seeds, tried_fetches(attempts, options))


def crawl_log(crawl: SiteCrawl, options: CrawlOptions) -> DataFrame:
    """``(site, url, depth, rank, outcome)`` of every reached URL; with a cap, up to the level that fills a site."""
    columns = ["site", "url", F.col("depth").cast("bigint").alias("depth"), "rank", "outcome"]
    if options.max_pages is None:
        return crawl.log.select(*columns)
    beyond = crawl.ranked.filter(F.col("rank") > options.max_pages).withColumn("outcome", F.lit("cap_reached"))
    return crawl.log.select(*columns).unionByName(beyond.select(*columns))


def link_outcomes(links: DataFrame) -> DataFrame:
    """Per site: references that are no URL, lead off the site, or stay inside. Takes links of every kind."""
    outcome = (
        F.when(F.col("dst").isNull(), F.lit("not_crawlable"))
        .when(~is_internal("dst", "site"), F.lit("off_site"))
        .otherwise(F.lit("internal"))
    )
    return links.groupBy("site", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("site", "outcome").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class SiteClone:
    crawl: SiteCrawl
    options: CrawlOptions
    pages: DataFrame

    def _located(self, outcome: str) -> DataFrame:
        log = self.crawl.log.filter(F.col("outcome") == outcome)
        return log.select("site", "url", "page_id", "rank", page_path(F.col("url"), self.options).alias("path"))

    def saved(self) -> DataFrame:
        """Saved pages with their paths: ``(site, url, page_id, rank, path)``."""
        return self._located("saved")

    def resources(self) -> DataFrame:
        """Crawled URLs that are kept but are no pages, with their paths."""
        return self._located("resource")

    def _text_of(self, narrow: DataFrame) -> DataFrame:
        """Page text of chosen ids. The one join that moves page text, and only that of the chosen pages."""
        return self.pages.join(narrow.select("page_id"), "page_id", "left_semi")

    def page_files(self) -> DataFrame:
        """``(site, path, url, rank, kind, content)``: the last writer of each path, rewritten."""
        winners = path_winner(self.saved(), keep="last")
        text = rewrite_pages(self._text_of(winners), self.options).select("page_id", "content")
        return winners.join(text, "page_id").select(
            "site", "path", "url", "rank", F.lit("page").alias("kind"), "content"
        )

    @cached_property
    def _assets(self) -> DataFrame:
        saved = self.saved().select("page_id", "rank")
        refs = self.crawl.found.select("page_id", "src", "found.refs")
        return written(asset_rows(refs, self.options).join(saved, "page_id"), "assets")

    def assets(self) -> DataFrame:
        """References to saved assets in saved pages. The page text is not read again; the join is narrow."""
        return self._assets

    def asset_files(self) -> DataFrame:
        """``(site, path, url, rank, kind)``: the first writer of each path among assets and crawled resources.

        Write their contents with ``sinks.files.asset_sink``.
        """
        refs = self.assets().select("site", F.col("local_path").alias("path"), F.col("asset_url").alias("url"), "rank", "kind")
        crawled = self.resources().select("site", "path", "url", "rank", F.lit("resource").alias("kind"))
        return path_winner(refs.unionByName(crawled), keep="first")

    def queue_log(self) -> DataFrame:
        """What became of every entry of the queue: ``operators.queue.queue_log``. Links off the site are entries too."""
        links = link_rows(self.crawl.found.select("page_id", "src", "found.links"), internal_only=False)
        entries = queue_entries(self.crawl.seeds, links, self.saved())
        return queue_log(entries, crawl_log(self.crawl, self.options), self.crawl.tries)

    def manifest(self) -> DataFrame:
        return asset_manifest(self.assets())

    def files(self) -> DataFrame:
        """The file tree without contents: ``(site, path, kind, src_url)``. An asset or resource never replaces a page."""
        pages = path_winner(self.saved(), keep="last").select(
            "site", "path", F.lit("page").alias("kind"), F.col("url").alias("src_url")
        )
        assets = self.asset_files().select("site", "path", "kind", F.col("url").alias("src_url"))
        return pages.unionByName(assets.join(pages.select("site", "path"), ["site", "path"], "left_anti"))

    def conflicts(self) -> DataFrame:
        pages = self.saved().select("site", "path", "url")
        assets = self.assets().select("site", F.col("local_path").alias("path"), F.col("asset_url").alias("url"))
        return path_conflicts(pages.unionByName(assets).unionByName(self.resources().select("site", "path", "url")))

    def _exported(self) -> DataFrame:
        return self.saved().filter(exportable_page("path")).select("site", "url", "page_id", "rank")

    def records(self) -> DataFrame:
        """Page records of the export, with their place in the crawl: saved pages whose file ends in ``.html``.

        Identifiers are numbered on narrow rows; the text is attached once and parsed last.
        """
        return records_of(numbered(self._exported()), self.pages)

    def _gated(self, rows: DataFrame) -> DataFrame:
        """Rows of the sites that get an export."""
        return rows.join(wxr_gate(self._exported(), self.options).select("site"), "site", "left_semi")

    def items(self) -> DataFrame:
        return wxr_items(records_of(self._gated(numbered(self._exported())), self.pages), self.options.as_of)

    def import_items(self) -> DataFrame:
        """The items with their place in their site's export, in crawl order; write them with ``sinks.imports.write_import_files``."""
        return wxr_items(records_of(self._gated(numbered(positioned(self._exported()))), self.pages), self.options.as_of)

    def channel(self) -> DataFrame:
        return wxr_channel(self._gated(self.crawl.sites), self._exported(), self.options.as_of)


def clone_site(pages, sites, options: CrawlOptions = GENERIC, sitemaps=None, responses=None, attempts=None) -> SiteClone:
    """Generic layout: pages under ``html/``, assets in folders by kind."""
    return SiteClone(crawl_sites(pages, sites, options, sitemaps, responses, attempts), options, pages)


def clone_cms_site(pages, sites, options: CrawlOptions = CMS, sitemaps=None, responses=None, attempts=None) -> SiteClone:
    """CMS layout: pages and assets at the paths of their URLs."""
    return SiteClone(crawl_sites(pages, sites, options, sitemaps, responses, attempts), options, pages)


def export_cms_site(pages, sites, options: CrawlOptions = CMS_EXPORT, sitemaps=None, responses=None, attempts=None) -> SiteClone:
    """CMS layout plus page records; write them with ``sinks.exports.write_wxr``."""
    return clone_cms_site(pages, sites, options, sitemaps, responses, attempts)
