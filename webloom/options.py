"""Typed job options. An explicit argument wins over an options object, and that over the defaults here."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Allowed asset endings of each layout.
GENERIC_ASSETS = (".css", ".js", ".jpg", ".jpeg", ".png", ".gif", ".woff", ".woff2", ".ttf", ".svg")
CMS_ASSETS = GENERIC_ASSETS + (".php", ".ico")
BACKUP_ASSETS = CMS_ASSETS + (".sql", ".zip")

# Asset patterns that are never saved, per layout.
GENERIC_EXCLUDES = (r".*\.pdf$", r".*\.zip$", r".*\.exe$")
CMS_EXCLUDES = (r".*wp-config\.php$", r".*wp-login\.php$", r".*\.sql$", r".*\.zip$")
BACKUP_EXCLUDES = (r".*wp-config-sample\.php$", r".*wp-login\.php$")
EXPORT_EXCLUDES = (
    r".*wp-config\.php$", r".*wp-config-sample\.php$", r".*wp-login\.php$", r".*\.sql$", r".*\.zip$",
)

# URL endings kept whatever their content type.
CMS_ENDINGS = (".php", ".css", ".js")
BACKUP_ENDINGS = CMS_ENDINGS + (".sql", ".zip")

# API paths tried at each site's root.
GENERIC_API_PATHS = ("/api/", "/data/")
POSTS_API_PATH = "/wp-json/wp/v2/posts"
CMS_API_PATHS = (POSTS_API_PATH, "/wp-json/wp/v2/pages", "/wp-json/wp/v2/media", "/wp-json/")

# Seed paths of the CMS layouts.
CMS_SEED_PATHS = (
    "wp-content/themes/", "wp-content/plugins/", "wp-admin/", "wp-includes/", "index.php", "wp-blog-header.php",
)


@dataclass(frozen=True)
class CrawlOptions:
    layout: str = "generic"  # "generic": files by kind; "cms": the URL's own directories
    strip_slash: bool = True
    asset_types: tuple[str, ...] = GENERIC_ASSETS
    exclude_patterns: tuple[str, ...] = GENERIC_EXCLUDES
    url_endings: tuple[str, ...] = ()
    strip_query_for_ext: bool = False
    with_backup: bool = False
    api_paths: tuple[str, ...] = GENERIC_API_PATHS
    posts_api_if_named: bool = True  # the posts endpoint only where the URL contains "wordpress"
    seed_paths: tuple[str, ...] = ()
    follow_sitemap: bool = True
    fetch_json: bool = True
    generate_xml: bool = False
    max_pages: int | None = None  # a cap per site, only where a caller asks for one
    max_depth: int | None = None
    max_retries: int = 1  # attempts that count, where a job is given a log of attempts
    as_of: str = "2024-01-01 00:00:00"  # every exported date; never the wall clock
    edge_buckets: int | None = None  # of the link table, by source page; None: the session's shuffle partitions

    def with_(self, **changes) -> CrawlOptions:
        return replace(self, **changes)


GENERIC = CrawlOptions()
CMS = CrawlOptions(
    layout="cms",
    strip_slash=False,
    asset_types=CMS_ASSETS,
    exclude_patterns=CMS_EXCLUDES,
    url_endings=CMS_ENDINGS,
    api_paths=CMS_API_PATHS,
    posts_api_if_named=False,
    seed_paths=CMS_SEED_PATHS,
    max_retries=3,
)
CMS_WITH_BACKUP = CMS.with_(
    asset_types=BACKUP_ASSETS, exclude_patterns=BACKUP_EXCLUDES, url_endings=BACKUP_ENDINGS, with_backup=True
)
CMS_EXPORT = CMS.with_(exclude_patterns=EXPORT_EXCLUDES, generate_xml=True)
