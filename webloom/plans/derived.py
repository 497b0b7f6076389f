"""Tables that Spark derives, row by row, from the given ones.

The given pages have no assets, forms or links to one another, and there are no sitemaps or responses. The texts here
are SQL expressions that mean the same in Spark and in the checking engine. None of them needs a window or a join;
the one grouping (sitemap documents) is bounded to 64 pages per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_host
from ..sources.captures import read_pages

# Pages with assets, forms and every kind of content element.
AUG_HTML = """
replace(replace(replace(replace(replace(html,
 '</head>', concat(
  '<link rel="stylesheet" href="/wp-content/themes/t', cast(page_id%7 as string), '/style.css">',
  '<link rel="preload" href="../fonts/f', cast(page_id%2 as string), '.woff2">',
  '<script src="js/app', cast(page_id%5 as string), '.js"></script>',
  '<script src="/wp-includes/js/lib.js?ver=', cast(page_id%3 as string), '"></script>',
  '<!-- <img src="/img/hidden.png"> -->',
  '<link rel="stylesheet" href="https://cdn.example.com/x.css"></head>')),
 '</body>', concat('<img alt="a" src="/img/p', cast(page_id%11 as string), '.png"><img src="/img/UP.PNG">',
  '<video><source src="/media/v.mp4"></video><a href="/files/a.pdf">pdf</a><a href="mailto:x@example.com">m</a>',
  '<a href="https://other.example.com/">o</a></body>')),
 '<article>', case page_id%6 when 0 then '<article>' when 1 then '<main class="wrap"><article>'
  when 2 then '<div id="content"><div>' when 3 then '<div class="post content">'
  when 4 then '<section class="entry-content wide">' else '<p>' end),
 '</article>', case page_id%6 when 0 then '</article>' when 1 then '</article></main>'
  when 2 then '</div></div>' when 3 then '</div>' when 4 then '</section>' else '</p>' end),
 '<footer>', concat(case when page_id%4=0 then concat(
  '<form id="loginform" action="/in"><input type="text" name="log">',
  '<input type="hidden" name="redirect_to" value="/wp-admin/?u=', cast(page_id as string), '&amp;v=1">',
  '<input type="hidden" name="testcookie" value="1"><input type="hidden" value="nameless"></form>') else '' end,
  '<footer>'))
"""

# A link tree per site out of page numbers; site 0 holds a third of all pages.
TREE_SITE = "case when page_id%33 < 11 then 0 else page_id%33 - 10 end"
TREE_NODE = "case when page_id%33 < 11 then floor(page_id/33)*11 + page_id%33 else floor(page_id/33) end"


def _node_path(k: str) -> str:
    return f"""case when ({k}) = 0 then '/' else concat('/n/', cast(({k}) as string),
        case when ({k})%5=0 then '.html' else '' end) end"""


TREE_HOST = f"concat('tree', cast(cast({TREE_SITE} as bigint) as string), '.example.org')"
_K = f"cast({TREE_NODE} as bigint)"
TREE_URL = f"concat('http://', {TREE_HOST}, {_node_path(_K)}, case when page_id%4=1 then '?utm=1' else '' end)"
# Every 17th page or so has no text at all.
TREE_HTML = f"""case when page_id%17=12 then '' else replace(html, '<nav>', concat('<nav><a href="', {_node_path('2*' + _K + '+1')}, '">l</a><a href="',
  {_node_path('2*' + _K + '+2')}, '">r</a><a href="/">home</a><a href="/wp-includes/x', cast({_K}%3 as string),
  '.js">js</a><a href="http://tree1.example.org/">t</a>')) end"""

# URL and reference spellings per page.
HOST_RX = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
URL_MIX = [
    "url",
    "concat('  ', url)",
    "concat(url, '#top?x')",
    "concat('HTTP://User@', upper({host}), ':80/A/./b;v=1/c;p=', cast(page_id as string), '?q=;z')",
    "concat('https://', {host})",
    "concat('https://', {host}, '//a//', cast(page_id as string), '//')",
    "concat('ftp://', {host}, '/x;y/')",
    "concat('mailto:u', cast(page_id as string), '@', {host})",
    "concat('/rel/', cast(page_id as string))",
    "''",
]
REF_MIX = [
    "'a'",
    "'./a/'",
    "'../a'",
    "'../../../a/b'",
    "concat('/p/', cast(page_id as string), '/../x/./y')",
    "'?q=1'",
    "'#f'",
    "''",
    "concat('//o.example/z/', cast(page_id as string))",
    "'http://h.example/a/../b'",
    "'mailto:x@h.example'",
    "'a;p=1?q#f'",
    "'x/.'",
    "'x/..'",
    "'s.css?'",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet", few_files=True)


def pages_aug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).selectExpr("page_id", "url", f"{AUG_HTML} as html")


def pages_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).selectExpr("page_id", f"{TREE_URL} as url", f"{TREE_HTML} as html")


def pages_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree pages that also have assets, forms and content elements."""
    return pages_aug(spark, sf_dir).selectExpr("page_id", f"{TREE_URL} as url", f"{TREE_HTML} as html")


def tree_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "pages").select("page_id")
    return ids.selectExpr(f"concat('http://', {TREE_HOST}, '/') as base_url").distinct()


def page_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("url")
    return urls.select(F.concat(F.regexp_extract("url", "^[^:/]+://[^/?#]*", 0), F.lit("/")).alias("base_url"))


def url_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = f"regexp_extract(url, '{HOST_RX}', 1)"
    texts = ", ".join(e.format(host=host) for e in URL_MIX)
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"posexplode(array({texts})) as (i, u)")


def ref_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"posexplode(array({', '.join(REF_MIX)})) as (i, ref)")


SITEMAP_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    ' xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'
)
SITEMAP_ENTRY = """concat('<url><loc> ', replace({url}, '&', '&amp;'), ' </loc>',
  case when page_id%5=0 then concat('<image:image><image:loc>http://', {site}, '/img/', cast(page_id as string),
    '.png</image:loc></image:image>') else '' end, '</url>',
  case when page_id%9=0 then '<url><loc>not a url</loc></url><url><loc> </loc></url>' else '' end)"""
SITEMAP_TAIL = "case when length(site)%7=0 then '' else '</urlset>' end"


def sitemaps_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", "url", url_host("url").alias("site"))
    entries = urls.selectExpr(
        "site", "cast(floor(page_id/64) as bigint) as doc", "page_id", SITEMAP_ENTRY.format(url="url", site="site") + " as entry"
    )
    # A document holds at most 64 consecutive page numbers.
    docs = entries.groupBy("site", "doc").agg(F.sort_array(F.collect_list(F.struct("page_id", "entry"))).alias("e"))
    return docs.select(
        "site",
        "doc",
        F.concat(
            F.lit(SITEMAP_HEAD), F.array_join(F.transform("e", lambda x: x["entry"]), ""), F.expr(SITEMAP_TAIL)
        ).alias("xml"),
    )


def tree_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps of the tree's sites that list every seventh page, in documents of at most 64 page numbers."""
    listed = table(spark, sf_dir, "pages").filter("page_id%7 = 3").selectExpr(
        "page_id", f"{TREE_HOST} as site", "cast(floor(page_id/64) as bigint) as doc", f"concat('<url><loc>', {TREE_URL}, '</loc></url>') as entry"
    )
    docs = listed.groupBy("site", "doc").agg(F.sort_array(F.collect_list(F.struct("page_id", "entry"))).alias("e"))
    body = F.array_join(F.transform("e", lambda x: x["entry"]), "")
    return docs.select("site", "doc", F.concat(F.lit("<urlset>"), body, F.lit("</urlset>")).alias("xml"))


# Addresses of nested sitemaps: a root, indexes of four documents each, and documents.
MAP_ROOT = "concat('http://', site, '/sitemap.xml')"
MAP_INDEX = "concat('http://', site, '/index.php?n=', cast({g} as string))"
MAP_DOC = "concat('http://', site, '/map-', cast(doc as string), '.xml')"
MAP_GONE = "concat('http://', site, '/gone-', cast(g as string), '.xml')"


def nested_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of :func:`tree_sitemaps` below indexes. The root names four of five indexes and the fourth of each five names the fifth;
    every index names its documents, the root again, and one that is not there."""
    leaves = tree_sitemaps(spark, sf_dir).selectExpr("site", "doc", "xml", f"{MAP_DOC} as address")
    groups = leaves.selectExpr("site", "doc", "doc div 4 as g", "address")
    named = groups.groupBy("site", "g").agg(F.sort_array(F.collect_set("address")).alias("maps"))
    more = f"case when g%5 = 3 then array({MAP_INDEX.format(g='g+1')}) else array() end"
    named = named.selectExpr("site", "g", f"concat(maps, array({MAP_ROOT}, {MAP_GONE}), {more}) as named")
    indexes = named.selectExpr("site", "-2 - g as doc", "named", f"{MAP_INDEX.format(g='g')} as address")
    listed = F.sort_array(F.collect_set(F.when(F.expr("g%5 <> 4"), F.expr(MAP_INDEX.format(g="g")))))
    roots = named.groupBy("site").agg(listed.alias("named")).selectExpr("site", "cast(-1 as bigint) as doc", "named", f"{MAP_ROOT} as address")
    body = F.array_join(F.transform("named", lambda a: F.concat(F.lit("<sitemap><loc>"), a, F.lit("</loc></sitemap>"))), "")
    xml = F.concat(F.lit('<?xml version="1.0"?><sitemapindex>'), body, F.lit("</sitemapindex>"))
    above = indexes.unionByName(roots).select("site", "doc", xml.alias("xml"), "address")
    return leaves.unionByName(above)


RESPONSE_STATUS = "case when page_id%10=9 then 404 else 200 end"
RESPONSE_TYPE = """case when page_id%13=12 then 'application/pdf'
  when page_id%3=0 then 'Text/HTML; charset=UTF-8' else 'text/html' end"""
API_STATUS = "case when length(h)%4=0 then 404 else 200 end"
# Scripts that pages of the tree link to, and a file behind a seed path: answered, and no HTML.
SCRIPT_STATUS = "case when s = 1 then 404 else 200 end"
API_TYPE = "case when length(h)%3=0 then 'text/html' else 'application/json; charset=UTF-8' end"


def _responses(urls: DataFrame) -> DataFrame:
    own = urls.selectExpr("url", f"{RESPONSE_STATUS} as status", f"{RESPONSE_TYPE} as content_type")
    hosts = urls.select(url_host("url").alias("h")).distinct()
    api = hosts.selectExpr(
        "explode(array(concat('https://', h, '/wp-json/wp/v2/posts'), concat('http://', h, '/api/'))) as url",
        f"{API_STATUS} as status",
        f"{API_TYPE} as content_type",
    )
    return own.unionByName(api)


def responses_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(table(spark, sf_dir, "pages").select("page_id", "url"))


def tree_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").selectExpr("page_id", f"{TREE_URL} as url")
    scripts = tree_bases(spark, sf_dir).selectExpr("base_url", "explode(array(0, 1, 2)) as s").selectExpr(
        "concat(base_url, 'wp-includes/x', cast(s as string), '.js') as url", f"{SCRIPT_STATUS} as status", "'text/javascript' as content_type"
    )
    files = tree_bases(spark, sf_dir).selectExpr(
        "concat(base_url, 'wp-blog-header.php') as url", "200 as status", "'application/octet-stream' as content_type"
    )
    return _responses(urls).unionByName(scripts).unionByName(files)


#: The attempt that succeeds; some never do.
SUCCESS = "case when page_id%11 = 4 then 99 else page_id%3 + 1 end"


def tree_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four attempts at each page of the tree."""
    tries = table(spark, sf_dir, "pages").selectExpr("page_id", f"{TREE_URL} as url", "explode(sequence(1, 4)) as k")
    return tries.selectExpr("url", "k as ts", "4 * page_id + k as attempt_id", f"k >= {SUCCESS} as ok")


CAPTURE_BATCHES = 5
#: A batch a day; from the third on some pages were captured long before.
CAPTURED_AT = "case when page_id%5 >= 2 and page_id%13 = 5 then 1701388800 else 1704067200 + page_id%5*86400 + page_id%60*60 end"


def captured_pages(spark: SparkSession, sf_dir: str, batch: int) -> DataFrame:
    return pages(spark, sf_dir).filter(f"page_id%{CAPTURE_BATCHES} = {batch}").selectExpr("page_id", "url", "html", f"timestamp_seconds({CAPTURED_AT}) as captured_at")


def asset_bytes(spark: SparkSession, sf_dir: str, assets: DataFrame) -> DataFrame:
    """``resources(url, content)`` of referenced assets; some were never captured."""
    urls = assets.select("asset_url").distinct().filter("length(asset_url)%7 <> 0")
    return urls.selectExpr("asset_url as url", "encode(concat('bytes of ', asset_url), 'UTF-8') as content")


def attempts_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('res/', cast(user_id as string)) as url", "ts", "event_id as attempt_id", "event_type <> 'error' as ok"
    )
