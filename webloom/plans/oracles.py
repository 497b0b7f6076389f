"""The SQL twin of each named query, for an independent engine over the same tables.

Written from the meaning of the derived tables and not from the Spark expressions: where a derived page's links,
assets or content are known by construction, the SQL says so directly.
"""

from __future__ import annotations

from . import derived as d
from ..options import CMS_API_PATHS, CMS_SEED_PATHS

ORACLES: dict[str, str] = {}

HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
PAGE = "regexp_extract(url, '^[^?#]*')"
SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
CMS_TYPES = r"\.(css|js|jpg|jpeg|png|gif|woff|woff2|ttf|svg|php|ico)\z"
GENERIC_TYPES = r"\.(css|js|jpg|jpeg|png|gif|woff|woff2|ttf|svg)\z"


def listed(texts: list[str]) -> str:
    """Rows ``(page_id, url, i, v)`` of a list of expressions per page."""
    return f"(select page_id, url, i, l[i+1] as v from (select page_id, url, [{', '.join(texts)}] l from pages), range({len(texts)}) r(i))"


def canon(u: str, strip_slash: bool = False) -> str:
    t = rf"regexp_replace({u}, '^[\x00-\x20]+|[\t\r\n]+', '', 'g')"
    origin = rf"lower(regexp_extract({t}, '^{SCHEME}://[^/?#]+'))"
    path = rf"regexp_replace(regexp_extract({t}, '^{SCHEME}://[^/?#]+([^?#]*)', 1), ';[^/]*\z', '')"
    path = f"case when {path} = '' then '/' else {path} end"
    if strip_slash:
        path = rf"regexp_replace({path}, '(?s)(.)/\z', '\1')"
    return f"case when {origin} <> '' then concat({origin}, {path}) end"


def tidy_path(p: str) -> str:
    inner = rf"regexp_replace({p}, '/(\.?/)+', '/', 'g')"
    return rf"regexp_replace(regexp_replace({inner}, '^(\./)+', ''), '/\.?\z|^\.\z', '')"


def url_path(u: str) -> str:
    return rf"regexp_extract({u}, '^{SCHEME}://[^/?#]*([^?#]*)', 1)"


def has_ext(p: str) -> str:
    return rf"regexp_matches(regexp_extract({p}, '[^/]*\z'), '(?s)[^.].*[.]')"


def rel_file(u: str) -> str:
    return f"ltrim(url_decode({url_path(u)}), '/')"


def site_path(u: str, root: str = "html") -> str:
    f = rel_file(u)
    mapped = f"case when {f} = '' then 'index.html' when not {has_ext(f)} then concat({f}, '/index.html') else {f} end"
    return tidy_path(f"concat('{root}/', {mapped})")


def cms_path(u: str, backup: bool = False) -> str:
    f = rel_file(u)
    archive = rf"when regexp_matches({f}, '\.(sql|zip)\z') then concat('backup/', regexp_extract({f}, '[^/]*\z'))"
    return tidy_path(
        f"""case when {f} = '' then 'index.php' when regexp_matches({f}, '^wp-(content|admin|includes)') then {f}
        when regexp_matches({f}, '^[^/]*\\.php\\z') then {f} {archive if backup else ''}
        when not {has_ext(f)} then concat({f}, '/index.html') else {f} end"""
    )


def relative(src: str, dst: str) -> str:
    a, b = f"string_split({src}, '/')", f"string_split({dst}, '/')"
    folder = f"({a})[1:len({a})-1]"
    common = f"len(list_filter(range(1, least(len({folder}), len({b}))+1), lambda k: ({folder})[1:k] = ({b})[1:k]))"
    steps = f"list_concat(list_transform(range(len({folder}) - {common}), lambda x: '..'), ({b})[{common}+1:len({b})])"
    return f"case when len({steps}) = 0 then '.' else array_to_string({steps}, '/') end"


def slug(u: str) -> str:
    p = f"trim({url_path(u)}, '/')"
    base = rf"regexp_extract({p}, '[^/]*\z')"
    return rf"""case when {p} = '' then 'home' when regexp_matches({p}, '[^./][^/]*\.php\z') then {p}[1:length({p})-4]
      when {p} like '%.php' then {p} when not {has_ext(p)} then {base} else {p} end"""


# --- tables by construction -----------------------------------------------------------------------

AUG = f"aug as (select page_id, url, {PAGE} as src, {HOST} as site, {d.AUG_HTML} as html from pages)"

# The generic layout drops one trailing slash, so references resolve from one folder further up.
PAGE_NO_SLASH = rf"regexp_replace({PAGE}, '^([a-z]+://[^/]+/.*[^/])/\z', '\1')"
AUG_GENERIC = f"aug as (select page_id, url, {PAGE_NO_SLASH} as src, {HOST} as site, {d.AUG_HTML} as html from pages)"

# Links of the given pages: all are root-relative.
LINKS = f"""links as (select page_id, {HOST} as site, {PAGE} as src, i-1 as pos,
  concat(regexp_extract(url, '^[a-z]+://[^/?#]+'), a[i]) as dst
  from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) a from pages), lateral (select unnest(range(1, len(a)+1)) i))"""

# Assets of augmented pages. All values are quoted; comments go first.
_REF = r"""list_filter(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
  '<(?:link|script|img|source)\s[^>]*>'), lambda t: regexp_matches(t, '\s(href|src)="'))"""
ASSETS = rf"""{AUG}, refs as (select page_id, src, site, i-1 as pos, regexp_extract(t[i], '^<([a-z]+)', 1) as tag,
    regexp_extract(t[i], '\s(href|src)="', 1) as attr, regexp_extract(t[i], '\s(?:href|src)="([^"]*)"', 1) as href
    from (select page_id, src, site, {_REF} t from aug), lateral (select unnest(range(1, len(t)+1)) i)),
  parts as (select *, regexp_extract(src, '^[a-z]+://[^/]+') as root,
    regexp_extract(src, '(?s)^[a-z]+://[^/]+(/(?:.*/)?)', 1) as folder from refs),
  assets as (select *, regexp_matches(asset_url, '^[a-z]+://' || site || '/') as internal,
    case when tag = 'link' and regexp_matches(asset_url, '\.woff2?\z') then 'fonts' when tag = 'link' then 'css'
      when tag = 'script' then 'js' when tag = 'img' then 'images' else 'media' end as kind
    from (select *, case when href like 'http%' then href when href like '/%' then concat(root, href)
      when href like '../%' then concat(root, case when folder = '/' then '/' else regexp_replace(folder, '[^/]+/\z', '') end, href[4:])
      else concat(root, folder, href) end as asset_url from parts))"""
ASSETS_GENERIC = ASSETS.replace(AUG, AUG_GENERIC)
SAVED_CMS = f"internal and regexp_matches(asset_url, '{CMS_TYPES}')"
SAVED_GENERIC = f"internal and regexp_matches(asset_url, '{GENERIC_TYPES}')"
GENERIC_LOCAL = r"concat(kind, '/', regexp_extract(asset_url, '[^/]*\z'))"

CONTENT = r"""case page_id%6 when 0 then regexp_extract(html, '(?s)<article>.*?</article>')
  when 1 then regexp_extract(html, '(?s)<main class="wrap">.*?</main>')
  when 2 then regexp_extract(html, '(?s)<div id="content"><div>.*?</div></div>')
  when 3 then regexp_extract(html, '(?s)<div class="post content">.*?</div>')
  when 4 then regexp_extract(html, '(?s)<section class="entry-content wide">.*?</section>')
  else regexp_replace(regexp_extract(html, '(?s)<body>.*?(?:</body>|</html>|\z)'), '</html>\z', '') end"""

TITLE = r"""trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'),
  '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'))"""

SITES = f"sites as (select site, min(origin) as origin from (select {HOST} as site, regexp_extract(url, '^[a-z]+://[^/?#]+') as origin from pages) group by site)"
RESPONSES = f"""responses as (select url, {d.RESPONSE_STATUS} as status, {d.RESPONSE_TYPE} as content_type from pages
  union all select u, {d.API_STATUS}, {d.API_TYPE} from (select h, unnest([concat('https://', h, '/wp-json/wp/v2/posts'),
    concat('http://', h, '/api/')]) u from (select distinct {HOST} h from pages)))"""
LOCS = f"""locs as (select * from (
  select {HOST} as site, page_id//64 as doc, url as loc, {PAGE} as url from pages
  union all select {HOST}, page_id//64, concat('http://', {HOST}, '/img/', page_id, '.png'),
    concat('http://', {HOST}, '/img/', page_id, '.png') from pages where page_id%5=0
  union all select {HOST}, page_id//64, 'not a url', null from pages where page_id%9=0) where length(site)%7 <> 0)"""


def api_rows(paths: tuple[str, ...], first: int = 0) -> str:
    rows = ", ".join(f"(cast({i + first} as bigint), '{p}')" for i, p in enumerate(paths))
    return f"(values {rows}) p(pos, path)"


CMS_CANDIDATES = f"select site, pos, concat(origin, path) as url from sites, {api_rows(CMS_API_PATHS)}"
CMS_SEEDS = f"select site, pos, concat(origin, '/', path) as url from sites, {api_rows(CMS_SEED_PATHS)}"
JSON_HITS = "select url from responses where status = 200 and content_type like '%application/json%'"

# --- sources --------------------------------------------------------------------------------------

ORACLES["page_source"] = f"""with idx as (select {PAGE} as url, min(page_id) as page_id from pages group by 1),
  q as (select url from idx union select concat(url, '/next') from idx)
  select q.url, i.page_id, md5(p.html) as content, case when p.page_id is null then 'failed' else 'fetched' end as outcome
  from q left join idx i using (url) left join pages p on p.page_id = i.page_id"""
ORACLES["sitemap_urls"] = f"with {LOCS} select distinct site, doc, url from locs where url is not null"
ORACLES["sitemap_count"] = f"with {LOCS} select site, count(*) as n from locs group by site"
ORACLES["nonempty_loc"] = f"with {LOCS} select loc, count(*) as n from locs group by loc"
_MAPS = f"""listed as (select page_id, page_id//64 as doc, {d.TREE_HOST} as site, regexp_extract({d.TREE_URL}, '^[^?#]*') as url from pages),
  leaf as (select distinct site, doc, doc//4 as g from listed where page_id%7 = 3), idx as (select distinct site, g from leaf),
  edges as (select site, {d.MAP_ROOT} as src, {d.MAP_INDEX.format(g='g')} as dst from idx where g%5 <> 4
    union all select site, {d.MAP_INDEX.format(g='g')}, {d.MAP_DOC} from leaf
    union all select site, {d.MAP_INDEX.format(g='g')}, unnest([{d.MAP_ROOT}, {d.MAP_GONE}]) from idx
    union all select site, {d.MAP_INDEX.format(g='g')}, {d.MAP_INDEX.format(g='(g+1)')} from idx where g%5 = 3),
  docs as (select site, {d.MAP_DOC} as address, 'urls' as outcome from leaf union all select site, {d.MAP_INDEX.format(g='g')}, 'index' from idx
    union all select distinct site, {d.MAP_ROOT}, 'index' from idx),
  walk(site, address, depth) as (select distinct site, {d.MAP_ROOT}, cast(0 as bigint) from (select {d.TREE_HOST} as site from pages)
    union select e.site, e.dst, w.depth + 1 from walk w join edges e on e.site = w.site and e.src = w.address where w.depth < 8),
  reached as (select site, address, min(depth) as depth from walk group by 1, 2),
  found as (select r.site, r.address, r.depth, t.url, row_number() over (partition by r.site, t.doc order by t.page_id) - 1 as pos
    from reached r join (select *, {d.MAP_DOC} as address from listed where page_id%7 = 3) t using (site, address))"""
ORACLES["sitemap_tree_documents"] = f"""with recursive {_MAPS} select r.site, r.address, r.depth, coalesce(o.outcome, 'missing') as outcome
  from reached r left join docs o using (site, address)"""
ORACLES["sitemap_tree_urls"] = f"with recursive {_MAPS} select site, address, depth, pos, url from found"
ORACLES["nested_sitemap_seeds"] = f"""with recursive {_MAPS} select site, url, min(source) as source
  from (select site, url, cast(1 as bigint) as source from found union all select distinct site, concat('http://', site, '/'), 0 from listed) group by 1, 2"""
ORACLES["rest_endpoint_candidates"] = f"""with {SITES}
  select 'generic' as layout, site, pos, concat(origin, path) as url from sites, {api_rows(('/api/', '/data/'), 1)}
  union all select 'cms', site, pos, url from ({CMS_CANDIDATES})
  union all select 'generic', site, cast(0 as bigint), concat(origin, '/wp-json/wp/v2/posts') from sites where origin like '%wordpress%'"""
ORACLES["rest_endpoint_hits"] = f"with {SITES}, {RESPONSES} select site, url from ({CMS_CANDIDATES}) where url in ({JSON_HITS})"
ORACLES["endpoint_semi"] = f"""with {SITES}, {RESPONSES} select site, url from
  (select site, concat(origin, path) as url from sites, {api_rows(('/api/', '/data/'))}) where url in ({JSON_HITS})"""
ORACLES["seed_paths"] = f"with {SITES} {CMS_SEEDS}"
ORACLES["seed_cross"] = f"""with {SITES} select site, pos, concat(origin, path) as url
  from sites, (values (cast(0 as bigint), '/up/'), (1, '/root.php'), (2, '/a/b'), (4, '/')) p(pos, path)"""
SEED_BAG = f"""bag as (select site, concat(origin, '/') as url, 0 as source from sites
  union all select site, url, 1 from locs where url is not null
  union all select site, url, 2 from ({CMS_CANDIDATES}) where url in ({JSON_HITS})
  union all select site, url, 3 from ({CMS_SEEDS}))"""
ORACLES["seed_frontier"] = f"""with {SITES}, {RESPONSES}, {LOCS}, {SEED_BAG}
  select site, url, cast(min(source) as bigint) as source from bag group by site, url"""
ORACLES["frontier_union"] = f"""with {SITES}, {RESPONSES}, {LOCS}, {SEED_BAG}
  select site, cast(source as bigint) as source, count(*) as n from bag group by site, source"""

# --- URL functions --------------------------------------------------------------------------------

_MIX = listed([e.format(host=HOST) for e in d.URL_MIX])
ORACLES["canonicalize_url"] = f"select page_id, i, {canon('v')} as url, {canon('v', True)} as url_no_slash from {_MIX}"
ORACLES["url_host"] = rf"select page_id, i, lower(regexp_extract(v, '^{SCHEME}://([^/?#]*)', 1)) as host from {_MIX}"
ORACLES["strip_fragment"] = rf"select page_id, i, regexp_replace(v, '(?s)#.*\z', '') as url from {_MIX}"
ORACLES["is_internal"] = rf"""select page_id, i, lower(regexp_extract(v, '^{SCHEME}://([^/?#]*)', 1)) = {HOST} as internal from {_MIX}"""

_FOLD = r"""list_reduce(list_transform(string_split(m, '/'), lambda s: [s]), lambda acc, s:
  case when s[1] = '..' then acc[1:len(acc)-1] when s[1] = '.' then acc else list_concat(acc, s) end, []::varchar[])"""
_JOINED = rf"array_to_string(case when regexp_matches(m, '/\.\.?\z') then list_append({_FOLD}, '') else {_FOLD} end, '/')"
ORACLES["resolve_url"] = rf"""with r as (select page_id, i, v as ref, {PAGE} as base from {listed(d.REF_MIX)}),
  p as (select *, regexp_extract(base, '^[a-z]+://[^/]+') as root, regexp_extract(base, '(?s)^[a-z]+://[^/]+(/(?:.*/)?)', 1) as folder,
    regexp_extract(ref, '^[^;?#]*') as path, regexp_extract(ref, '(?s)^[^;?#]*(.*)\z', 1) as tail from r),
  m as (select *, regexp_replace(case when path like '/%' then path else concat(folder, path) end, '/{{2,}}', '/', 'g') as m from p)
  select page_id, i, case when ref like 'mailto:%' then ref
    when ref like 'http:%' then case when base like 'http:%' then ref else ref end
    when ref like '//%' then concat(regexp_extract(base, '^[a-z]+:'), ref)
    when path = '' then concat(base, tail)
    else concat(root, case when {_JOINED} like '/%' then '' else '/' end, {_JOINED}, case when tail = '?' then '' else tail end)
    end as url from m"""

_PATHS = listed([
    "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/[0-9]', '/n', 'g')",
    "concat('/d%C3%A9/%41', page_id, '+x%20y.tar.gz')",
    "concat('/a/.hidden', page_id)",
    "concat('/wp-content-old/', page_id)",
    "concat('/p', page_id, '.php')",
    "concat('/x/p', page_id, '.php')",
    "concat('/dump/b', page_id, '.sql')",
    "concat('//a//', page_id, '/./b/')",
    "'/'",
    "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)",
])
_U = "case when i = 9 then url else concat('http://h.example', v) end"
ORACLES["decode_path"] = f"select page_id, i, url_decode(v) as decoded from {_PATHS}"
ORACLES["basename"] = rf"select page_id, i, regexp_extract(v, '[^/]*\z') as name from {_PATHS}"
ORACLES["dirname"] = rf"""select page_id, i, case when regexp_matches(h, '^/*\z') then h else regexp_replace(h, '/+\z', '') end as folder
  from (select *, regexp_extract(v, '(?s)^(.*/)', 1) h from {_PATHS})"""
ORACLES["has_ext"] = f"select page_id, i, {has_ext('v')} as has_ext from {_PATHS}"
ORACLES["site_path"] = f"select page_id, i, {site_path(_U)} as path from {_PATHS}"
ORACLES["cms_path"] = f"select page_id, i, {cms_path(_U)} as path, {cms_path(_U, True)} as backup_path from {_PATHS}"
ORACLES["relative_path"] = f"""select page_id, i, case when i%2=0 then 'f.css' else concat('../../wp-content/x/', page_id, '/f.css') end as rel
  from {_PATHS}"""
ORACLES["page_slug"] = f"select page_id, i, {slug(_U)} as slug from {_PATHS}"
ORACLES["post_id"] = f"select page_id, cast('0x' || substr(md5({PAGE}), 1, 8) as bigint) % 1000000 as post_id from pages"
ORACLES["asset_fallback_name"] = rf"""select page_id, i, case when regexp_extract(v, '[^/]*\z') = ''
  then concat('asset_', substr(md5({_U}), 1, 16)) else regexp_extract(v, '[^/]*\z') end as name from {_PATHS}"""
ORACLES["rfc822_date"] = "select event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') as date from events"
ORACLES["sql_date"] = "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as date from events"

# --- extraction -----------------------------------------------------------------------------------

_ANCHOR_LIST = r"""regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>', '', 'g'), '<a href="([^"]*)">', 1)"""
ORACLES["extract_anchors"] = f"""with {AUG} select page_id, i-1 as pos, a[i] as href from
  (select page_id, {_ANCHOR_LIST} a from aug), lateral (select unnest(range(1, len(a)+1)) i)"""
ORACLES["extract_asset_refs"] = f"with {ASSETS} select page_id, pos, tag, attr, href from refs"
ORACLES["extract_form_fields"] = """select page_id, 'redirect_to' as name, concat('/wp-admin/?u=', page_id, '&v=1') as value
  from pages where page_id%4=0 union all select page_id, 'testcookie', '1' from pages where page_id%4=0"""
ORACLES["extract_title"] = f"select page_id, {TITLE} as title from pages"
ORACLES["extract_main_content"] = f"with {AUG} select page_id, {CONTENT} as content from aug"
ORACLES["first_selector"] = """select page_id, case page_id%6 when 0 then '<article>' when 1 then '<main class="wrap">' when 2 then '<div id="content">'
  when 3 then '<div class="post content">' when 4 then '<section class="entry-content wide">' else '<body>' end as opening from pages"""
ORACLES["page_data"] = f"""select page_id, {PAGE} as url, {TITLE} as title, regexp_extract(html, '(?s)<article>.*?</article>') as content,
  {slug(PAGE)} as slug from pages"""

# --- predicates -----------------------------------------------------------------------------------

ORACLES["is_asset_url"] = rf"""with {ASSETS} select page_id, pos, tag, regexp_matches(asset_url, '{CMS_TYPES}') as is_asset,
  regexp_matches(regexp_replace(asset_url, '[?#].*', ''), '{CMS_TYPES}') as is_asset_without_query from assets"""
ORACLES["is_excluded"] = rf"""select page_id, i, regexp_matches({_U}, '^(.*wp-config\.php|.*wp-login\.php|.*\.sql|.*\.zip)\z') as cms,
  regexp_matches({_U}, '^.*\.(pdf|zip|exe)\z') as generic from {_PATHS}"""
ORACLES["asset_filter"] = f"with {ASSETS} select page_id, pos, {SAVED_CMS} as saved from assets"
ORACLES["content_type_gate"] = rf"""with {RESPONSES} select url, lower(content_type) like '%text/html%' as generic,
  lower(content_type) like '%text/html%' or regexp_matches(url, '\.(php|css|js)\z') as cms,
  lower(content_type) like '%text/html%' or regexp_matches(url, '\.(php|css|js|sql|zip)\z') as backup from responses"""
ORACLES["response_ok"] = f"with {RESPONSES} select url, status < 400 as ok from responses"
ORACLES["route_page_or_resource"] = "select page_id, case when page_id%10 = 9 then 'resource' else 'page' end as branch from pages"
ORACLES["exportable_page"] = rf"select page_id, i, regexp_matches({cms_path(_U)}, '(?s)[^/]\.html\z') as exportable from {_PATHS}"

# --- joins, aggregates, windows -------------------------------------------------------------------

CAPTURED = f"captured as (select distinct {HOST} as site, {PAGE} as url from pages)"
LINKED = f"{LINKS}, linked as (select distinct site, dst as url from links)"
ORACLES["unvisited"] = f"with {LINKED}, {CAPTURED} select site, url from linked except select site, url from captured"
ORACLES["frontier_except"] = f"""with {LINKED}, {CAPTURED} select site, count(*) as n
  from (select site, url from captured except select site, url from linked) group by site"""
ORACLES["visited_union"] = f"""with {LINKED}, {CAPTURED} select site, count(*) as n
  from (select site, url from captured union select site, url from linked) group by site"""
ORACLES["existing_anti"] = f"""with {CAPTURED} select site, path, url from (select site, {cms_path('url')} as path, url from captured) n
  where not exists (select 1 from captured c where c.site = n.site and {site_path('c.url', 'en')} = n.path)"""
ORACLES["rewrite_join"] = f"""with {ASSETS}, saved as (select page_id, pos, tag, href, {cms_path('src')} as own, {cms_path('asset_url')} as local
  from assets where {SAVED_CMS}) select page_id, pos, tag, href, {relative('own', 'local')} as rel_path from saved"""
ORACLES["path_conflicts"] = f"""with {CAPTURED}, v as (select site, unnest([url, concat(url, '/'), concat(url, '/more.html')]) as url from captured),
  f as (select distinct site, {cms_path('url')} as path, url from v),
  p as (select site, path, count(*) as n, min(url) as first_url from f group by 1, 2),
  s as (select site, string_split(path, '/') as steps from p),
  a as (select site, array_to_string(steps[1:k], '/') as path from s, lateral (select unnest(range(1, len(steps))) k)),
  g as (select site, path, count(*) as n from a group by 1, 2)
  select site, path, 'same_path' as conflict, n, first_url from p where n > 1
  union all select g.site, g.path, 'file_is_folder', g.n, p.first_url from g join p using (site, path)"""
ORACLES["crawl_count"] = f"with {LINKED} select site, count(*) as n from linked group by site"
ORACLES["distinct_urls"] = f"with {LINKED} select site, url from linked"
ORACLES["asset_manifest"] = f"""with {ASSETS} select site, asset_url, {cms_path('asset_url')} as path, kind, count(*) as n_refs,
  count(distinct page_id) as n_pages, min(page_id) as first_page from assets where {SAVED_CMS} group by 1, 2, 3, 4"""
ORACLES["asset_pages"] = f"""with {ASSETS}, refs_ as (select distinct site, asset_url, page_id from assets where {SAVED_CMS})
  select site, asset_url, page_id//32768 as block, count(*) as n_pages, string_agg(page_id%32768, ',' order by page_id) as pages from refs_ group by 1, 2, 3"""
ORACLES["asset_kind"] = f"""with {ASSETS_GENERIC} select page_id, pos, kind, {GENERIC_LOCAL} as local_path from assets
  where {SAVED_GENERIC}"""
ORACLES["retry_outcome"] = """with a as (select concat('res/', user_id) as url, event_type <> 'error' as ok,
    row_number() over (partition by user_id order by ts, event_id) as attempt from events),
  t as (select url, min(attempt) filter (where ok) as first_success, max(attempt) as tried from a where attempt <= 3 group by url)
  select url, coalesce(first_success, tried) as attempts, first_success, first_success is null and tried >= 3 as exhausted from t"""
ORACLES["path_winner"] = f"""with {ASSETS_GENERIC}, w as (select site, {GENERIC_LOCAL} as path, page_id as rank, asset_url as url from assets where {SAVED_GENERIC}),
  n as (select *, row_number() over (partition by site, path order by rank, url) as a,
    row_number() over (partition by site, path order by rank desc, url desc) as z from w)
  select site, path, rank, url, 'first' as keep from n where a = 1 union all select site, path, rank, url, 'last' from n where z = 1"""

# --- crawl ----------------------------------------------------------------------------------------

ORACLES["link_graph"] = f"""with {LINKS} select site, dst, count(*) as n_links, count(distinct page_id) as n_pages from links group by 1, 2"""


def tree(html: str, source: str, strip_slash: bool = False) -> str:
    """Tree pages, one per canonical URL, and their internal links."""
    src = PAGE_NO_SLASH if strip_slash else PAGE
    dst = "case when href like '/%' then concat('http://', site, href) else href end"
    return f"""tree as (select page_id, {d.TREE_URL} as url, {d.TREE_HTML} as html from {source}),
  own as (select page_id, {src} as src, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as site, {html} a from tree),
  idx as (select src as url, min(page_id) as page_id from own group by 1),
  tlinks as (select page_id, site, src, i-1 as pos, dst from (select page_id, site, src, i, {dst.replace('href', 'a[i]')} as dst
    from own, lateral (select unnest(range(1, len(a)+1)) i)) where regexp_extract(dst, '^[a-z]+://([^/?#]+)', 1) = site)"""


TREE = tree("regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)", "pages")
ORACLES["fetch_join"] = f"""with {TREE} select t.site, t.url, idx.page_id from (select distinct site, dst as url from tlinks) t
  left join idx using (url)"""


def visited(tables: str, fetched: str = "select page_id from idx", seeds: str = "") -> str:
    return f"""with recursive {tables}, edges as (select src, dst, min(pos) as pos from tlinks where page_id in ({fetched}) group by 1, 2),
  visited(site, url, depth, ord) using key (site, url) as (
    select site, url, 0::bigint, min(ord) from (select distinct site, concat('http://', site, '/') as url, [0, 0, 0]::bigint[] as ord from own {seeds}) group by 1, 2
    union select v.site, e.dst, min(v.depth) + 1, min(list_append(v.ord, e.pos)) from visited v join edges e on e.src = v.url
    where not exists (select 1 from recurring.visited r where r.site = v.site and r.url = e.dst) group by v.site, e.dst),
  ranked as (select site, url, depth, row_number() over (partition by site order by depth, ord) as rank from visited)"""


_CRAWL = visited(TREE)
ORACLES["crawl_reachability"] = f"{_CRAWL} select site, url, depth from ranked"
ORACLES["crawl_rank"] = f"{_CRAWL} select site, url, depth, rank from ranked"
ORACLES["max_pages_cap"] = f"{_CRAWL} select site, url, rank from ranked where rank <= 40"
ORACLES["link_outcomes"] = f"""with {AUG}, a as (select site, src, unnest({_ANCHOR_LIST}) as href from aug)
  select site, case when href like 'mailto:%' then 'not_crawlable' when href like 'https://other%' then 'off_site' else 'internal' end as outcome,
  count(*) as n from a group by 1, 2"""

# --- whole jobs -----------------------------------------------------------------------------------

SITE_PAGES = f"aug0 as (select page_id, url, {d.AUG_HTML} as html from pages)"
STATUS_404 = "page_id%10 = 9"
PDF = "page_id%13 = 12"


def job(paths: tuple[str, ...], endpoint: str, strip_slash: bool = False, extra: str = "") -> str:
    """Crawl of tree pages with assets under given seed paths and one possible API hit per site, without a cap that binds."""
    cut = (lambda p: p.rstrip("/")) if strip_slash else (lambda p: p)
    hit = "length(site)%4 <> 0 and length(site)%3 <> 0"
    if endpoint:
        extra += f" union all select distinct site, concat('http://', site, '{cut(endpoint)}'), [2, 1, 0]::bigint[] from own where {hit}"
    for i, p in enumerate(paths):
        extra += f" union all select distinct site, concat('http://', site, '/{cut(p)}'), [3, {i}, 0]::bigint[] from own"
    tables = f"{SITE_PAGES}, {tree(_ANCHOR_LIST, 'aug0', strip_slash)}"
    # A URL's response is the best of the pages that share it, by status and then by content type.
    tables += f""", sites as (select distinct site from own),
      resp as (select src as url, min({{'s': {d.RESPONSE_STATUS}, 't': {d.RESPONSE_TYPE}}}) as r from own group by 1
        union all select concat('http://', site, '/wp-includes/x', s, '.js'), {{'s': {d.SCRIPT_STATUS}, 't': 'text/javascript'}} from sites, range(3) x(s)
        union all select concat('http://', site, '/wp-blog-header.php'), {{'s': 200, 't': 'application/octet-stream'}} from sites),
      ok as (select i.page_id, i.url from idx i join resp using (url) where r.s < 400 and lower(r.t) like '%text/html%')"""
    return visited(tables, "select page_id from ok", extra)


_JOB_CMS = job(CMS_SEED_PATHS, "")
_API = r"'^http://[^/]+/api/?\z'"


# What the job keeps whatever the header says; in the CMS layouts a page without text is no page.
CMS_KEPT, BACKUP_KEPT, GENERIC_KEPT = r"\.(php|css|js)\z", r"\.(php|css|js|sql|zip)\z", r"^\z"


def log(kept: str) -> str:
    empty = "false" if kept == GENERIC_KEPT else "idx.page_id%17 = 12"
    outcome = rf"""case when resp.url is null then 'failed' when r.s >= 400 then 'failed'
      when lower(r.t) like '%text/html%' then case when {empty} then 'resource' else 'saved' end
      when regexp_matches(v.url, '{kept}') then 'resource' else 'skipped' end"""
    return f"""log as (select v.site, v.url, v.depth, v.rank, idx.page_id, {outcome} as outcome from ranked v
  left join resp on resp.url = v.url left join idx on idx.url = v.url)"""


_LOG = log(CMS_KEPT)
ORACLES["crawl_log"] = f"{_JOB_CMS}, {_LOG} select site, url, depth, rank, outcome from log"
# Every entry of the queue, in a crawl where some pages are never fetched.
_TRIED = _JOB_CMS.replace("where r.s < 400 and", "where i.page_id%11 <> 4 and r.s < 400 and")
_ALL_SEEDS = "select distinct site, concat('http://', site, '/') as url, 0 as parent, [0, 0, 0]::bigint[] as place from own" + "".join(
    f" union all select distinct site, concat('http://', site, '/{p}'), 0, [3, {i}, 0]::bigint[] from own" for i, p in enumerate(CMS_SEED_PATHS)
)
ORACLES["queue_log"] = f"""{_TRIED}, {_LOG.replace("case when resp.url is null", "case when idx.page_id%11 = 4 then 'failed' when resp.url is null")},
  entries as ({_ALL_SEEDS} union all select o.site, case when o.a[i] like '/%' then concat('http://', o.site, o.a[i]) when o.a[i] like 'mailto:%' then null else o.a[i] end,
    s.rank, [i - 1]::bigint[] from (select site, page_id, a, unnest(range(1, len(a) + 1)) as i from own) o join log s using (page_id) where s.outcome = 'saved'),
  placed as (select *, row_number() over (partition by site order by parent, place) as entry, row_number() over (partition by site, url order by parent, place) as n from entries)
  select p.site, p.entry, p.parent, p.url, case when p.url is null then 'not_crawlable' when regexp_extract(p.url, '^[a-z]+://([^/?#]+)', 1) <> p.site then 'off_site'
    when n > 1 then 'duplicate' else l.outcome end as outcome,
    case when n = 1 and idx.page_id is not null and regexp_extract(p.url, '^[a-z]+://([^/?#]+)', 1) = p.site then case when idx.page_id%11 = 4 then 3 else idx.page_id%3 + 1 end end as attempts
  from placed p left join log l on l.site = p.site and l.url = p.url left join idx on idx.url = p.url"""
_LISTED = """ union all select site, src, [1, page_id//64, row_number() over (partition by site, page_id//64 order by page_id) - 1]::bigint[]
  from own where page_id%7 = 3"""
ORACLES["crawl_from_sitemaps"] = f"{job(CMS_SEED_PATHS, '', extra=_LISTED)}, {_LOG} select site, url, depth, rank, outcome from log"
ORACLES["outcome_counts"] = f"{_JOB_CMS}, {_LOG} select site, outcome, count(*) as n from log group by 1, 2"

# Rewritten pages: the four kinds of saved references, each at its known place.
def own_pages(own: str) -> str:
    return rf"""(select *, {own} as own, regexp_extract(src, '(?s)^[a-z]+://[^/]+(/(?:.*/)?)', 1) as folder from aug)"""


def _swap(text: str, attr: str, href: str, local: str) -> str:
    return f"""replace({text}, concat('{attr}="', {href}, '"'), concat('{attr}="', {relative('own', local)}, '"'))"""


_HREFS = (
    ("href", "concat('/wp-content/themes/t', page_id%7, '/style.css')"),
    ("href", "concat('../fonts/f', page_id%2, '.woff2')"),
    ("src", "concat('js/app', page_id%5, '.js')"),
    ("src", "concat('/img/p', page_id%11, '.png')"),
)
_CMS_FILES = (
    "concat('wp-content/themes/t', page_id%7, '/style.css')",
    r"ltrim(concat(regexp_replace(folder, '[^/]+/\z', ''), 'fonts/f', page_id%2, '.woff2'), '/')",
    "ltrim(concat(folder, 'js/app', page_id%5, '.js'), '/')",
    "concat('img/p', page_id%11, '.png')",
)
_GENERIC_FILES = (
    "'css/style.css'",
    "concat('fonts/f', page_id%2, '.woff2')",
    "concat('js/app', page_id%5, '.js')",
    "concat('images/p', page_id%11, '.png')",
)


def _rewritten(files_: tuple[str, ...]) -> str:
    text = "html"
    for (attr, href), file in zip(_HREFS, files_):
        text = _swap(text, attr, href, file)
    return text


ORACLES["rewrite_pages"] = f"""with {AUG} select page_id, own as path, {_rewritten(_CMS_FILES)} as content
  from {own_pages(cms_path("src"))}"""
ORACLES["site_files_sink"] = f"""with {AUG_GENERIC}, w as (select site, own as path, src as url, md5({_rewritten(_GENERIC_FILES)}) as content,
    row_number() over (partition by site, own order by page_id desc) as n from {own_pages(site_path("src"))})
  select site, path, url, content from w where n = 1"""

ORACLES["site_files_upsert"] = f"""with {AUG_GENERIC}, w as (select site, own as path, src as url, page_id as rank, page_id%3 = 0 as again,
    md5(html) as content, row_number() over (partition by site, own order by page_id%3 = 0 desc, page_id desc) as n from {own_pages(site_path("src"))})
  select site, path, url, rank, case when again then concat('new ', content) else content end as content from w where n = 1"""


def files(head: str, own_path, local: str, types: str, kept: str) -> str:
    ref_tables = ASSETS.replace(AUG, f"aug as (select page_id, {d.TREE_HOST} as site, own.src, tree.html from tree join own using (page_id))").replace(d.TREE_HOST, "own.site")
    return f"""{head}, {log(kept)}, saved as (select site, url, page_id, rank, {own_path('url')} as path from log where outcome = 'saved'),
  pw as (select site, path, arg_max(url, rank) as src_url from saved group by 1, 2), {ref_tables},
  al as (select a.site, {local} as path, kind, asset_url, s.rank from assets a join saved s on s.page_id = a.page_id
    where internal and regexp_matches(asset_url, '{types}')
    union all select site, {own_path('url')}, 'resource', url, rank from log where outcome = 'resource'),
  aw as (select site, path, kind, asset_url, row_number() over (partition by site, path order by rank, asset_url, kind) as w from al)
  select site, path, 'page' as kind, src_url from pw
  union all select site, path, kind, asset_url from aw where w = 1 and (site, path) not in (select (site, path) from pw)"""


ORACLES["clone_cms_site"] = files(_JOB_CMS, cms_path, cms_path("asset_url"), CMS_TYPES, CMS_KEPT)
ORACLES["clone_backup_site"] = files(
    _JOB_CMS, lambda u: cms_path(u, True), cms_path("asset_url", True), CMS_TYPES.replace("|ico)", "|ico|sql|zip)"), BACKUP_KEPT
)
ORACLES["clone_site"] = files(job((), "/api/", True), site_path, GENERIC_LOCAL, GENERIC_TYPES, GENERIC_KEPT)
ORACLES["export_cms_site"] = rf"""{_JOB_CMS}, {_LOG}, saved as (select site, url, page_id from log where outcome = 'saved'
    and regexp_matches({cms_path('url')}, '(?s)[^/]\.html\z'))
  select site, url as link, {TITLE} as title, {slug('url')} as post_name,
    cast('0x' || substr(md5(url), 1, 8) as bigint) % 1000000 as post_id, md5({CONTENT}) as content
  from (select s.site, s.url, s.page_id, t.html from saved s join tree t on t.page_id = s.page_id)"""
ORACLES["page_collection"] = rf"""{_JOB_CMS}, {_LOG}, saved as (select site, url, page_id, rank from log where outcome = 'saved'
    and regexp_matches({cms_path('url')}, '(?s)[^/]\.html\z'))
  select site, rank, url, {TITLE} as title, {slug('url')} as slug, md5({CONTENT}) as content
  from (select s.site, s.url, s.page_id, s.rank, t.html from saved s join tree t on t.page_id = s.page_id)"""

_PATH = cms_path(PAGE)
RECORDS = rf"""records as (select page_id, {HOST} as site, {PAGE} as url, {TITLE} as title,
  regexp_extract(html, '(?s)<article>.*?</article>') as content, {slug(PAGE)} as slug from pages
  where regexp_matches({_PATH}, '(?s)[^/]\.html\z') and page_id in (select min(page_id) from pages group by {PAGE}))"""
ORACLES["wxr_items"] = f"""with {RECORDS}, items as (select *, cast('0x' || substr(md5(url), 1, 8) as bigint) % 1000000 as post_id from records)
  select site, title, url as link, 'Mon, 01 Jan 2024 00:00:00 +0000' as pub_date, 'admin' as creator, url as guid, '' as description,
  content as content_encoded, post_id, '2024-01-01 00:00:00' as post_date, '2024-01-01 00:00:00' as post_date_gmt,
  'closed' as comment_status, 'closed' as ping_status, slug as post_name, 'publish' as status, cast(0 as bigint) as post_parent, cast(0 as bigint) as menu_order,
  'page' as post_type, '' as post_password, cast(0 as bigint) as is_sticky,
  row_number() over (partition by site, post_id order by url) as collision_rank from items"""
ORACLES["wxr_channel"] = f"""with {SITES}, {RECORDS} select site, site as title, concat(origin, '/') as link,
  'Exported WordPress content' as description, 'Mon, 01 Jan 2024 00:00:00 +0000' as pub_date, 'en-US' as language, '1.2' as wxr_version
  from sites where site in (select site from records)"""
ORACLES["wxr_gate"] = f"with {RECORDS} select site, count(*) as n_pages from records group by site"
ORACLES["pages_json_export"] = f"with {RECORDS} select site, title, content, slug, 'publish' as status from records"
ORACLES["wxr_files"] = f"""with {RECORDS} select site, title, url as link, md5(content) as content,
  id + 1000000 * (row_number() over (partition by site, id order by url) - 1) as post_id, slug as post_name, 'publish' as status
  from (select *, cast('0x' || substr(md5(url), 1, 8) as bigint) % 1000000 as id from records)"""
ORACLES["wxr_import_files"] = rf"""{_JOB_CMS}, {_LOG}, saved as (select site, url, page_id, rank,
    row_number() over (partition by site order by rank) - 1 as i, cast('0x' || substr(md5(url), 1, 8) as bigint) % 1000000 as id
    from log where outcome = 'saved' and regexp_matches({cms_path('url')}, '(?s)[^/]\.html\z')),
  ids as (select *, id + 1000000 * (row_number() over (partition by site, id order by url) - 1) as post_id from saved)
  select site, i//16 as part, i%16 as place, site as channel_title, concat('http://', site, '/') as base, '1.2' as version,
    {TITLE} as title, url as link, md5({CONTENT}) as content, post_id, {slug('url')} as post_name
  from (select s.*, t.html from ids s join tree t on t.page_id = s.page_id)"""
ORACLES["asset_sink"] = f"""with {ASSETS}, w as (select site, {cms_path('asset_url')} as path, asset_url as url, page_id as rank, kind
  from assets where {SAVED_CMS} and length(asset_url)%7 <> 0) select site, path, url, rank, kind, md5(concat('bytes of ', url)) as content
  from (select *, row_number() over (partition by site, path order by rank, url, kind) as n from w) where n = 1"""
ORACLES["stream_discover_links"] = f"with {LINKED} select site, url from linked"

def _recent() -> str:
    """On-time URLs of each batch that were not told in the two batches before: state is evicted at the end of the batch that follows them."""
    steps = []
    for b in range(d.CAPTURE_BATCHES):
        told = "".join(f" except select site, url from e{k}" for k in (b - 1, b - 2) if k >= 0)
        late = " and page_id%13 <> 5" if b >= 2 else ""
        steps.append(f"e{b} as (select distinct site, dst as url from links where page_id%{d.CAPTURE_BATCHES} = {b}{late}{told})")
    every = " union all ".join(f"select site, url from e{b}" for b in range(d.CAPTURE_BATCHES))
    return f"with {LINKS}, {', '.join(steps)} select site, url, count(*) as times from ({every}) group by 1, 2"


ORACLES["stream_recent_links"] = _recent()
