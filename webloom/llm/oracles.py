"""SQL twins, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op5_url_filters"] = r"""
with parts as (
  select page_id,
    case when instr(url, '://') > 0
         then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         else '' end as host,
    case when instr(url, '://') > 0
         then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
sites as (
  select *, coalesce(nullif(regexp_extract(host, '[^.]+[.][^.]+[.][^.]+$', 0), ''), host) as site,
    case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
         when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
         when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from parts),
listed as (
  select name || '.' || ending as site
  from (values ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) n(name),
       (values ('example.com'), ('example.net'), ('example.org')) e(ending))
select page_id, host, path, rule,
  case when rule in ('www.example.com/en/', 'com/') then 'allow'
       when rule is not null then 'block'
       when site in (select site from listed) then 'block' else 'allow' end as verdict,
  site, site in (select site from listed) as listed
from sites
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

ORACLES["op6_ngram_join"] = rf"""
with recursive dw as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i+3], ' ') as s
  from dw, lateral (select unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i) where len(w) > 0),
sets as (select doc_id, count(*) as n, md5(string_agg(s, '|' order by s)) as h from sh group by 1),
met as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from met join sets p on p.doc_id = x join sets q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
sym as (select x, y from links union select y, x from links),
reach(doc_id, other) as (
  select doc_id, doc_id from documents union select reach.doc_id, sym.y from reach join sym on sym.x = reach.other)
select r.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id, coalesce(min(r.doc_id) over (partition by s.h, if(s.h is null, r.doc_id, 0)), r.doc_id) as class_id
from (select doc_id, min(other) as component_id from reach group by 1) r left join sets s using (doc_id)
"""

ORACLES["op8_decontamination"] = rf"""
with win as (select distinct cast(item_id as varchar) as item, least(len(w), 10) as n, array_to_string(w[i:i+least(len(w), 10)-1], ' ') as k
  from (select item_id, {_ALNUM} as w from benchmark), lateral (select unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i) where len(w) > 0),
dw as (select doc_id, {_ALNUM} as w from documents),
sizes as (select distinct n from win),
pos as (select doc_id, i, n, array_to_string(w[i:i+n-1], ' ') as k from (select doc_id, w, n from dw, sizes), lateral (select unnest(range(1, len(w) - n + 2)) as i)),
hit as (select doc_id, i, n, item from pos join win using (n, k)),
covered as (select doc_id, count(distinct j) as n_hit from (select distinct doc_id, i, n from hit), lateral (select unnest(range(i, i + n)) as j) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from hit) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (doc_id) left join items using (doc_id)
"""

#: measure, value, slack, whether the lower fence counts
_MEASURES = (
    ("word_length", "100 * word_chars // greatest(n_words, 1)", 100, True),
    ("symbols", "10000 * n_symbols // greatest(word_chars, 1)", 300, False),
    ("dup_lines", "10000 * n_dup_lines // greatest(n_lines, 1)", 5000, False),
    ("repeats", "10000 * n_repeat_words // greatest(n_words, 1)", 4000, False),
)


def _fences(keys: str) -> str:
    group = f"{keys}, measure" if keys else "measure"
    return f"""select {group}, any_value(size) as size, min(bin) filter (where 4 * upto >= size) as q1, min(bin) filter (where 4 * upto >= 3 * size) as q3
      from (select {group}, bin, sum(n) over (partition by {group}) as size, sum(n) over (partition by {group} order by bin) as upto
        from (select {group}, bin, sum(n) as n from sketch group by {group}, bin)) group by {group}"""


ORACLES["op9_quality_rules"] = rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
  from (select doc_id, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, {_SPACED}) group by 1),
grams as (select doc_id, i, array_to_string(w[i:i+2], ' ') as g from d, lateral (select unnest(range(1, len(w) - 1)) as i)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams) where c > 1),
rep as (select doc_id, count(distinct j) as n_repeat_words from twice, lateral (select unnest(range(i, i + 3)) as j) group by 1),
base as (select doc_id, lang, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words from d left join lines using (doc_id) left join rep using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base),
v as ({" union all ".join(f"select doc_id, lang, source, base_failed, '{m}' as measure, {e} as v, {s} as slack, {str(two).lower()} as two from b" for m, e, s, two in _MEASURES)}),
sketch as (select lang, source, measure, (v >> greatest(length(bin(v)) - 7, 0)::bigint) << greatest(length(bin(v)) - 7, 0)::bigint as bin, count(*) as n
  from v where not base_failed group by all),
f1 as ({_fences("lang, source")}), f2 as ({_fences("lang")}), f3 as ({_fences("")}),
judged as (select v.doc_id, bool_and(v.v <= q3 + 3 * (q3 - q1) + v.slack and (not v.two or v.v >= q1 - 3 * (q3 - q1) - v.slack)) as inside
  from (select v.*, case when f1.size >= 200 then f1.q1 when f2.size >= 200 then f2.q1 else f3.q1 end as q1,
      case when f1.size >= 200 then f1.q3 when f2.size >= 200 then f2.q3 else f3.q3 end as q3
    from v left join f1 on f1.measure = v.measure and f1.lang is not distinct from v.lang and f1.source is not distinct from v.source
      left join f2 on f2.measure = v.measure and f2.lang is not distinct from v.lang left join f3 on f3.measure = v.measure) v
  where not base_failed group by 1)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, coalesce(inside, false) as kept
from b left join judged using (doc_id)
"""
