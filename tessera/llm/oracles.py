"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from tessera.llm.common import ASCII_UPPER
from tessera.llm.url_filter import RULES, TRACKING, UNWANTED, rule_name

#: ASCII white space in a class of a regular expression, and A-Z lower-cased.
SPACE = "[\\x20\\x09-\\x0D]"


def lowered(c: str) -> str:
    return f"translate({c}, '{ASCII_UPPER}', '{ASCII_UPPER.lower()}')"


def words_of(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '{SPACE}+'), lambda x: x <> '')"


def op1() -> str:
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, 10 * (i // 8) + 1, 10) as ubigint) >> (35 - 5 * (i % 8))) % 32 as int) + 1, 1)"
    return f"""
with p as (select page_id, coalesce(html, '') body, sha1(coalesce(html, '')) h from pages),
f as (select *, min(page_id) over (partition by body) first_id from p)
select page_id, strlen(body) payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {letter}), '') payload_digest,
  case when page_id <> first_id then 'revisit' else 'response' end record_type, case when page_id <> first_id then first_id end refers_to from f"""


def op3() -> str:
    fits = lambda r: f"(host = '{r[0]}' or ends_with(host, '.{r[0]}')) and starts_with(path, '{r[1]}')"
    rules = sorted(RULES, key=lambda r: -len(rule_name(*r[:2])))
    rule = "case " + " ".join(f"when {fits(r)} then '{rule_name(*r[:2])}'" for r in rules) + " end"
    ruled = "case " + " ".join(f"when {fits(r)} then '{r[2]}'" for r in rules) + " end"
    labels = ", ".join(f"'{x}'" for x in UNWANTED)
    return f"""
with parts as (
  select page_id, {lowered("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path,
    array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), ''), '&'), lambda p: p <> '' and not regexp_matches(p, '{TRACKING}'))), '&') params
  from pages),
bare as (select *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)$', ''), '^www\\.', '') site from parts),
named as (select *, case when site = '' then '' else site || regexp_replace(path, '/+$', '') || case when params <> '' then '?' || params else '' end end canonical from bare),
listed as (select distinct canonical from named where canonical <> '' and list_has_any(string_split(host, '.'), [{labels}])),
judged as (select n.*, {rule} rule, {ruled} ruled, l.canonical is not null listed from named n left join listed l using (canonical))
select page_id, host, path, rule, coalesce(ruled, case when listed then 'block' else 'allow' end) verdict, listed from judged"""


def op5() -> str:
    return f"""
with lines as (select d.row, d.doc_id, u.i, u.line, {lowered("trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} key
  from (select row_number() over () as row, doc_id, coalesce(text, '') as body from documents) d, lateral (select unnest(string_split(d.body, chr(10))) line, generate_subscripts(string_split(d.body, chr(10)), 1) i) u),
often as (select key, max(doc_id) keeper from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
judged as (select l.*, coalesce(o.keeper <> l.doc_id, false) lost from lines l left join often o on l.key = o.key)
select doc_id, count(*) n_lines, count(*) filter (where lost) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not lost), '')) kept_sha256
from judged group by row, doc_id"""


def op9() -> str:
    shingles = lambda t, i: f"select {i}, unnest(list_distinct(case when len(w) between 1 and 4 then [w] else list_transform(range(1, len(w) - 3), lambda k: w[k:k + 4]) end)) s from (select {i}, {words_of(lowered('text'))} w from {t})"
    return f"""
with items as ({shingles("benchmark", "item_id")}), docs as ({shingles("documents", "doc_id")}), sizes as (select item_id, count(*) n from items group by 1)
select doc_id, item_id, count(*) n_shared, any_value(n) n_shingles from items join docs using (s) join sizes using (item_id) group by 1, 2 having 100 * count(*) >= 80 * any_value(n)"""


def op10() -> str:
    sets = f"select doc_id, unnest(list_distinct(case when len(w) in (1, 2) then [w] else list_transform(range(1, len(w) - 1), lambda k: w[k:k + 2]) end)) s from (select doc_id, {words_of(lowered('text'))} w from documents)"
    return f"""
with recursive sets as ({sets}), sizes as (select doc_id, count(*) n from sets group by 1),
met as (select a.doc_id x, b.doc_id y, count(*) both_ from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from met join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * both_ >= 90 * (p.n + q.n - both_)),
edges as (select x, y from links union select y, x from links),
reach as (select distinct x, x as y from edges union select r.x, e.y from reach r join edges e on r.y = e.x)
select d.doc_id, coalesce(n, 0) n_shingles, coalesce(component, d.doc_id) component_id from documents d left join sizes using (doc_id) left join (select x as doc_id, min(y) component from reach group by 1) using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": op1(), "op10_ngram_jaccard": op10(), "op3_url_filter": op3(), "op5_line_dedup": op5(), "op9_decontamination": op9()}
