"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from .html_text import op5_html_text
from .jaccard_join import op3_ngram_jaccard_join
from .line_crf import op7_line_crf
from .mixing import op9_entropy_mixing
from .nearest import op10_nearest
from .packing import op2_best_fit_packing
from .passage_dedup import op8_passage_dedup
from .pii import op4_pii
from .quality_rules import op1_quality_rules
from .url_filter import op6_url_filter

OPERATORS = (op1_quality_rules, op2_best_fit_packing, op3_ngram_jaccard_join, op4_pii, op5_html_text, op6_url_filter, op7_line_crf, op8_passage_dedup, op9_entropy_mixing, op10_nearest)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op6_url_filter"] = r"""
with u as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from u),
rules(rule_host, rule_path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits as (
  select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(verdict, length(rule_host || rule_path)) as verdict
  from h join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from h left join hits using (page_id)
"""

ORACLE_SQL["op1_quality_rules"] = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (
  select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
p as (select doc_id, unnest(range(1, len(ws) - 3)) as i, ws from w),
k as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as key from p),
twice as (select doc_id, i from k qualify count(*) over (partition by doc_id, key) > 1),
covered as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 5)) as j from twice) group by doc_id),
c as (
  select doc_id, t, ws, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
         len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines, coalesce(n, 0) as n_repeat_words
  from w left join covered using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c),
often as (select doc_id, max(n) as n_often from (select doc_id, x, count(*) as n from (select doc_id, unnest(ws) as x from w) group by doc_id, x) group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or 10 * len(regexp_extract_all(t, '[!?]')) > 3 * n_words or len(regexp_extract_all(t, '[A-Z]')) > len(regexp_extract_all(t, '[a-z]'))
    or 10 * n_dup_lines > 3 * n_lines or not (2 * n_words <= word_chars and word_chars <= 15 * n_words) or 5 * coalesce(n_often, 0) > 2 * n_words
    or 10 * len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]') or regexp_matches(x, '^[^\x00-\x7F]'))) < 6 * n_words
    or 10 * (len(regexp_extract_all(t, '[.][.][.]')) + len(regexp_extract_all(t, '…'))) > 3 * n_words) as kept
from b left join often using (doc_id)
"""

ORACLE_SQL["op3_ngram_jaccard_join"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, hash(x) as h from (select doc_id, case when len(ws) < 4 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 3], ' ') end as x
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from w where len(ws) > 0))),
n as (select doc_id, count(*) as n from s group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, e.b from reach r join edges e on r.other = e.a)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(r, w.doc_id) as component_id
from w left join n using (doc_id) left join (select doc_id, min(other) as r from reach group by doc_id) using (doc_id)
"""
