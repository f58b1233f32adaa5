"""Named queries over the citation corpus and the documents, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import bibliography, citations, lines, meta, pages, paragraphs, zones
from . import fixtures

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = 2026


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- plans shared by queries


def zoned(s: SparkSession, d: str) -> DataFrame:
    return zones.split_zones(fixtures.lines(s, d))


def listed(s: SparkSession, d: str) -> DataFrame:
    return bibliography.entries(zoned(s, d))


def compared(s: SparkSession, d: str) -> DataFrame:
    z = zoned(s, d)
    return citations.compare(bibliography.entries(z), citations.first_citations(citations.brackets(z)))


def starts(s: SparkSession, d: str) -> DataFrame:
    return zoned(s, d).where("line_no = biblio_start").select("doc_id", F.col("page").alias("start_page"))


# ---- oracle SQL: common table expressions that build on one another

BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _any(column: str, heads) -> str:
    return "(" + " or ".join(f"starts_with({column}, '{h}')" for h in heads) + ")"


_LINES = f"l0 as ({fixtures.SQL}), l as (select *, regexp_replace(upper(trim(line)), '\\s+', ' ', 'g') as n from l0)"
_ZONED = f"""{_LINES},
zs as (select doc_id, max(line_no) as biblio_start from l where {_any("n", zones.HEADERS)} group by doc_id),
ze as (select l.doc_id, min(line_no) as biblio_end from l join zs using (doc_id) where line_no > biblio_start and {_any("n", zones.STOPS)} group by l.doc_id),
z as (select l.doc_id, line_no, line, page, biblio_start, biblio_end,
        case when biblio_start is null then null when line_no < biblio_start then 'body' when biblio_end is null or line_no < biblio_end then 'bibliography' else 'after' end as zone
      from l left join zs using (doc_id) left join ze using (doc_id))"""
_ENTRIES = f"""{_ZONED},
e0 as (select *, regexp_extract(line, '^\\s*(?:(\\d+)\\.\\s*(.*)|(?:\\[(\\d+)\\])\\s*(.*))$', ['a', 'b', 'c', 'd']) as g from z where zone = 'bibliography'),
e1 as (select *, try_cast(nullif(g.a || g.c, '') as bigint) as num, trim(g.b || g.d) as txt from e0),
e2 as (select *, coalesce(num between 1 and 999 and (txt = '' or regexp_matches(txt, '^\\pL')), false) as is_start from e1),
e3 as (select *, sum(is_start::int) over (partition by doc_id order by line_no) as seg, case when is_start then txt else trim(line) end as piece from e2),
e4 as (select doc_id, seg, max(num) filter (is_start) as num, string_agg(piece, ' ' order by line_no) filter (piece <> '') as entry from e3 where seg > 0 group by doc_id, seg),
entries as (select doc_id, num::int as num, arg_max(entry, seg) as entry from e4 where entry is not null group by doc_id, num)"""
_CITED = f"""b0 as (select doc_id, string_agg(line, ' ' order by line_no) as f from z where zone = 'body' group by doc_id),
b1 as (select doc_id, regexp_extract_all(f, '[\\[\\x{{F05B}}][\\d\\s;,\\-–−.сСcC]+[\\]\\x{{F05D}}]') as bs from b0),
brackets as (select doc_id, (unnest(generate_series(1, len(bs))) - 1)::int as pos, unnest(bs) as bracket from b1),
t0 as (select *, substr(bracket, 2, length(bracket) - 2) as c from brackets),
t1 as (select doc_id, pos, bracket, unnest(case when contains(c, ';') then list_transform(string_split(c, ';'), lambda g: string_split(g, ',')[1]) else string_split(c, ',') end) as tok from t0),
t2 as (select doc_id, pos, bracket, trim(regexp_replace(trim(tok), '[a-zA-Z\\x{{400}}-\\x{{4FF}}](?s:.*)', '')) as tok from t1),
t3 as (select *, try_cast(regexp_extract(tok, '^(\\d+)\\s*[\\-–−]\\s*(\\d+)$', 1) as bigint) as lo, try_cast(regexp_extract(tok, '^(\\d+)\\s*[\\-–−]\\s*(\\d+)$', 2) as bigint) as hi from t2),
cites as (select distinct doc_id, pos, bracket, unnest(case when lo <= hi and hi - lo <= 200 then generate_series(lo, hi) when regexp_matches(tok, '^\\d+$') then [try_cast(tok as bigint)] else [] end) as num from t3),
firsts as (select doc_id, num, arg_min(bracket, pos) as bracket from cites group by doc_id, num)"""
_COMPARED = f"""{_ENTRIES}, {_CITED},
cmp as (select doc_id, num, entry, bracket, case when bracket is null then 'orphan' when entry is null then 'phantom' else 'used' end as status
  from (select doc_id, num::bigint as num, entry from entries) full outer join firsts using (doc_id, num))"""
_YEARS = f"""{_ENTRIES},
years as (select doc_id, num, entry, coalesce(
    try_cast(regexp_extract(entry, ',\\s*(1[89]\\d{{2}}|20[0-2]\\d)\\s*[.–\\-]', 1) as int), try_cast(regexp_extract(entry, '\\(\\s*(1[89]\\d{{2}}|20[0-2]\\d)\\s*\\)', 1) as int),
    try_cast(regexp_extract(entry, ',\\s*(1[89]\\d{{2}}|20[0-2]\\d)\\s*$', 1) as int),
    list_extract(list_transform(list_filter(range(1, length(entry) - 2), lambda i: regexp_matches(substr(entry, i, 4), '^(1[89]\\d{{2}}|20[0-2]\\d)$')
      and not regexp_matches(substr(entry, greatest(i - 2, 1), (least(i, 3) - 1)::bigint), '(\\d\\.|[\\pL\\pN_])$') and not regexp_matches(substr(entry, i + 4, 2), '^([\\pL\\pN_]|\\.\\d)')),
      lambda i: substr(entry, i, 4)::int), 1)) as year from entries)"""


def _hits(ps) -> str:
    return " + ".join(f"regexp_matches(entry, '{p}')::int" for p in ps)


_STYLE = f"""{_ENTRIES},
styles as (select doc_id, num, entry, case when ({_hits(bibliography.OTHER)}) > 0 then 'other' when s >= 2 or (s >= 1 and w >= 1) then 'dstu' when s = 1 or w >= 1 then 'partial' else 'other' end as status
  from (select *, {_hits(bibliography.STRONG)} as s, {_hits(bibliography.WEAK)} as w from entries))"""


def _trigger(heads, exact: bool, c: str = "line") -> str:
    n = f"regexp_replace(regexp_replace(upper(trim({c})), '\\s+', ' ', 'g'), '[.,:;!?]+$', '')"
    hit = f"{n} in ({', '.join(repr(h) for h in heads)})" if exact else _any(n, heads)
    return f"({hit} and ((length(trim({c})) < 60 and len(regexp_extract_all({c}, '\\S+')) <= 8) or (upper(trim({c})) = trim({c}) and regexp_matches({c}, '\\pL'))))"


_TOC = "regexp_matches(trim({c}), '\\.{{3,}}\\s*\\d*\\s*$')"
_TRIGGERS = f"""{_ZONED},
tr as (select doc_id, line_no, line, page, {_TOC.format(c="line")} as is_toc, {_trigger(paragraphs.ENDS, True)} as is_end, {_trigger(paragraphs.INTRO, True)} as is_intro, {_trigger(paragraphs.CHAPTERS, False)} as is_chapter from z)"""
_ABBR = f"regexp_replace({{t}}, '(?i)(^|[^\\pL\\pN_])({paragraphs.ABBREVIATIONS})\\.', '\\1\\2~', 'g')"


def _sentences(t: str) -> str:
    masked = _ABBR.format(t=_ABBR.format(t=t))
    masked = f"regexp_replace({masked}, '([А-ЯІЇЄҐA-Z])\\.', '\\1~', 'g')"
    return f"(len(regexp_extract_all({masked}, '[.!?]{WS}+[А-ЯІЇЄҐA-Z]')) + 1)::int"


_DOC_LINES = f"""d0 as (select doc_id, generate_subscripts(x, 1) as pos, unnest(x) as raw from (select doc_id, regexp_split_to_array(text, '{BREAKS}') as x from documents)),
d1 as (select doc_id, pos, regexp_replace(raw, '{WS}+$', '') as line from d0),
dl as (select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as line_no, line from d1 where line <> '')"""
_PARAS = f"""{_DOC_LINES},
p0 as (select doc_id, (line_no // 40 + 1)::int as page, line_no, regexp_replace(line, '^{WS}+', '') as t, (14 * line_no + 40 * (line_no // 7))::double as top from dl),
p1 as (select *, coalesce(top - (lag(top) over w + 12) > 18, false)::int as cut from p0 window w as (partition by doc_id, page order by line_no)),
p2 as (select *, sum(cut) over (partition by doc_id, page order by line_no) as seg from p1),
p3 as (select doc_id, page, seg, regexp_replace(string_agg(t, ' ' order by line_no), '{WS}+', ' ', 'g') as text from p2 group by doc_id, page, seg),
paras as (select doc_id, (row_number() over (partition by doc_id order by page, seg) - 1)::int as para_index, page, text, {_sentences("text")} as sentence_count from p3 where length(text) >= 80 and regexp_matches(text, '{paragraphs.LETTER}'))"""
_STYLED = f"""{_LINES},
s0 as (select doc_id, line_no, line, regexp_matches(line, '^(Слово|Речення)') as k, starts_with(line, 'РОЗДІЛ') as h from l),
s1 as (select *, case when k then line_no // 10 * 10 + 9 else line_no end as b from s0),
styled as (select doc_id, min(line_no) as para_no, case when bool_or(h) then 'Heading 1' else 'Normal' end as style, string_agg(line, ' ' order by line_no) as text from s1 group by doc_id, b, k),
s2 as (select *, contains(style, 'Heading') as heading, {_TOC.format(c="text")} as toc from styled),
s3 as (select *, max((not toc and {_trigger(paragraphs.ENDS, True, "text")})::int) over w as closed, max((not toc and {_trigger(paragraphs.CHAPTERS, False, "text")})::int) over w as opened,
  last_value(case when heading and text <> '' then text end ignore nulls) over w as context_heading from s2 window w as (partition by doc_id order by para_no rows unbounded preceding)),
docx as (select doc_id, (row_number() over (partition by doc_id order by para_no) - 1)::int as para_index, context_heading, text, {_sentences("text")} as sentence_count from s3
  where closed = 0 and opened = 1 and not heading and not toc and length(text) >= 80 and regexp_matches(text, '{paragraphs.LETTER}'))"""
_HAS = "regexp_matches(text, '[\\[\\x{F05B}][\\d\\s;,\\-–−.сСcC]+[\\]\\x{F05D}]')"
_WORDS = f"""{_LINES},
w0 as (select doc_id, page, line_no as block_no, generate_subscripts(x, 1) - 1 as pos, unnest(x) as text from (select *, string_split(line, ' ') as x from l)),
w1 as (select doc_id, page, block_no, (block_no * 1000 + pos)::int as word_no, text, coalesce((block_no <> lag(block_no) over (partition by doc_id, page order by block_no, pos))::int, 0) as turn from w0),
w2 as (select *, coalesce(sum(length(text) + 1) over (partition by doc_id, page order by word_no rows between unbounded preceding and 1 preceding), 0) + sum(turn) over (partition by doc_id, page order by word_no) as s from w1),
pt as (select doc_id, page, string_agg(case when turn = 1 then chr(10) else '' end || text || ' ', '' order by word_no) as text from w1 group by doc_id, page),
m0 as (select doc_id, page, text, regexp_extract_all(text, '(?s)[\\[\\x{{F05B}}]\\s*\\d[^\\]\\x{{F05D}}]{{0,250}}[\\]\\x{{F05D}}]') as ms, regexp_split_to_array(text, '(?s)[\\[\\x{{F05B}}]\\s*\\d[^\\]\\x{{F05D}}]{{0,250}}[\\]\\x{{F05D}}]') as gs from pt),
m1 as (select doc_id, page, unnest(generate_series(1, len(ms))) as k, ms, gs from m0),
m as (select doc_id, page, (k - 1)::int as match_no, list_sum(list_transform(gs[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda g: length(g))), 0) as ms0, length(ms[k]) as n from m1)"""


# ---- sources and guards


@query(f"with {_DOC_LINES} select doc_id, line_no, line, 1::int as page from dl")
def document_lines(s, d):
    return lines.split_lines(fixtures.table(s, d, "documents").select("doc_id", F.lit(1).alias("page"), "text"))


@query(f"""with p as (select doc_id, text from documents union all select -1, chr(10) || chr(12) || chr(160) || chr(8195) union all select -1, null)
select doc_id, case when sum(length(regexp_replace(coalesce(text, ''), '{WS}+', '', 'g'))) = 0 then 'SCANNED_PDF' end as error from p group by doc_id""")
def empty_document_guard(s, d):
    pages_ = fixtures.table(s, d, "documents").select("doc_id", "text")
    blank = s.createDataFrame([(-1, "\n\f\u00a0\u2003"), (-1, None)], "doc_id long, text string")  # pages of nothing but white space
    return lines.scanned_guard(pages_.unionByName(blank))


@query("select doc_id, case when strlen(text) > 4000 then 'FILE_TOO_LARGE' end as error from documents")
def size_guard(s, d):
    return fixtures.table(s, d, "documents").select("doc_id", lines.size_guard(F.octet_length("text"), 4000).alias("error"))


@query("select doc_id, case when doc_id % 3 = 0 then 'pdf' when doc_id % 3 = 1 then 'docx' end as kind from documents")
def file_kinds(s, d):
    name = F.concat(F.lit("a"), F.element_at(F.array(F.lit(".PDF"), F.lit(".docx"), F.lit(".txt")), (F.col("doc_id") % 3 + 1).cast("int")))
    return fixtures.table(s, d, "documents").select("doc_id", lines.file_kind(name).alias("kind"))


# ---- zones, entries, citations


_SUMMARY = """select doc_id, any_value(biblio_start) as biblio_start, any_value(biblio_end) as biblio_end, max(line) filter (line_no = biblio_start) as header_line, max(page) filter (line_no = biblio_start) as start_page,
  count(*) filter (zone = 'body') as n_body, count(*) filter (zone = 'bibliography') as n_bibliography, count(*) filter (zone = 'after') as n_after,
  case when any_value(biblio_start) is null then 'BIBLIOGRAPHY_NOT_FOUND' end as error from z group by doc_id"""


@query(f"with {_ZONED} {_SUMMARY}")
def zone_split_auto(s, d):
    return zones.zone_summary(zoned(s, d))


@query(f"""with {_LINES}, zs as (select doc_id, min(line_no) as biblio_start from l where contains(n, 'ВИКОРИСТАНИХ') and page >= 2 group by doc_id),
ze as (select l.doc_id, min(line_no) as biblio_end from l join zs using (doc_id) where line_no > biblio_start and {_any("n", zones.STOPS)} group by l.doc_id),
z as (select l.doc_id, line_no, line, page, biblio_start, biblio_end, case when biblio_start is null then null when line_no < biblio_start then 'body' when biblio_end is null or line_no < biblio_end then 'bibliography' else 'after' end as zone
  from l left join zs using (doc_id) left join ze using (doc_id)) {_SUMMARY}""")
def zone_split_manual(s, d):
    rows = fixtures.lines(s, d)
    given = rows.select("doc_id").distinct().select("doc_id", F.lit(" використаних ").alias("header"), F.lit(2).alias("start_page"))
    return zones.zone_summary(zones.split_zones_manual(rows, given))


@query(f"with {_ENTRIES} select doc_id, num, entry from entries")
def bibliography_entries(s, d):
    return listed(s, d)


@query(f"with {_ZONED}, {_CITED} select doc_id, pos, bracket from brackets")
def citation_brackets(s, d):
    return citations.brackets(zoned(s, d))


@query(f"with {_ZONED}, {_CITED} select doc_id, pos, bracket, num from cites")
def citation_expansion(s, d):
    return citations.expanded(citations.brackets(zoned(s, d)))


@query(f"with {_ZONED}, {_CITED} select doc_id, num, bracket from firsts")
def first_citation(s, d):
    return citations.first_citations(citations.brackets(zoned(s, d)))


@query(f"with {_COMPARED} select * from cmp")
def source_comparison(s, d):
    return compared(s, d)


@query(f"with {_COMPARED} select doc_id, num, entry from cmp where status = 'orphan'")
def orphans(s, d):
    return compared(s, d).where("status = 'orphan'").select("doc_id", "num", "entry")


@query(f"with {_COMPARED} select doc_id, num, entry, bracket from cmp where status = 'used'")
def used(s, d):
    return compared(s, d).where("status = 'used'").select("doc_id", "num", "entry", "bracket")


@query(f"with {_COMPARED} select doc_id, num, bracket from cmp where status = 'phantom'")
def phantoms(s, d):
    return compared(s, d).where("status = 'phantom'").select("doc_id", "num", "bracket")


@query(f"""with {_COMPARED}, u as (select doc_id, count(*) filter (status <> 'phantom') as sources, count(*) filter (status = 'used') as used, count(*) filter (status = 'orphan') as orphans, count(*) filter (status = 'phantom') as phantoms from cmp group by doc_id)
select *, case when sources > 0 then used * 100.0::double / sources else 0.0::double end as used_pct, case when sources > 0 then orphans * 100.0::double / sources else 0.0::double end as orphan_pct from u""")
def usage_summary(s, d):
    return citations.usage(compared(s, d))


# ---- years and style


def _years(s, d):
    return listed(s, d).withColumn("year", bibliography.year(F.col("entry")))


@query(f"with {_YEARS} select doc_id, num, year from years")
def entry_years(s, d):
    return _years(s, d).select("doc_id", "num", "year")


@query(f"with {_YEARS} select doc_id, year, count(*) as n from years where year is not null group by doc_id, year")
def year_histogram(s, d):
    return _years(s, d).where("year is not null").groupBy("doc_id", "year").agg(F.count("*").alias("n"))


_STATS = "select doc_id, min(year) as min_year, trunc(median(year))::int as median_year, max(year) as max_year from years where year is not null group by doc_id having count(*) >= 2"


def _stats(s, d):
    known = _years(s, d).where("year is not null").groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("year").alias("min_year"), F.median("year").cast("int").alias("median_year"), F.max("year").alias("max_year"))
    return known.where("_n >= 2").drop("_n")


@query(f"with {_YEARS} {_STATS}")
def year_stats(s, d):
    return _stats(s, d)


_DOC_YEAR = f"""dy as (select doc_id, arg_min(y, line_no) as year from (select doc_id, line_no, try_cast(regexp_extract(line, '(?:{meta.CITIES})\\s*[–—\\-]\\s*(20[0-2]\\d|19[89]\\d)', 1) as int) as y from l where line_no < 60) where y is not null group by doc_id)"""


@query(f"with {_YEARS}, {_DOC_YEAR}, st as ({_STATS}) select doc_id, year from dy join st using (doc_id) where year between min_year and max_year")
def year_marker(s, d):
    own = meta.dissertation_year(fixtures.lines(s, d), AS_OF)
    return own.join(_stats(s, d), "doc_id").where("year between min_year and max_year").select("doc_id", "year")


def _styles(s, d):
    return listed(s, d).withColumn("status", bibliography.style(F.col("entry")))


@query(f"with {_STYLE} select doc_id, num, status from styles")
def dstu_status(s, d):
    return _styles(s, d).select("doc_id", "num", "status")


@query(f"with {_STYLE} select doc_id, count(*) filter (status = 'dstu') as dstu, count(*) filter (status = 'partial') as partial, count(*) filter (status = 'other') as other from styles group by doc_id")
def dstu_counts(s, d):
    return _styles(s, d).groupBy("doc_id").agg(*(F.count(F.when(F.col("status") == k, 1)).alias(k) for k in ("dstu", "partial", "other")))


@query(f"with {_STYLE} select doc_id, num, entry, status from styles where status <> 'dstu'")
def non_dstu(s, d):
    return _styles(s, d).where("status <> 'dstu'").select("doc_id", "num", "entry", "status")


# ---- front matter


@query(f"with {_LINES}, {_DOC_YEAR} select doc_id, year from dy")
def dissertation_year(s, d):
    return meta.dissertation_year(fixtures.lines(s, d), AS_OF)


@query(f"""with {_LINES}, a as (select doc_id, line_no, upper(trim(line)) as t, lag(trim(line)) over (partition by doc_id order by line_no) as p from l),
k as (select doc_id, arg_min(p, line_no) as p from a where line_no < 80 and starts_with(t, 'УДК') and len(string_split(p, ' ')) = 3 group by doc_id)
select doc_id, list_aggregate(list_transform(string_split(p, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), 'string_agg', ' ') as author from k""")
def dissertation_author(s, d):
    return meta.dissertation_author(fixtures.lines(s, d))


# ---- sections and paragraphs


@query(f"with {_TRIGGERS} select doc_id, line_no, is_toc, is_end, is_intro, is_chapter from tr")
def section_triggers(s, d):
    line = F.col("line")
    flags = {"is_toc": paragraphs.is_toc(line), "is_end": paragraphs.section_trigger(line, paragraphs.ENDS, True), "is_intro": paragraphs.section_trigger(line, paragraphs.INTRO, True), "is_chapter": paragraphs.section_trigger(line, paragraphs.CHAPTERS, False)}
    return fixtures.lines(s, d).withColumns(flags).select("doc_id", "line_no", *flags)


@query(f"""with {_TRIGGERS}, sp as (select doc_id, page as start_page from z where line_no = biblio_start),
c0 as (select tr.doc_id, coalesce(min(line_no) filter (page = start_page), max(line_no)) as se from tr left join sp using (doc_id) group by tr.doc_id),
c1 as (select doc_id, se, coalesce(greatest(max(line_no) filter (is_end and not is_toc and line_no <= se) - 1, 0), se) as content_end from tr join c0 using (doc_id) group by doc_id, se),
c2 as (select doc_id, content_end, max(line_no) filter (is_intro and not is_toc and line_no < content_end) as intro from tr join c1 using (doc_id) group by doc_id, content_end),
c3 as (select doc_id, content_end, min(line_no) filter (is_chapter and not is_toc and line_no < content_end and line_no >= coalesce(intro, 0)) as a, min(line_no) filter (is_chapter and not is_toc and line_no < content_end) as f from tr join c2 using (doc_id) group by doc_id, content_end),
g0 as (select doc_id, line_no, line_no - lag(line_no) over (partition by doc_id order by line_no) as gap from tr join c1 using (doc_id) where is_chapter and not is_toc and line_no < content_end),
g as (select doc_id, min(line_no) as g from g0 where gap > 100 group by doc_id)
select doc_id, coalesce(a, g, f)::int as content_start, case when coalesce(a, g, f) is not null then content_end end::int as content_end, case when coalesce(a, g, f) is null then 'CONTENT_NOT_FOUND' end as error from c3 left join g using (doc_id)""")
def content_bounds(s, d):
    return paragraphs.content_bounds(fixtures.lines(s, d), starts(s, d))


@query(f"with {_DOC_LINES} select doc_id, line_no, {_sentences('line')} as sentence_count from dl")
def sentence_counts(s, d):
    return document_lines(s, d).select("doc_id", "line_no", paragraphs.sentence_count(F.col("line")).alias("sentence_count"))


@query(f"with {_PARAS} select * from paras")
def pdf_paragraphs(s, d):
    return paragraphs.pdf_paragraphs(fixtures.layout(s, d))


@query(f"with {_STYLED} select * from docx")
def docx_paragraphs(s, d):
    return paragraphs.docx_paragraphs(fixtures.styled(s, d))


_GAPS = f"""select doc_id, count(*) as total, count(*) filter ({_HAS}) as cited, count(*) filter (not {_HAS}) as clean, count(*) filter (not {_HAS}) / count(*)::double * 100 as clean_pct,
  count(*) filter (not {_HAS} and sentence_count >= 5) as n_suspicious from"""


@query(f"with {_STYLED} {_GAPS} docx group by doc_id")
def paragraph_gaps(s, d):
    return paragraphs.gap_report(docx_paragraphs(s, d))


@query(f"""with {_PARAS} select doc_id, para_index, sentence_count, page::varchar as place, case when length(text) > 120 then substr(text, 1, 120) || '…' else text end as preview from paras where not {_HAS} and sentence_count >= 5""")
def suspicious_paragraphs(s, d):
    return paragraphs.suspicious(pdf_paragraphs(s, d))


# ---- page audit


@query(f"with {_WORDS} select doc_id, page, text from pt")
def page_text(s, d):
    return pages.page_text(fixtures.words(s, d))


@query(f"with {_WORDS} select m.doc_id, m.page, match_no, word_no, text from m join w2 on m.doc_id = w2.doc_id and m.page = w2.page and s < ms0 + n and s + length(text) > ms0")
def citation_word_spans(s, d):
    return pages.highlights(fixtures.words(s, d))


_EMPTY = f"""{_WORDS}, hs as (select doc_id, max(line_no) as b from l where {_any("n", zones.HEADERS)} group by doc_id), sp as (select l.doc_id, page as start_page from l join hs on l.doc_id = hs.doc_id and line_no = b),
pg as (select distinct doc_id, page from l union all select 1000, unnest([1, 2]) union all select 1001, unnest([1, 2, 3, 4, 6])),
t0 as (select pg.doc_id, pg.page, m.page is null as bare, pg.page > 2 and pg.page <= case when start_page > 1 then start_page - 1 else 1000000000 end as tracked
  from pg left join sp using (doc_id) left join (select distinct doc_id, page from m) m on pg.doc_id = m.doc_id and pg.page = m.page),
tp as (select doc_id, page, tracked, tracked and bare as empty from t0),
r0 as (select doc_id, page, page - row_number() over (partition by doc_id order by page) as i from tp where empty),
r1 as (select doc_id, min(page) as a, max(page) as b from r0 group by doc_id, i),
rg as (select doc_id, string_agg(case when a = b then a::varchar else a::varchar || '–' || b::varchar end, ', ' order by a) as ranges from r1 group by doc_id)"""


@query(f"""with {_EMPTY} select doc_id, count(*) filter (tracked) as tracked, count(*) filter (empty) as n_empty, case when count(*) filter (tracked) > 0 then count(*) filter (empty) / (count(*) filter (tracked))::double * 100 else 0.0::double end as empty_pct, coalesce(any_value(ranges), '') as ranges from tp left join rg using (doc_id) group by doc_id""")
def empty_pages(s, d):
    wordless = s.createDataFrame([(1000, 1), (1000, 2), *((1001, k) for k in (1, 2, 3, 4, 6))], "doc_id long, page int")  # two pages; five without words
    return pages.empty_pages(fixtures.lines(s, d).select("doc_id", "page").distinct().unionByName(wordless), fixtures.words(s, d), starts(s, d))


@query(f"""with {_LINES}, r0 as (select distinct doc_id, page from l where page % 5 <> 0 union all select distinct doc_id, page from l where page % 7 = 3),
r1 as (select *, row_number() over (partition by doc_id order by page) as k, coalesce(page - lag(page) over (partition by doc_id order by page) <> 1, true)::int as fresh from r0),
r2 as (select *, sum(fresh) over (partition by doc_id order by k rows unbounded preceding) as run from r1), r3 as (select doc_id, run, min(page) as a, max(page) as b from r2 group by doc_id, run)
select doc_id, string_agg(case when a = b then a::varchar else a::varchar || '–' || b::varchar end, ', ' order by run) as ranges from r3 group by doc_id""")
def page_ranges(s, d):
    rows = fixtures.lines(s, d).select("doc_id", "page").distinct()
    return pages.page_ranges(rows.where("page % 5 <> 0").unionByName(rows.where("page % 7 = 3")))  # some pages twice


@query(f"""with {_WORDS}, bx as (select *, ((word_no % 1000) * 50)::double as x0, (block_no % 30 * 14)::double as y0 from w2)
select m.doc_id, m.page, match_no, word_no, text, x0, y0, x0 + 7 * length(text) as x1, y0 + 12 as y1 from m join bx on m.doc_id = bx.doc_id and m.page = bx.page and s < ms0 + n and s + length(text) > ms0""")
def highlight_boxes(s, d):
    return pages.highlight_boxes(fixtures.words(s, d))


# ---- dispatch and display


@query(f"""with {_PARAS}, {_STYLED}, bd as (select doc_id, (doc_id % 3)::int as a, (doc_id % 5)::int as b from documents),
inside as (select doc_id, page, text, row_number() over (partition by doc_id order by para_index) - 1 as para_index, sentence_count from paras join bd using (doc_id) where page >= greatest(a, 1) and (b = 0 or page <= b))
select doc_id, para_index::int as para_index, page, null::varchar as context_heading, text, sentence_count from inside
union all select doc_id + 1000000, para_index, null::int, context_heading, text, sentence_count from docx""")
def extracted_paragraphs(s, d):
    bounds = fixtures.table(s, d, "documents").selectExpr("doc_id", "cast(doc_id % 3 as int) as start_page", "cast(doc_id % 5 as int) as end_page")
    styled = fixtures.styled(s, d).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return paragraphs.extract_paragraphs(fixtures.layout(s, d), styled, bounds)


@query(f"""with {_TRIGGERS}, c as (select doc_id, max(line_no) filter (zone = 'body') as e, min(line_no) filter (is_chapter and not is_toc) as a from tr join z using (doc_id, line_no) group by doc_id)
select c.doc_id, max(page) filter (line_no = a) as start_page, max(page) filter (line_no = e) as end_page from c join l using (doc_id) group by c.doc_id""")
def content_pages(s, d):
    rows = zoned(s, d)
    line = F.col("line")
    chapter = ~paragraphs.is_toc(line) & paragraphs.section_trigger(line, paragraphs.CHAPTERS, False)
    bounds = rows.groupBy("doc_id").agg(F.min(F.when(chapter, F.col("line_no"))).alias("content_start"), F.max(F.when(F.col("zone") == "body", F.col("line_no"))).alias("content_end"), F.lit(None).cast("string").alias("error"))
    return paragraphs.page_bounds(rows, bounds)


@query(f"""with {_COMPARED}, u as (select doc_id, count(*) filter (status <> 'phantom') as n, count(*) filter (status = 'used') as used, count(*) filter (status = 'orphan') as orphans from cmp group by doc_id)
select doc_id, printf('%.0f%%', case when n > 0 then used * 100.0::double / n else 0 end) as used_label, case when orphans > 0 then printf('-%.0f%%', orphans * 100.0::double / n) end as orphan_label from u""")
def usage_labels(s, d):
    u = citations.usage(compared(s, d))
    orphan = F.when(F.col("orphans") > 0, F.concat(F.lit("-"), text.display(F.col("orphan_pct")), F.lit("%")))
    return u.select("doc_id", F.concat(text.display(F.col("used_pct")), F.lit("%")).alias("used_label"), orphan.alias("orphan_label"))


@query("""select doc_id, printf('%.0f', (doc_id % 4001) / 8.0::double) as whole, printf('%.1f', (doc_id % 4001) / 16.0::double) as tenth, printf('%.1f', doc_id * 100 / 1001.0::double) as share from documents""")
def display_rounding(s, d):
    n = F.col("doc_id")
    return fixtures.table(s, d, "documents").select("doc_id", text.display((n % 4001) / F.lit(8.0)).alias("whole"), text.display((n % 4001) / F.lit(16.0), 1).alias("tenth"), text.display(n * 100 / F.lit(1001.0), 1).alias("share"))


@query("""select doc_id, case when doc_id % 4 = 0 then 'thesis' else 'a.b' || doc_id || '.pdf' end as name, case when doc_id % 4 = 0 then 'thesis' else 'a.b' || doc_id end || '_highlighted.pdf' as output from documents""")
def output_names(s, d):
    name = F.when(F.col("doc_id") % 4 == 0, "thesis").otherwise(F.concat(F.lit("a.b"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    return fixtures.table(s, d, "documents").select("doc_id", name.alias("name"), text.output_name(name).alias("output"))
