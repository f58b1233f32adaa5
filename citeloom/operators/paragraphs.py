"""Content bounds, paragraphs, sentence counts and the report on long uncited paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse, normalise, starts_with_any, strip, word_count
from .citations import BRACKET

# fixed values: section headers, abbreviations
CHAPTERS = ("РОЗДІЛ", "CHAPTER", "ГЛАВА", "ЧАСТИНА")
INTRO = ("ВСТУП",)
ENDS = ("ВИСНОВКИ", "ЗАГАЛЬНІ ВИСНОВКИ", "СПИСОК ВИКОРИСТАНИХ ДЖЕРЕЛ", "СПИСОК ЛІТЕРАТУРИ", "СПИСОК ВИКОРИСТАНОЇ ЛІТЕРАТУРИ", "ВИКОРИСТАНІ ДЖЕРЕЛА", "БІБЛІОГРАФІЯ", "БІБЛІОГРАФІЧНИЙ СПИСОК", "REFERENCES", "ДОДАТКИ", "ДОДАТОК")
ABBREVIATIONS = "табл|таб|рис|див|стор|ст|с|п|ч|т|д|дод|вид|грн|млн|млрд|кг|км|га|ін|тис|проф|доц|акад"
# fixed values: a line of a table of contents, a letter, limits
TOC, LETTER = r"(?Ud)\.{3,}\s*\d*\s*$", "[А-Яа-яІіЇїЄєҐґA-Za-z]"
MIN_CHARS, MIN_SENTENCES, TOC_GAP, LINE_GAP = 80, 5, 100, 1.5


def section_trigger(line: Column, headers: tuple[str, ...], exact: bool) -> Column:
    n = F.regexp_replace(normalise(line), r"[.,:;!?]+$", "")
    hit = n.isin(*headers) if exact else starts_with_any(n, headers)
    clean = strip(line)
    short = (F.length(clean) < 60) & (word_count(line) <= 8)
    return hit & (short | ((F.upper(clean) == clean) & clean.rlike(r"\p{L}")))


def is_toc(line: Column) -> Column:
    return strip(line).rlike(TOC)


def sentence_count(text: Column) -> Column:
    masked = F.regexp_replace(text, rf"(?iU)\b({ABBREVIATIONS})\.", "$1\u0000")
    ends = F.regexp_extract_all(masked, F.lit(r"(?U)(?<![А-ЯІЇЄҐA-Z]\.)(?<=[.!?])[\s\x1c-\x1f]+(?=[А-ЯІЇЄҐA-Z])"), F.lit(0))
    return (F.size(ends) + 1).cast("int")


def content_bounds(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, content_start, content_end, error from lines and (doc_id, start_page of the bibliography or null).

    Windows over one partitioning by document; each bound is a conditional minimum or maximum.
    """
    whole, order = W.partitionBy("doc_id"), W.partitionBy("doc_id").orderBy("line_no")
    n, line = F.col("line_no"), F.col("line")
    rows = lines.join(starts, "doc_id", "left").withColumn("toc", is_toc(line))
    for name, heads, exact in (("end", ENDS, True), ("intro", INTRO, True), ("chapter", CHAPTERS, False)):
        rows = rows.withColumn(f"is_{name}", ~F.col("toc") & section_trigger(line, heads, exact))
    first_on_page = F.min(F.when(F.col("page") == F.col("start_page"), n)).over(whole)
    rows = rows.withColumn("search_end", F.coalesce(first_on_page, F.max(n).over(whole)))
    last_end = F.max(F.when(F.col("is_end") & (n <= F.col("search_end")), n)).over(whole)
    rows = rows.withColumn("content_end", F.coalesce(F.greatest(last_end - 1, F.lit(0)), F.col("search_end")))
    rows = rows.withColumn("intro", F.max(F.when(F.col("is_intro") & (n < F.col("content_end")), n)).over(whole))
    chapter = F.col("is_chapter") & (n < F.col("content_end"))
    rows = rows.withColumn("after_intro", F.min(F.when(chapter & (n >= F.coalesce("intro", F.lit(0))), n)).over(whole))
    rows = rows.withColumn("chapter_at", F.when(chapter, n)).withColumn("chapter_before", F.last("chapter_at", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    gapped = F.min(F.when(chapter & (n - F.col("chapter_before") > TOC_GAP), n)).over(whole)
    rows = rows.withColumn("content_start", F.coalesce("after_intro", gapped, F.min("chapter_at").over(whole)))
    out = rows.groupBy("doc_id").agg(F.first("content_start").alias("content_start"), F.first("content_end").alias("content_end"))
    lost = F.col("content_start").isNull()
    return out.select("doc_id", "content_start", F.when(~lost, F.col("content_end")).alias("content_end"), F.when(lost, "CONTENT_NOT_FOUND").alias("error"))


def pdf_paragraphs(layout: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """doc_id, para_index, page, text, sentence_count from layout lines (doc_id, page, seq, block_type, text, top, bottom).

    bounds: (doc_id, start_page, end_page), whole pages, both included; null or 0 is no bound.
    """
    rows = layout.where("block_type = 0").withColumn("text", strip(F.col("text"))).where("text <> ''")
    if bounds is not None:
        start, end = (F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(d)) for c, d in (("start_page", 1), ("end_page", 1 << 30)))
        rows = rows.join(bounds.select("doc_id", "start_page", "end_page"), "doc_id", "left").where((F.col("page") >= start) & (F.col("page") <= end))
    w = W.partitionBy("doc_id", "page").orderBy("seq")
    height = F.col("bottom") - F.col("top")
    past = F.last(F.when(height > 0, height), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = F.coalesce(F.col("top") - F.lag("bottom").over(w) > past * LINE_GAP, F.lit(False))
    rows = rows.withColumn("cut", cut.cast("int")).withColumn("seg", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    paras = rows.groupBy("doc_id", "page", "seg").agg(collapse(strip(F.array_join(F.transform(parts, lambda s: s["text"]), " "))).alias("text"))
    paras = paras.where((F.length("text") >= MIN_CHARS) & F.col("text").rlike(LETTER))
    order = W.partitionBy("doc_id").orderBy("page", "seg")
    return paras.select("doc_id", (F.row_number().over(order) - 1).cast("int").alias("para_index"), "page", "text", sentence_count(F.col("text")).alias("sentence_count"))


def docx_paragraphs(paras: DataFrame) -> DataFrame:
    """doc_id, para_index, context_heading, text, sentence_count from (doc_id, para_no, style, text)."""
    w = W.partitionBy("doc_id").orderBy("para_no")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = paras.withColumn("text", strip(F.col("text"))).withColumn("heading", F.coalesce(F.col("style").contains("Heading") | F.col("style").contains("heading"), F.lit(False))).withColumn("toc", is_toc(F.col("text")))
    end = ~F.col("toc") & section_trigger(F.col("text"), ENDS, True)
    chapter = ~F.col("toc") & section_trigger(F.col("text"), CHAPTERS, False)
    rows = rows.withColumns({"closed": F.max(end.cast("int")).over(so_far), "open": F.max(chapter.cast("int")).over(so_far), "context_heading": F.last(F.when(F.col("heading") & (F.col("text") != ""), F.col("text")), ignorenulls=True).over(so_far)})
    kept = rows.where("closed = 0 and open = 1 and not heading and not toc").where((F.length("text") >= MIN_CHARS) & F.col("text").rlike(LETTER))
    return kept.select("doc_id", (F.row_number().over(w) - 1).cast("int").alias("para_index"), "context_heading", "text", sentence_count(F.col("text")).alias("sentence_count"))


def page_bounds(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc_id, start_page, end_page) of the lines that content_bounds() names."""
    at = lines.select("doc_id", "line_no", "page").join(bounds.where("error is null").select("doc_id", "content_start", "content_end"), "doc_id")
    page = lambda c: F.max(F.when(F.col("line_no") == F.col(c), F.col("page")))
    return at.groupBy("doc_id").agg(page("content_start").alias("start_page"), page("content_end").alias("end_page"))


def extract_paragraphs(layout: DataFrame, paras: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """doc_id, para_index, page, context_heading, text, sentence_count of PDF documents (layout lines) and DOCX ones (styled paragraphs)."""
    pdf, docx = pdf_paragraphs(layout, bounds), docx_paragraphs(paras)
    cols = ("doc_id", "para_index", "page", "context_heading", "text", "sentence_count")
    return pdf.withColumn("context_heading", F.lit(None).cast("string")).select(*cols).unionByName(docx.withColumn("page", F.lit(None).cast("int")).select(*cols))


def has_citation(text: Column) -> Column:
    return text.rlike(BRACKET)


def gap_report(paras: DataFrame) -> DataFrame:
    """One row a document: paragraphs, cited, clean, share of clean ones, and long clean ones."""
    cited = has_citation(F.col("text"))
    total, clean = F.count("*"), F.count(F.when(~cited, 1))
    return paras.groupBy("doc_id").agg(total.alias("total"), F.count(F.when(cited, 1)).alias("cited"), clean.alias("clean"), (clean / total * 100).alias("clean_pct"), F.count(F.when(~cited & (F.col("sentence_count") >= MIN_SENTENCES), 1)).alias("n_suspicious"))


def suspicious(paras: DataFrame) -> DataFrame:
    """Long uncited paragraphs with a preview and a place; order them by coalesce(page, 0), para_index to show them."""
    t = F.col("text")
    preview = F.when(F.length(t) > 120, F.concat(F.left(t, F.lit(120)), F.lit("…"))).otherwise(t)
    cols = paras.columns
    page = F.nullif(F.col("page"), F.lit(0)).cast("string") if "page" in cols else F.lit(None).cast("string")
    head = F.nullif(F.col("context_heading"), F.lit("")) if "context_heading" in cols else F.lit(None).cast("string")
    return paras.where(~has_citation(t) & (F.col("sentence_count") >= MIN_SENTENCES)).select("doc_id", "para_index", "sentence_count", F.coalesce(page, head, F.lit("—")).alias("place"), preview.alias("preview"))
