"""Page audit: citations found on word boxes, pages without any, and page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed value: a citation on a page
CITATION = "(?Us)[\\[\\uF05B]\\s*\\d[^\\]\\uF05D]{0,250}[\\]\\uF05D]"
SKIP_FIRST = 2


def word_spans(words: DataFrame) -> DataFrame:
    """Add start and end offsets in the page text: words part by a blank, blocks by a line feed more."""
    w = W.partitionBy("doc_id", "page").orderBy("word_no")
    turn = F.coalesce((F.col("block_no") != F.lag("block_no").over(w)).cast("int"), F.lit(0))
    rows = words.withColumn("_turn", turn)
    before = F.sum(F.length("text") + 1).over(w.rowsBetween(W.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.sum("_turn").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.length("text")).cast("int"))


def page_text(words: DataFrame) -> DataFrame:
    """doc_id, page, text."""
    spans = word_spans(words)
    parts = F.array_sort(F.collect_list(F.struct("word_no", F.concat(F.when(F.col("_turn") == 1, "\n").otherwise(""), F.col("text"), F.lit(" ")).alias("t"))))
    return spans.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda s: s["t"]), "").alias("text"))


def matches(text: DataFrame) -> DataFrame:
    """doc_id, page, match_no, m_start, m_end, match."""
    found = F.regexp_extract_all("text", F.lit(CITATION), F.lit(0))
    gaps = F.transform(F.slice(F.split("text", CITATION, -1), F.lit(1), F.size(found)), F.length)
    rows = text.withColumn("_z", F.arrays_zip(gaps.alias("gap"), found.alias("match"))).select("doc_id", "page", F.posexplode("_z").alias("match_no", "z")).select("doc_id", "page", "match_no", "z.gap", "z.match")
    w = W.partitionBy("doc_id", "page").orderBy("match_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(w)
    return rows.select("doc_id", "page", "match_no", (end - F.length("match")).cast("int").alias("m_start"), end.cast("int").alias("m_end"), "match")


def highlights(words: DataFrame) -> DataFrame:
    """Words that a citation covers: an equi-join on the page with an overlap condition."""
    spans = word_spans(words)
    hit = (F.col("start") < F.col("m_end")) & (F.col("end") > F.col("m_start"))
    return matches(page_text(words)).join(spans, ["doc_id", "page"]).where(hit).select("doc_id", "page", "match_no", "word_no", "text")


def highlight_boxes(words: DataFrame) -> DataFrame:
    """The boxes to mark: highlights() with x0, y0, x1, y1 of each word, from words that have them."""
    boxes = words.select("doc_id", "page", "word_no", "x0", "y0", "x1", "y1")
    return highlights(words).join(boxes, ["doc_id", "page", "word_no"]).select("doc_id", "page", "match_no", "word_no", "text", "x0", "y0", "x1", "y1")


def empty_pages(pages: DataFrame, words: DataFrame, starts: DataFrame, skip_first: int = SKIP_FIRST) -> DataFrame:
    """doc_id, tracked, n_empty, empty_pct, ranges: pages between the front matter and the bibliography without citations.

    A document all of whose pages are front matter or bibliography has no tracked pages and 0 per cent.
    """
    hit = matches(page_text(words)).select("doc_id", "page").distinct().withColumn("hit", F.lit(True))
    start = F.col("start_page")
    last = F.coalesce(F.when(start > 1, start - 1), F.lit(1 << 30))
    tracked = (F.col("page") > skip_first) & (F.col("page") <= last)
    rows = pages.join(starts, "doc_id", "left").join(hit, ["doc_id", "page"], "left").withColumn("tracked", tracked).withColumn("empty", tracked & F.col("hit").isNull())
    counts = rows.groupBy("doc_id").agg(F.count(F.when(F.col("tracked"), 1)).alias("tracked"), F.count(F.when(F.col("empty"), 1)).alias("n_empty"))
    ranges = page_ranges(rows.where("empty").select("doc_id", "page"))
    share = F.when(F.col("tracked") > 0, F.try_divide("n_empty", "tracked") * 100).otherwise(0.0)
    out = counts.join(ranges, "doc_id", "left")
    return out.select("doc_id", "tracked", "n_empty", share.alias("empty_pct"), F.coalesce("ranges", F.lit("")).alias("ranges"))


def page_ranges(pages: DataFrame) -> DataFrame:
    """doc_id, ranges: runs of consecutive pages as `a–b`, single ones as `a`; a repeated page begins a run of its own."""
    w = W.partitionBy("doc_id").orderBy("page")
    fresh = F.coalesce(F.col("page") - F.lag("page").over(w) != 1, F.lit(True)).cast("int")
    rows = pages.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("doc_id", "_run").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("–", "a", "b"))
    listed = F.array_sort(F.collect_list(F.struct("_run", label.alias("t"))))
    return runs.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda s: s["t"]), ", ").alias("ranges"))
