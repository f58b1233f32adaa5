"""Numbered entries, their years and their style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip

# fixed values: the start of an entry, the largest number, years
ENTRY = r"(?Ud)^\s*(?:(\d+)\.\s*(.*)|(?:\[(\d+)\])\s*(.*))$"
MOST = 999
YEAR = r"(1[89]\d{2}|20[0-2]\d)"
YEARS = (rf"(?Ud),\s*{YEAR}\s*[.–\-]", rf"(?Ud)\(\s*{YEAR}\s*\)", rf"(?Ud),\s*{YEAR}\s*$", rf"(?Ud)(?<!\d\.)\b{YEAR}\b(?!\.\d)")
# fixed values: marks of the national reference style, and of other styles
STRONG = (r"\s:\s", r"\.\s[–—]\s", r"\s//\s", r"\s/\s")
WEAK = (r"\d+\s*с\.", r"(?i)URL\s*:", r"(?i)дата звернення", r"№\s*\d+")
OTHER = (r"\(\d{4}\)\.", r"(?i)Vol\.\s*\d+", r"(?i)\bNo\.\s*\d+", r"(?i)\bpp?\.\s*\d+")


def entries(zoned: DataFrame) -> DataFrame:
    """doc_id, num, entry: runs of lines from one entry start to the next; of equal numbers the later run wins."""
    line = F.col("line")
    group = lambda k: F.regexp_extract(line, ENTRY, k)
    rows = zoned.where("zone = 'bibliography'").select("doc_id", "line_no", "line", F.concat(group(1), group(3)).try_cast("bigint").alias("num"), strip(F.concat(group(2), group(4))).alias("txt"))
    rows = rows.withColumn("is_start", F.coalesce(F.col("num").between(1, MOST) & ((F.col("txt") == "") | F.col("txt").rlike(r"^\p{L}")), F.lit(False)))
    run = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("seg", F.sum(F.col("is_start").cast("int")).over(run)).where("seg > 0")
    rows = rows.withColumn("piece", F.when(F.col("is_start"), F.col("txt")).otherwise(strip(line)))
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece") != "", F.struct("line_no", "piece"))))
    segs = rows.groupBy("doc_id", "seg").agg(F.max(F.when(F.col("is_start"), F.col("num"))).alias("num"), F.array_join(F.transform(ordered, lambda s: s["piece"]), " ").alias("entry")).where("entry <> ''")
    return segs.groupBy("doc_id", F.col("num").cast("int").alias("num")).agg(F.max_by("entry", "seg").alias("entry"))


def year(entry: Column) -> Column:
    return F.coalesce(*(F.regexp_extract(entry, p, 1).try_cast("int") for p in YEARS))


def style(entry: Column) -> Column:
    hits = lambda ps: sum((entry.rlike("(?Ud)" + p).cast("int") for p in ps), F.lit(0))
    strong, weak = hits(STRONG), hits(WEAK)
    return F.when(hits(OTHER) > 0, "other").when((strong >= 2) | ((strong >= 1) & (weak >= 1)), "dstu").when((strong == 1) | (weak >= 1), "partial").otherwise("other")
