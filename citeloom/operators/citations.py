"""Bracketed citations of the body, expanded to source numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# fixed values: a bracket, a range and its widest span
BRACKET = "(?U)[\\[\\uF05B][\\d\\s\\x1c-\\x1f;,\\-–−.сСcC]+[\\]\\uF05D]"
RANGE = r"(?U)^(\d+)\s*[\-–−]\s*(\d+)$"
WIDEST = 200


def token_numbers(token: Column) -> Column:
    """The numbers of one token; text from the first letter on is a page reference."""
    t = strip(F.regexp_replace(strip(token), r"[a-zA-ZЀ-ӿ](?s:.*)", ""))
    low, high = (F.regexp_extract(t, RANGE, k).try_cast("bigint") for k in (1, 2))
    span = F.when((low <= high) & (high - low <= WIDEST), F.sequence(low, high))
    one = F.when(t.rlike(r"(?U)^\d+$"), F.array(t.try_cast("bigint")))
    return F.coalesce(span, one, F.array().cast("array<bigint>"))


def expand(content: Column) -> Column:
    """Distinct numbers of a bracket: with semicolons, commas part off pages; without, they part sources."""
    tokens = F.when(content.contains(";"), F.transform(F.split(content, ";"), lambda g: F.element_at(F.split(g, ","), 1))).otherwise(F.split(content, ","))
    return F.array_distinct(F.filter(F.flatten(F.transform(tokens, token_numbers)), lambda n: n.isNotNull()))


def brackets(zoned: DataFrame) -> DataFrame:
    """doc_id, pos, bracket over the body joined by blanks, so that brackets may span lines."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    body = zoned.where("zone = 'body'").groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda s: s["line"]), " ").alias("full"))
    return body.select("doc_id", F.posexplode(F.regexp_extract_all("full", F.lit(BRACKET), F.lit(0))).alias("pos", "bracket"))


def expanded(found: DataFrame) -> DataFrame:
    inner = F.expr("substring(bracket, 2, length(bracket) - 2)")
    return found.select("doc_id", "pos", "bracket", F.explode(expand(inner)).alias("num"))


def first_citations(found: DataFrame) -> DataFrame:
    """doc_id, num and the first bracket that cites it."""
    return expanded(found).groupBy("doc_id", "num").agg(F.min_by("bracket", "pos").alias("bracket"))


def compare(listed: DataFrame, cited: DataFrame) -> DataFrame:
    """doc_id, num, entry, bracket, status: used, orphan (listed only) or phantom (cited only)."""
    both = listed.withColumn("num", F.col("num").cast("bigint")).join(cited, ["doc_id", "num"], "full_outer")
    return both.withColumn("status", F.when(F.col("bracket").isNull(), "orphan").when(F.col("entry").isNull(), "phantom").otherwise("used"))


def usage(compared: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    total = n("used") + n("orphan")
    share = lambda s: F.when(total > 0, n(s) * F.lit(100.0) / total).otherwise(F.lit(0.0))
    return compared.groupBy("doc_id").agg(total.alias("sources"), n("used").alias("used"), n("orphan").alias("orphans"), n("phantom").alias("phantoms"), share("used").alias("used_pct"), share("orphan").alias("orphan_pct"))
