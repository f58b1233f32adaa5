"""Ordered line tables from document texts, with guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rstrip, strip

BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\u0085\\u2028\\u2029]"
MAX_BYTES = 30 * 1024 * 1024


def file_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx")


def size_guard(size: Column, limit: int = MAX_BYTES) -> Column:
    """An error code, or null: exactly the limit passes."""
    return F.when(size > limit, "FILE_TOO_LARGE")


def scanned_guard(pages: DataFrame) -> DataFrame:
    """One row a document: SCANNED_PDF if no page holds anything but white space."""
    total = F.sum(F.coalesce(F.length(strip(F.col("text"))), F.lit(0)))
    return pages.groupBy("doc_id").agg(F.when(total == 0, "SCANNED_PDF").alias("error"))


def split_lines(pages: DataFrame) -> DataFrame:
    """doc_id, line_no, line, page from (doc_id, page, text): trailing blanks go, empty lines go, leading blanks stay."""
    cut = pages.select("doc_id", "page", F.posexplode(F.split(F.col("text"), BREAK)).alias("pos", "raw")).select("doc_id", "page", "pos", rstrip(F.col("raw")).alias("line")).where("line <> ''")
    order = W.partitionBy("doc_id").orderBy("page", "pos")
    return cut.select("doc_id", (F.row_number().over(order) - 1).cast("int").alias("line_no"), "line", F.col("page").cast("int").alias("page"))
