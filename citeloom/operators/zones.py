"""Body, bibliography and the rest of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalise, starts_with_any, strip

# fixed values: headers that open and close a bibliography
HEADERS = ("СПИСОК ВИКОРИСТАНИХ ДЖЕРЕЛ", "СПИСОК ЛІТЕРАТУРИ", "СПИСОК ВИКОРИСТАНОЇ ЛІТЕРАТУРИ", "ВИКОРИСТАНІ ДЖЕРЕЛА", "БІБЛІОГРАФІЯ", "БІБЛІОГРАФІЧНИЙ СПИСОК", "REFERENCES", "LITERATURE")
STOPS = ("СПИСОК ПУБЛІКАЦІЙ ЗДОБУВАЧА", "ДОДАТКИ", "ДОДАТОК", "АНОТАЦІЯ", "ABSTRACT")


def _label(lines: DataFrame, start) -> DataFrame:
    whole = W.partitionBy("doc_id")
    marked = lines.withColumn("_n", normalise(F.col("line"))).withColumn("biblio_start", start(whole))
    stop = starts_with_any(F.col("_n"), STOPS) & (F.col("line_no") > F.col("biblio_start"))
    marked = marked.withColumn("biblio_end", F.min(F.when(stop, F.col("line_no"))).over(whole))
    at, end = F.col("biblio_start"), F.col("biblio_end")
    zone = F.when(at.isNull(), None).when(F.col("line_no") < at, "body").when(end.isNull() | (F.col("line_no") < end), "bibliography").otherwise("after")
    return marked.withColumn("zone", zone).drop("_n")


def split_zones(lines: DataFrame) -> DataFrame:
    """Add zone, biblio_start and biblio_end: the last header opens, the first stop word after it closes."""
    head = F.when(starts_with_any(F.col("_n"), HEADERS), F.col("line_no"))
    return _label(lines, lambda w: F.max(head).over(w))


def split_zones_manual(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """As split_zones() for documents in overrides(doc_id, header, start_page): the first line that holds the header opens."""
    given = lines.join(overrides.select("doc_id", F.upper(strip(F.col("header"))).alias("_h"), F.coalesce("start_page", F.lit(0)).alias("_p")), "doc_id")
    head = F.when(F.col("_n").contains(F.col("_h")) & (F.coalesce("page", F.lit(0)) >= F.col("_p")), F.col("line_no"))
    return _label(given, lambda w: F.min(head).over(w)).drop("_h", "_p")


def zone_summary(zoned: DataFrame) -> DataFrame:
    """One row a document, with an error where no header was found."""
    at = F.col("line_no") == F.col("biblio_start")
    return zoned.groupBy("doc_id").agg(
        F.first("biblio_start").alias("biblio_start"), F.first("biblio_end").alias("biblio_end"), F.max(F.when(at, F.col("line"))).alias("header_line"), F.max(F.when(at, F.col("page"))).alias("start_page"),
        *(F.count(F.when(F.col("zone") == z, 1)).alias(f"n_{z}") for z in ("body", "bibliography", "after")), F.when(F.first("biblio_start").isNull(), "BIBLIOGRAPHY_NOT_FOUND").alias("error"),
    )
