"""Corpus pipeline: quality rules, near duplicates, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import jaccard_join, mixing, packing, pii, quality_rules
from citeloom.llm.common import broadcast_if_small, read, settle

#: Near copies share this part of their five-word shingles; the limits of op3 bind that query only.
WIDTH, NUM, DEN = 5, 80, 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.keep(docs)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a settled number for each row, as ids may be null or repeat."""
    return settle(docs.withColumn("_row", F.monotonically_increasing_id()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies (rows without id come last); ids may repeat or be null."""
    rows = numbered(docs)
    linked = settle(jaccard_join.link(rows, width=WIDTH, num=NUM, den=DEN, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    first = linked.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    first = first.where("_n > 1").select("component_id", F.col("_first._row").alias("_stays"))
    gone = settle(linked.join(first, "component_id").where("_row <> _stays").select("_row"))
    return rows.join(broadcast_if_small(gone, gone.count()), "_row", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, whether or not its id is null or repeats."""
    rows = numbered(docs)
    rates = settle(mixing.mix(rows, row_col="_row").select("_row", F.col("copies").cast("int").alias("_copies")).where("_copies > 0"))
    out = rows.join(broadcast_if_small(rates, rates.count()), "_row")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(packing.pieces(docs, packing.tokenizer_path()))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("pii", personal_data), ("entropy_mixing", source_mix), ("best_fit_packing", sequences)]

#: Similarity components and tokenizer ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
