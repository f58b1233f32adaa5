"""The citation corpus that queries run on, derived from the driver tables; the same text runs in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = """with b as (
  select o_custkey % 40 as doc_id, l_orderkey * 10 + l_linenumber as k,
         (l_partkey % 20) * 2 + 1 + o_custkey % 5 as a, l_suppkey % 10 + 50 as b, cast(l_quantity as int) as q
  from {lineitem} join {orders} on l_orderkey = o_orderkey),
d as (select distinct doc_id from b),
parts as (select p_partkey as n, p_size as sz from {part} where p_partkey <= 55),
u as (
  select doc_id, 0 as sec, cast(1 as bigint) as k, 'НАЦІОНАЛЬНИЙ УНІВЕРСИТЕТ' as line from d
  union all select doc_id, 0, 2, 'ПЕТРЕНКО ІВАН СЕМЕНОВИЧ' from d
  union all select doc_id, 0, 3, concat('УДК ', cast(300 + doc_id as string)) from d
  union all select doc_id, 0, 4, concat('Київ – ', cast(2000 + doc_id % 24 as string)) from d
  union all select doc_id, 0, 5, 'РОЗДІЛ 1. ОГЛЯД ...... 12' from d
  union all select doc_id, 0, 6, 'ВСТУП' from d
  union all select doc_id, 1, 1, 'РОЗДІЛ 1' from d
  union all select doc_id, 2, k,
     case when q % 6 = 0 then concat('Слово [', cast(a as string), '; ', cast(b as string), ', с. ', cast(q as string), '] далі.')
          when q % 6 = 1 then concat('Слово [', cast(a as string), '–', cast(a + case when q = 7 then 1 else 0 end as string), '].')
          when q % 6 = 2 then concat('Слово [', cast(a as string), ', ', cast(b as string), '].')
          when q % 6 = 3 then concat('Слово [', cast(a as string), ' с. 3-9; ', cast(b as string), '].')
          else concat('Речення ', cast(q as string), ' без посилань. Друге речення.') end from b
  union all select doc_id, 3, 1, 'ВИСНОВКИ' from d
  union all select doc_id, 3, 2, 'СПИСОК ВИКОРИСТАНИХ ДЖЕРЕЛ' from d
  union all select doc_id, 4, n * 10,
     case when n % 4 = 0 then concat(cast(n as string), '. Автор П. Назва / П. Автор. – Київ : Либідь, ', cast(1990 + n % 30 as string), '. – ', cast(sz as string), ' с.')
          when n % 4 = 1 then concat('[', cast(n as string), '] Smith J. (', cast(1990 + n % 30 as string), '). Title. Publisher.')
          when n % 4 = 2 then concat(cast(n as string), '.')
          else concat(cast(n as string), '. Наукова думка, ', cast(sz as string), ' с.') end from d cross join parts
  union all select doc_id, 4, n * 10 + 1, concat(cast(2001 + n % 20 as string), '. URL: https://example.org/', cast(n as string)) from d cross join parts where n % 4 = 2
  union all select doc_id, 5, 1, 'ДОДАТКИ' from d
  union all select doc_id, 5, 2, 'Додаток А [999].' from d),
r as (select doc_id, cast(row_number() over (partition by doc_id order by sec, k, line) - 1 as int) as line_no, line from u)
select doc_id, line_no, line, cast(floor(line_no / 30.0) as int) + 1 as page from r"""
SQL = LINES.format(lineitem="lineitem", orders="orders", part="part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus; derived once a session, as plans that are equal share what is kept (it spills to disk, and can be derived again)."""
    return spark.sql(LINES, **{n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part")}).persist()


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout lines of the documents: 12 high, 14 apart, with a gap of 40 more before every seventh; 40 a page."""
    from ..operators.lines import split_lines

    cut = split_lines(table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text"))
    n = F.col("line_no")
    top = (14 * n + 40 * F.floor(n / 7)).cast("double")
    return cut.select("doc_id", (F.floor(n / 40) + 1).cast("int").alias("page"), n.alias("seq"), F.lit(0).alias("block_type"), F.col("line").alias("text"), top.alias("top"), (top + 12).alias("bottom"))


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with a style: ten lines of a document make one, chapter lines are headings."""
    rows = lines(spark, sf_dir)
    head = F.col("line").startswith("РОЗДІЛ")
    block = F.when(F.col("line").rlike("^(Слово|Речення)"), F.floor(F.col("line_no") / 10) * 10 + 9).otherwise(F.col("line_no"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    out = rows.withColumn("_b", block.cast("int")).withColumn("_h", head).withColumn("_k", F.col("line").rlike("^(Слово|Речення)")).groupBy("doc_id", "_b", "_k").agg(F.max("_h").alias("_h"), F.min("line_no").alias("para_no"), F.array_join(F.transform(parts, lambda s: s["line"]), " ").alias("text"))
    return out.select("doc_id", "para_no", F.when(F.col("_h"), "Heading 1").otherwise("Normal").alias("style"), "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus: lines cut at blanks, one block a line."""
    rows = lines(spark, sf_dir).select("doc_id", "page", F.col("line_no").alias("block_no"), F.posexplode(F.split("line", " ")).alias("pos", "text"))
    x, y = (F.col("pos") * 50).cast("double"), (F.col("block_no") % 30 * 14).cast("double")
    return rows.select("doc_id", "page", (F.col("block_no") * 1000 + F.col("pos")).alias("word_no"), "text", "block_no", x.alias("x0"), y.alias("y0"), (x + 7 * F.length("text")).alias("x1"), (y + 12).alias("y1"))
