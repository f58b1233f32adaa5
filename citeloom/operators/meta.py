"""Year and author of a dissertation from its first lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse, strip, title, word_count

# fixed values: cities, institution words
CITIES = "Київ|Харків|Львів|Одеса|Дніпро|Запоріжжя|Вінниця|Миколаїв|Суми|Полтава|Чернівці|Черкаси|Херсон|Хмельницький|Рівне|Луцьк|Тернопіль|Ужгород|Кропивницький|Житомир|Чернігів|Івано-Франківськ"
INSTITUTIONS = ("університет", "університету", "інститут", "інституту", "академія", "академії", "міністерство", "міністерства", "національний", "національна", "національного", "національної", "державний", "державна", "державного", "державної", "імені", "гончара", "факультет", "кафедра")
# fixed values: years, places of a year, a full name
Y = r"(20[0-2]\d|19[89]\d)"
ANCHORS = (rf"(?Ud)(?:{CITIES})\s*[–—\-]\s*{Y}", rf"(?Ud)\b{Y}\s+(?:р(?:ік|\.)|рр\.)", rf"(?Ud)\(\s*{Y}\s*\)\s*$")
NAME = r"(?U)^[А-ЯІЇЄҐ][а-яіїєґА-ЯІЇЄҐʼ'\-]+(?:\s+[А-ЯІЇЄҐ][а-яіїєґА-ЯІЇЄҐʼ'\-]+){1,2}$"


def dissertation_year(lines: DataFrame, as_of_year: int, max_lines: int = 60) -> DataFrame:
    """doc_id, year: city and year, then a year word, then a bracketed year at a line end, else the latest year until now."""
    head = lines.where(F.col("line_no") < max_lines)
    found = [F.regexp_extract("line", p, 1).try_cast("int") for p in ANCHORS]
    firsts = [F.min(F.when(y.isNotNull(), F.struct("line_no", y.alias("y"))))["y"] for y in found]
    loose = F.array_max(F.filter(F.transform(F.regexp_extract_all("line", F.lit(rf"(?U)\b{Y}\b"), F.lit(1)), lambda y: y.cast("int")), lambda y: y <= as_of_year))
    known = head.groupBy("doc_id").agg(F.coalesce(*firsts, F.max(loose)).alias("year"))
    return lines.select("doc_id").distinct().join(known, "doc_id", "left")


def dissertation_author(lines: DataFrame, max_lines: int = 80) -> DataFrame:
    """doc_id, author: the lines above the classification mark, else the first line that looks like a full name."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    rows = lines.where(F.col("line_no") < max_lines).withColumn("t", strip(F.col("line")))
    rows = rows.withColumns({"p1": F.lag("t", 1).over(w), "p2": F.lag("t", 2).over(w)})
    mark = F.upper("t").startswith("УДК") & F.col("p1").isNotNull()
    split = (word_count(F.col("p1")) == 2) & F.col("p2").isNotNull() & (word_count(F.col("p2")) == 1) & (F.upper("p2") == F.col("p2")) & F.col("p2").rlike(r"\p{Lu}")
    above = F.when(mark, F.when(word_count(F.col("p1")) == 3, F.col("p1")).when(split, F.concat_ws(" ", "p2", "p1")))
    low = F.lower("t")
    words = F.split(collapse(low), " ")
    named = (word_count(F.col("t")) == 3) & F.col("t").rlike(NAME) & ~low.contains("рукопису") & ~low.contains("праця") & ~F.arrays_overlap(words, F.array(*map(F.lit, INSTITUTIONS)))
    pick = lambda c: F.min(F.when(c.isNotNull(), F.struct("line_no", c.alias("v"))))["v"]
    return rows.groupBy("doc_id").agg(title(F.coalesce(pick(above), pick(F.when(named, F.col("t"))))).alias("author"))
