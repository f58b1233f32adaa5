"""Files to tables. Decoding is the one step that needs Python; everything after it is a plan.

A file that cannot be read gives a row with an error, never a failed job. Kind and size are judged on the listing: only
files that pass are read. DOCX needs the standard library only; PDF needs PyMuPDF, and gives PDF_READER_MISSING without it.
Spark hands files to Python in batches of bounded bytes. stored() keeps a decoded table as Parquet, so that no file is
decoded twice.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rstrip
from ..operators.lines import MAX_BYTES, file_kind, size_guard, split_lines

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "doc_id long, path string, part int, page int, style string, text string, error string"
WORDS = "doc_id long, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string, block_no int, error string"
LAYOUT = "doc_id long, page int, seq int, block_type int, text string, top double, bottom double, error string"
#: Unpacked bytes of a DOCX part, as a multiple of the size limit of files.
MOST_UNPACKED = 10 * MAX_BYTES


def _run_text(run: ElementTree.Element) -> str:
    """Text of one run: its own texts, tabs, line breaks (not those of pages and columns) and hyphens; drawings have none."""
    out = []
    for e in run:
        if e.tag == f"{NS}t":
            out.append(e.text or "")
        elif e.tag in (f"{NS}tab", f"{NS}ptab"):
            out.append("\t")
        elif e.tag == f"{NS}cr" or e.tag == f"{NS}br" and e.get(f"{NS}type", "textWrapping") == "textWrapping":
            out.append("\n")
        elif e.tag == f"{NS}noBreakHyphen":
            out.append("-")
    return "".join(out)


def docx_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(style name, text) of each body paragraph, blank ones included: the runs of a paragraph and of its hyperlinks."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:

        def part(name: str) -> ElementTree.Element:
            if z.getinfo(name).file_size > MOST_UNPACKED:
                raise ValueError("FILE_TOO_LARGE")
            return ElementTree.fromstring(z.read(name))

        names = {}
        if "word/styles.xml" in z.namelist():
            for s in part("word/styles.xml").iter(f"{NS}style"):
                if (n := s.find(f"{NS}name")) is not None:
                    names[s.get(f"{NS}styleId")] = n.get(f"{NS}val")
        body = part("word/document.xml").find(f"{NS}body")
    out = []
    for p in body.findall(f"{NS}p") if body is not None else []:
        style = p.find(f"{NS}pPr/{NS}pStyle")
        key = style.get(f"{NS}val") if style is not None else None
        runs = [r for e in p for r in ([e] if e.tag == f"{NS}r" else e.findall(f"{NS}r") if e.tag == f"{NS}hyperlink" else [])]
        out.append((names.get(key, key or "Normal"), "".join(map(_run_text, runs))))
    return out


def pdf_pages(content: bytes) -> list[str]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return [page.get_text() for page in doc]


def pdf_words(content: bytes) -> list[tuple]:
    """(page, word_no, x0, y0, x1, y1, text, block_no); a page without words gives one row of nulls."""
    import fitz

    out: list[tuple] = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for page, p in enumerate(doc, 1):
            found = [(page, k, *map(float, w[:4]), w[4], int(w[5])) for k, w in enumerate(p.get_text("words"))]
            out += found or [(page, None, None, None, None, None, None, None)]
    return out


def pdf_layout(content: bytes) -> list[tuple]:
    """(page, seq, block_type, text, top, bottom) of the lines of text blocks."""
    import fitz

    out: list[tuple] = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for page, p in enumerate(doc, 1):
            rows = [(b, x) for b in p.get_text("dict").get("blocks", []) if b.get("type") == 0 for x in b.get("lines", [])]
            for seq, (b, x) in enumerate(rows):
                box = x.get("bbox", (0, 0, 0, 0))
                out.append((page, seq, b["type"], "".join(t.get("text", "") for t in x.get("spans", [])), float(box[1]), float(box[3])))
    return out


def parts_of(kind: str, path: str, content: bytes) -> list[tuple]:
    if kind == "docx":
        return [(path, k, None, s, t) for k, (s, t) in enumerate(docx_paragraphs(content))]
    found = pdf_pages(content)
    if not any(t.strip() for t in found):
        raise ValueError("SCANNED_PDF")
    return [(path, k, k + 1, None, t) for k, t in enumerate(found)]


def _table(files: DataFrame, schema: str, read: Callable[[str, str, bytes], list[tuple]], kinds: tuple[str, ...], limit: int) -> DataFrame:
    """Rows that `read` gives for each file of a binaryFile table, or a row with an error (and the path, if there is a column for it)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for r in frame.itertuples():
                try:
                    rows += [(r.doc_id, *x, None) for x in read(r.kind, r.path, bytes(r.content))]
                except Exception as e:  # whatever a damaged file makes a decoder raise
                    code = "PDF_READER_MISSING" if isinstance(e, ModuleNotFoundError) else str(e) if str(e) in ("SCANNED_PDF", "FILE_TOO_LARGE") else "UNREADABLE"
                    rows.append((r.doc_id, *[r.path if c == "path" else 0 if c == "part" else None for c in names[1:-1]], code))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c.split()[0]: "Int32" for c in schema.split(", ") if c.endswith(" int")} | {c.split()[0]: "Float64" for c in schema.split(", ") if c.endswith(" double")})

    kind = file_kind(F.col("path"))
    error = F.when(kind.isNull(), "UNSUPPORTED_FORMAT").otherwise(size_guard(F.col("length"), limit))
    judged = files.withColumn("kind", kind).withColumn("error", error).withColumn("doc_id", F.xxhash64("path"))
    fine = judged.where(F.col("error").isNull() & F.col("kind").isin(*kinds)).select("doc_id", "path", "kind", "content").mapInPandas(run, schema)
    if "path" not in names:
        return fine
    lost = judged.where("error is not null").select("doc_id", "path", F.lit(0).alias("part"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("style"), F.lit(None).cast("string").alias("text"), "error")
    return fine.unionByName(lost)


def decode(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Parts of the files of a binaryFile table: paragraphs of DOCX, pages of PDF, or one row with an error."""
    return _table(files, SCHEMA, parts_of, ("docx", "pdf"), limit)


def words(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Word boxes of PDF files; a page without words has a row without a word. Files that cannot be read have a row with an error."""
    return _table(files, WORDS, lambda kind, path, content: pdf_words(content), ("pdf",), limit)


def layout(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Layout lines of PDF files."""
    return _table(files, LAYOUT, lambda kind, path, content: pdf_layout(content), ("pdf",), limit)


def paragraphs(parts: DataFrame) -> DataFrame:
    """Styled paragraphs (doc_id, para_no, style, text) of DOCX files."""
    return parts.where("page is null and error is null").select("doc_id", F.col("part").alias("para_no"), "style", "text")


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; make() fills it if it is not there yet, or not whole."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def lines(parts: DataFrame) -> DataFrame:
    """doc_id, line_no, line, page: PDF pages cut into lines, DOCX paragraphs as they are, blank ones dropped."""
    pdf = split_lines(parts.where("page is not null").select("doc_id", "page", "text"))
    docx = parts.where("page is null and error is null").select("doc_id", "part", rstrip(F.col("text")).alias("line")).where("line <> ''")
    n = (F.row_number().over(W.partitionBy("doc_id").orderBy("part")) - 1).cast("int")
    return pdf.unionByName(docx.select("doc_id", n.alias("line_no"), "line", F.lit(None).cast("int").alias("page")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(path))
