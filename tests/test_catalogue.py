"""Every query of the catalogue against its oracle, and literal cases."""

import json
import zipfile

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.operators import bibliography, citations, lines, meta, pages, paragraphs, zones
from citeloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "orders", "lineitem", "part"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    want = db.execute(catalogue.ORACLE_SQL[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(c).to_pylist() for c in cols), strict=True)))
    assert rows(got) == rows(want)


def lines_of(spark, texts, page=1):
    return spark.createDataFrame([(1, k, t, page) for k, t in enumerate(texts)], "doc_id long, line_no int, line string, page int")


EXPANSIONS = [
    ("2, 30; 4; 8, 33-36; 52, 10-12, 7; 71, 5, 6", {2, 4, 8, 52, 71}), ("12,47", {12, 47}), ("4, 9, 21-22", {4, 9, 21, 22}), ("6–8", {6, 7, 8}), ("6−8", {6, 7, 8}),
    ("14, с. 9; 28; 33, с. 51", {14, 28, 33}), ("40 с. 7 – 8; 61-62 с. 2-3", {40, 61, 62}), ("9-4", set()), ("2-4-6", set()), ("10-211", set()), ("10-210", set(range(10, 211))), ("88888888888", {88888888888}),
]


def test_expand(spark):
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(EXPANSIONS)], "k int, c string").select("k", citations.expand(F.col("c")).alias("n"))
    assert {r.k: set(r.n) for r in df.collect()} == {k: n for k, (_, n) in enumerate(EXPANSIONS)}


def test_entries(spark):
    zone = lambda ts: zones.split_zones(lines_of(spark, ["СПИСОК ЛІТЕРАТУРИ", *ts]))
    got = lambda ts: {r.num: r.entry for r in bibliography.entries(zone(ts)).collect()}
    assert got(["1. Книга про міста", "1998. Перевидання", "2. Ще одна"]) == {1: "Книга про міста 1998. Перевидання", 2: "Ще одна"}
    assert set(got(["31.", "Коваль О. Львів, 2004.", "32.", "Рядок"])) == {31, 32}
    assert got(["7. Робота: галузь", "08.00.01. Львів.", "8. Наступна."])[7] == "Робота: галузь 08.00.01. Львів."
    assert got(["4. Старе", "4. Нове"]) == {4: "Нове"}


def test_no_header(spark):
    r = zones.zone_summary(zones.split_zones(lines_of(spark, ["a", "b"]))).first()
    assert r.error == "BIBLIOGRAPHY_NOT_FOUND" and r.n_body == 0


def test_citations_span_lines(spark):
    z = zones.split_zones(lines_of(spark, ["слово [38; 52;", "77]. \uf05b 15\uf05d [6; 9] [9; 12]", "REFERENCES"]))
    whole = "[38; 52; 77]"
    assert {r.num: r.bracket for r in citations.first_citations(citations.brackets(z)).collect()} == {38: whole, 52: whole, 77: whole, 15: "\uf05b 15\uf05d", 6: "[6; 9]", 9: "[6; 9]", 12: "[9; 12]"}


def test_style_year_trigger_sentences(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(bibliography.style(F.lit("Львів : Світ, 1987."))) == "partial"
    assert one(bibliography.style(F.lit("Brown A. (1994). Cities."))) == "other"
    assert one(bibliography.year(F.lit("Нарис. – Одеса, 1976. URL : y (дата звернення: 03.02.2021)."))) == 1976
    assert one(bibliography.year(F.lit("Норми ДСТУ 12345"))) is None
    assert one(paragraphs.section_trigger(F.lit("БІБЛІОГРАФІЯ:"), paragraphs.ENDS, True)) is True
    assert one(paragraphs.section_trigger(F.lit("БІБЛІОГРАФІЯ РОЗДІЛУ 4"), paragraphs.ENDS, True)) is False
    assert one(paragraphs.sentence_count(F.lit("Див. рис. 3.2. Ось так. Потім О. Коваль."))) >= 2


def test_author_year(spark):
    rows = lines_of(spark, ["ДЕРЖАВНИЙ ІНСТИТУТ", "КОВАЛЕНКО", "ОЛЕНА ПЕТРІВНА", "УДК 5", "Львів – 2011"])
    assert meta.dissertation_author(rows).first().author == "Коваленко Олена Петрівна"
    assert meta.dissertation_year(rows, 2026).first().year == 2011


def test_author_without_mark(spark):
    rows = lines_of(spark, ["На правах рукопису", "Національний університет міста", "Коваль-Нечуй Іван Петрович", "УДК"])
    assert meta.dissertation_author(rows.where("line_no < 3")).first().author == "Коваль-Нечуй Іван Петрович"


def test_year_passes(spark):
    year = lambda ts: meta.dissertation_year(lines_of(spark, ts), 2020).first().year
    assert year(["у 2012 рік", "Київ", "(2015)"]) == 2012
    assert year(["том (2013)", "1999, 2018, 2026"]) == 2013
    assert year(["1999, 2018, 2026"]) == 2018 and year(["без дати"]) is None


def test_bounds_after_a_long_gap(spark):
    """No chapter after the introduction: the first one behind a gap of more than 100 lines, else the first."""
    bounds = lambda ts: paragraphs.content_bounds(lines_of(spark, ts), spark.createDataFrame([], "doc_id long, start_page int")).first()
    far = ["РОЗДІЛ 1", "РОЗДІЛ 2", *["рядок"] * 110, "РОЗДІЛ 3", "рядок", "ВСТУП", "рядок", "рядок", "ВИСНОВКИ"]
    assert (bounds(far).content_start, bounds(far).content_end) == (112, 116)
    near = ["РОЗДІЛ 1", "РОЗДІЛ 2", "рядок", "ВСТУП", "рядок", "рядок", "ВИСНОВКИ"]
    assert (bounds(near).content_start, bounds(near).error) == (0, None)
    assert bounds(["рядок", "ВИСНОВКИ"]).error == "CONTENT_NOT_FOUND"


def test_page_ranges_with_repeats(spark):
    rows = spark.createDataFrame([(1, p) for p in (4, 3, 3, 9, 10, 11, 7)] + [(2, 5)], "doc_id long, page int")
    assert {r.doc_id: r.ranges for r in pages.page_ranges(rows).collect()} == {1: "3, 3–4, 7, 9–11", 2: "5"}


def test_documents_without_tracked_pages(spark):
    frame = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)], "doc_id long, page int")
    words = spark.createDataFrame([(2, 3, 0, "[4]", 0)], "doc_id long, page int, word_no int, text string, block_no int")
    none = spark.createDataFrame([], "doc_id long, start_page int")
    got = {r.doc_id: (r.tracked, r.n_empty, r.empty_pct, r.ranges) for r in pages.empty_pages(frame, words, none).collect()}
    assert got == {1: (0, 0, 0.0, ""), 2: (1, 0, 0.0, "")}


def test_white_space_pages(spark):
    rows = spark.createDataFrame([(1, "\n\f"), (1, "\u00a0"), (2, "\n"), (2, " x"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.error for r in lines.scanned_guard(rows).collect()} == {1: "SCANNED_PDF", 2: None, 3: "SCANNED_PDF"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 100) | st.integers(0, 1600).map(lambda k: k / 16), min_size=20, max_size=200))
def test_display_rounding(spark, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    for r in df.select("v", text.display(F.col("v")).alias("a"), text.display(F.col("v"), 1).alias("b")).collect():
        assert (r.a, r.b) == (f"{r.v:.0f}", f"{r.v:.1f}")


def test_output_name(spark):
    names = ["a.b.pdf", "plain", ".pdf", "x.PDF", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.output_name(F.col("n")).alias("o")).collect()
    assert all(r.o == r.n.rsplit(".", 1)[0] + "_highlighted.pdf" for r in got)


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, body, styles=None):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")


def test_docx_runs(tmp_path):
    from citeloom.sources import files

    tabs = "<w:pPr><w:pStyle w:val='h1'/><w:tabs><w:tab w:val='left'/><w:tab w:val='right'/></w:tabs></w:pPr>"
    box = "<w:r><w:pict><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:pict></w:r>"
    link = "<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink>"
    body = f"<w:p>{tabs}<w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:br w:type='page'/><w:noBreakHyphen/></w:r>{box}{link}</w:p><w:p/>"
    docx(tmp_path / "a.docx", body, "<w:style w:styleId='h1'><w:name w:val='Heading 1'/></w:style>")
    assert files.docx_paragraphs((tmp_path / "a.docx").read_bytes()) == [("Heading 1", "Title"), ("Normal", "a\tb\nc-link"), ("Normal", "")]


def test_damaged_files(spark, tmp_path):
    from citeloom.sources import files

    docx(tmp_path / "good.docx", "<w:p><w:r><w:t>Слово</w:t></w:r></w:p>")
    docx(tmp_path / "torn.docx", "<w:p><w:r><w:t>" + "слово " * 500 + "</w:t></w:r></w:p>")
    raw = bytearray((tmp_path / "torn.docx").read_bytes())
    raw[60:90] = b"\xff" * 30  # inside the deflate stream
    (tmp_path / "torn.docx").write_bytes(raw)
    (tmp_path / "big.docx").write_bytes(b"x" * 3000)
    parts = files.decode(spark.read.format("binaryFile").load(str(tmp_path)), limit=2000)
    assert {r.path.rsplit("/", 1)[1]: r.error for r in parts.collect()} == {"good.docx": None, "torn.docx": "UNREADABLE", "big.docx": "FILE_TOO_LARGE"}


FITZ = """
import json


class Page:
    def __init__(self, page):
        self.page = page

    def get_text(self, kind="text"):
        return self.page[kind]


class Doc(list):
    def __enter__(self):
        return self

    def __exit__(self, *error):
        pass


def open(stream, filetype):
    return Doc(Page(p) for p in json.loads(stream))
"""


def test_pdf_tables(spark, tmp_path):
    """Words, layout and text of PDF files, by a stand-in for the reader that takes JSON."""
    from citeloom.sources import files

    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "fitz.py").write_text(FITZ)
    spark.sparkContext.addPyFile(str(tmp_path / "lib" / "fitz.py"))
    line = lambda t, top: {"bbox": [0, top, 9, top + 10], "spans": [{"text": t[:3]}, {"text": t[3:]}]}
    long = ["Слова про міста та річки без посилань, рядок перший у довгому абзаці.", "Рядок другий того самого абзацу, що йде одразу за першим рядком."]
    sheets = [
        {"text": "Раз [3] два\nтри", "words": [[0, 0, 5, 9, "Раз", 0, 0, 0], [6, 0, 9, 9, "[3]", 0, 0, 1], [0, 20, 5, 29, "два", 1, 0, 0]], "dict": {"blocks": [{"type": 1}, {"type": 0, "lines": [line(long[0], 0), line(long[1], 12), line("Окремо", 90)]}]}},
        {"text": "", "words": [], "dict": {"blocks": []}},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text(json.dumps(sheets))
    (tmp_path / "in" / "b.pdf").write_text("no")
    docx(tmp_path / "in" / "c.docx", "<w:p/>")
    table = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    found = files.words(table)
    assert sorted(((r.page, r.word_no, r.text, r.error) for r in found.collect()), key=repr) == sorted([(1, 0, "Раз", None), (1, 1, "[3]", None), (1, 2, "два", None), (2, None, None, None), (None, None, None, "UNREADABLE")], key=repr)
    box = pages.highlight_boxes(found.where("text is not null")).first()
    assert (box.text, box.x0, box.y0, box.x1, box.y1) == ("[3]", 6.0, 0.0, 9.0, 9.0)
    paras = paragraphs.extract_paragraphs(files.layout(table).where("error is null"), files.paragraphs(files.decode(table)))
    assert [(r.page, r.text) for r in paras.collect()] == [(1, " ".join(long))]
    assert [(r.page, r.line) for r in files.lines(files.decode(table)).orderBy("line_no").collect()] == [(1, "Раз [3] два"), (1, "три")]


def test_stored_tables(spark, tmp_path):
    from citeloom.sources import files

    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert files.stored(spark, str(tmp_path / "t"), make).count() == 3
    assert made == [1]


def test_folder_stream(spark, tmp_path):
    """Two files in two runs: each is audited once."""
    from citeloom.streaming import folder

    (tmp_path / "in").mkdir()
    body = "<w:p><w:r><w:t>Слово [{0}].</w:t></w:r></w:p><w:p><w:r><w:t>REFERENCES</w:t></w:r></w:p><w:p><w:r><w:t>{1}. Книга</w:t></w:r></w:p>"
    for name, cited, listed in (("a", 1, 1), ("b", 5, 2)):
        docx(tmp_path / "in" / f"{name}.docx", body.format(cited, listed))
        folder.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.epoch, r.num, r.status) for r in got.collect()) == [(0, 1, "used"), (1, 2, "orphan"), (1, 5, "phantom")]


def test_docx(spark, tmp_path):
    from citeloom.sources import files

    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>Раз [1].</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>REFERENCES</w:t></w:r></w:p><w:p><w:r><w:t>1. Один</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"no")
    (tmp_path / "c.txt").write_bytes(b"no")
    parts = files.read_files(spark, str(tmp_path))
    assert {r.error for r in parts.collect()} == {None, "UNREADABLE", "UNSUPPORTED_FORMAT"}
    assert [r.line for r in files.lines(parts).orderBy("line_no").collect()] == ["Раз [1].", "REFERENCES", "1. Один"]
