import datetime as dt
import io
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from paperloom.operators.imports import FIELDS, HEADERS, SHEET, import_errors, import_members, parsed_rows
from paperloom.sources import files
from paperloom.sources.tables import empty_table
from paperloom.sources.workbook import read_workbooks

NOW = dt.datetime(2026, 8, 2)
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(rows: dict[int, list], headers=HEADERS, sheet=SHEET) -> bytes:
    """Cells: text, a date, a number, or ("=", formula)."""

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, tuple):
            return f'<c r="{ref}"><f>{v[1]}</f><v>1</v></c>'
        if isinstance(v, dt.date):
            return f'<c r="{ref}" s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    lines = "".join(f'<row r="{n}">' + "".join(cell(f"{'ABCDEFGHIJKLM'[i]}{n}", v) for i, v in enumerate(cells)) + "</row>" for n, cells in ({1: list(headers)} | rows).items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets><sheet name="{sheet}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{lines}</sheetData></worksheet>")
    return out.getvalue()


def read(spark, raw, **how):
    return read_workbooks(spark.createDataFrame([("f", raw)], "path string, content binary"), SHEET, HEADERS, **how)


def row(name="An", born=None, phone=None, **more):
    cells = dict.fromkeys(FIELDS) | {"full_name": name, "date_of_birth": born, "phone": phone} | more
    return [cells[f] for f in FIELDS]


def errors(spark, raw, members=None):
    cells = read(spark, raw)
    found = import_errors(parsed_rows(cells), members if members is not None else empty_table(spark, "members"))
    return [(r.row_number, r.field, r.message) for r in found.collect()]


def test_normalised_rows_and_blank_ones(spark):
    raw = workbook({
        2: row("  Nguyễn   Văn An  ", dt.date(1990, 2, 3), " 0901 ", email=" AN@X.VN ", status=" inactive ", gender="Male"),
        3: [None, "  "],
        4: row("Bình", "1991-05-06"),
    })
    got = {r.row_number: r for r in parsed_rows(read(spark, raw)).collect()}
    assert sorted(got) == [2, 4]
    assert (got[2].full_name, got[2].date_of_birth, got[2].phone, got[2].email, got[2].status) == ("Nguyễn Văn An", dt.date(1990, 2, 3), "0901", "an@x.vn", "Inactive")
    assert got[4].date_of_birth == dt.date(1991, 5, 6) and got[4].status == "Active" and not got[2].errors + got[4].errors


def test_many_errors_in_order(spark):
    raw = workbook({2: row(" ", "1991-5-6", 901, gender="male", email="x", status="?", notes=("=", "1+1"))})
    assert [e[:2] for e in errors(spark, raw)] == [(2, f) for f in ("full_name", "date_of_birth", "gender", "phone", "email", "status", "notes")]


def test_duplicates_in_the_file_and_table(spark):
    raw = workbook({2: row("A", phone="1"), 3: row("Lê Cường"), 4: row("lê  CƯỜNG"), 5: row("Lê Cường", dt.date(2000, 1, 1)), 6: row("Lê Cường", phone=7)})
    assert [e for e in errors(spark, raw) if e[1] == "duplicate_key"] == [(4, "duplicate_key", "same as row 3")]
    members, none = import_members(read(spark, workbook({2: row(" LÊ  cường ")})), empty_table(spark, "members"), F.lit(NOW))
    assert none.isEmpty() and members.count() == 1
    assert [e for e in errors(spark, workbook({2: row("Lê Cường"), 3: row("Lê Cường", phone="1")}), members)] == [(2, "duplicate_key", "already a member")]


def test_all_or_nothing(spark):
    members, found = import_members(read(spark, workbook({2: row("An"), 3: row("", email="a@b")})), empty_table(spark, "members"), F.lit(NOW))
    assert members.isEmpty() and [r.field for r in found.collect()] == ["full_name"]


@pytest.mark.parametrize(
    "raw, problem",
    [
        (workbook({2: row()}, headers=(*HEADERS, "Thêm")), "headers"),
        (workbook({2: row()}, headers=HEADERS[::-1]), "headers"),
        (workbook({}), "no rows"),
        (workbook({n: row() for n in range(2, 6)}), "too many rows"),
        (workbook({2: row()}, sheet="Khác"), "format"),
        (b"not a workbook", "format"),
    ],
)
def test_whole_file_problems(spark, raw, problem):
    assert [r.problem for r in read(spark, raw, most_rows=3).collect()] == [problem]


def test_file_checks(spark):
    rows = [("a.pdf", b"%PDF-1.7"), ("b.pdf", b"PK"), ("c.xlsx", workbook({2: row()})), ("d.docx", workbook({2: row()})), ("e.exe", b"MZ")]
    table = spark.createDataFrame(rows, "path string, content binary")
    assert {r.path: r.expected for r in files.file_checks(table).collect()} == {"a.pdf": True, "b.pdf": False, "c.xlsx": True, "d.docx": False, "e.exe": False}
    safe = {r.path: r.ok for r in table.select("path", files.safe_package(F.col("content")).alias("ok")).collect()}
    assert safe["c.xlsx"] and not safe["a.pdf"]
    assert table.filter("path = 'c.xlsx'").select(files.safe_package(F.col("content"), 10).alias("ok")).first().ok is False


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "small.pdf").write_bytes(b"%PDF-")
    (tmp_path / "large.pdf").write_bytes(b"x" * 100)
    found = files.read_files(spark, str(tmp_path), most_bytes=10)
    assert [r.length for r in found.collect()] == [5]
    assert files.open_by_key(found, str(tmp_path), "small.pdf").count() == 1 and files.open_by_key(found, str(tmp_path), "gone.pdf").isEmpty()
    with pytest.raises(ValueError):
        files.open_by_key(found, str(tmp_path), "../small.pdf")


def test_extraction(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Xin</w:t></w:r><w:r><w:t> chào</w:t></w:r></w:p><w:p/></w:body></w:document>')
    table = spark.createDataFrame([("a.docx", out.getvalue()), ("b.docx", b"x"), ("c.pdf", b"%PDF-")], "path string, content binary")
    got = {r.path: (r.extraction_status, r.extracted_text) for r in files.extract_texts(table).collect()}
    assert got == {"a.docx": ("Succeeded", "Xin chào\n"), "b.docx": ("Failed", None), "c.pdf": ("Unsupported", None)}


def test_workbooks_as_a_source(spark, tmp_path, monkeypatch):
    """One partition for each file, the same rows as from a table of contents, and each file's own problem."""
    import json

    from paperloom.sources import workbook as source

    source.register(spark)
    good = {2: row("An", dt.date(1990, 2, 3)), 3: [None], 4: row("Bình", phone=7, notes=("=", "1+1"))}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(workbook(good))
    (tmp_path / "b.XLSX").write_bytes(workbook({2: row("Cường")}))
    (tmp_path / "c.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "d.xlsx").write_bytes(b"x" * 5000)
    (tmp_path / "e.txt").write_bytes(b"text")
    reader = spark.read.format("workbook").option("sheet", SHEET).option("headers", json.dumps(HEADERS)).option("mostBytes", 4500)
    df = reader.load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4
    found = {r.path.rsplit("/", 1)[1]: [] for r in df.collect()}
    for r in df.collect():
        found[r.path.rsplit("/", 1)[1]].append((r.row_number, r.cells, r.problem))
    plain = [(r.row_number, r.cells, r.problem) for r in read(spark, workbook(good)).collect()]
    assert found["a.xlsx"] == plain and len(found["b.XLSX"]) == 1
    assert [x[2] for x in found["c.xlsx"]] == ["format"] and [x[2] for x in found["d.xlsx"]] == ["too large"] and "e.txt" not in found
    rows = parsed_rows(df.filter("problem IS NULL"))
    assert sorted(r.full_name for r in rows.collect()) == ["An", "Bình", "Cường"]
    with pytest.raises(Exception, match="headers"):
        spark.read.format("workbook").option("sheet", SHEET).load(str(tmp_path)).collect()
    monkeypatch.setattr(source, "MOST_EXPANDED_BYTES", 100)
    assert source._file_rows("p", workbook(good), SHEET, HEADERS, 10) == [("p", None, None, "format")]


def test_a_sheet_is_never_a_whole_tree():
    from paperloom.sources.workbook import _streamed

    xml = b"<w><s>" + b"".join(b"<row r='%d'><c>x</c></row>" % i for i in range(500)) + b"</s><t/></w>"
    numbers = []
    for element in _streamed(io.BytesIO(xml), "row"):
        numbers.append(int(element.get("r")))
    assert numbers == list(range(500)) and not len(element)
