"""Workbooks: cells of every type, merged ranges, archives, both cross-table layouts, code rows."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pytest

from tidemark.sources import sinks as S
from tidemark.sources import workbooks as W

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_types_of_cells_and_places():
    content = W.workbook_bytes([("A & <b>", [["x", 1, 2.5, True, dt.date(2024, 2, 29), None, "ä<&>"], [], [None, None, " y "]], ())])
    book = W.Workbook(content)
    assert list(book.sheets) == ["A & <b>"]
    assert list(book.rows("A & <b>")) == [(0, ["x", "1", "2.5", "TRUE", "2024-02-29", None, "ä<&>"]), (1, []), (2, [None, None, " y "])]
    assert W._place("AB12") == (11, 27) and W._reference(11, 27) == "AB12" and W._reference(0, 701) == "ZZ1"
    assert W.workbook_bytes([("A", [["x"]], ())]) == W.workbook_bytes([("A", [["x"]], ())])


def book_of(sheet: str, **parts: str) -> bytes:
    """A plain workbook with its parts replaced or added."""
    with zipfile.ZipFile(io.BytesIO(W.workbook_bytes([("S", [], ())]))) as z:
        found = {n: z.read(n) for n in z.namelist()}
    found["xl/worksheets/sheet1.xml"] = f"<worksheet {MAIN}>{sheet}</worksheet>".encode()
    return W.archive_bytes(found | {f"xl/{k}.xml": v.encode() for k, v in parts.items()})


def test_what_other_writers_do():
    sheet = """<sheetData><row r="2"><c r="B2" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c t="str"><v>formula</v></c><c r="E2" t="e"><v>#N/A</v></c></row>
    <row><c t="s"><v>0</v></c><c s="2"><v>1.5</v></c><c s="3"><v>1.5</v></c><c s="1"><v>1E3</v></c><c><v/></c></row></sheetData>"""
    strings = f'<sst {MAIN}><si><r><t>Tok</t></r><r><t>yo</t></r><rPh><t>loud</t></rPh></si></sst>'
    styles = f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf/><xf numFmtId="1"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    book = W.Workbook(book_of(sheet, sharedStrings=strings, styles=styles))
    assert list(book.rows("S")) == [(1, [None, "inline", "formula", None, None]), (2, ["Tokyo", "1899-12-31 12:00:00", "1.5", "1E3", None])]


def test_merged_ranges():
    rows = [["a", None, "b"], ["c", "d", None], [], ["e"]]
    book = W.Workbook(W.workbook_bytes([("S", rows, [(0, 0, 0, 1), (0, 2, 1, 3), (1, 0, 2, 0)])]))
    plain = [(0, ["a", None, "b"]), (1, ["c", "d"]), (2, []), (3, ["e"])]
    assert list(book.rows("S")) == plain
    assert list(book.rows("S", "across")) == [(0, ["a", "a", "b", "b"]), (1, ["c", "d"]), (2, []), (3, ["e"])]
    assert list(book.rows("S", "all")) == [(0, ["a", "a", "b", "b"]), (1, ["c", "d", "b", "b"]), (2, ["c"]), (3, ["e"])]
    tall = W.Workbook(book_of('<sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B3"/></mergeCells>'))
    assert list(tall.rows("S", "all")) == [(k, ["7", "7"]) for k in range(3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    path = str(tmp_path_factory.mktemp("books"))
    jan, feb = W.MONTH_NAMES[:2]
    wide = [["Title"], [], [None, None, "2023", None, None, "2024"], [None, None, jan, None, feb, jan], [None, None, "u", "v", "u", "u"], ["r1", "p", 1, "2,5", 3, None], ["  r2", "q", "1 000", None, "x", 4]]
    merged = [["T, " + W.ANNUAL_TITLE], [None, "2023", "2024"], ["r1", 10, 20], ["r2", None, 30]]
    by_row = [["T"], [None, None, "2022", "2023"], ["r1", jan, 1, 2], ["r1", feb, 3, 4], ["r2", jan, 5, 6]]
    long = [["T"], [], ["Region", "Year", "Kind", "Month", "Value"], ["r1", "2023", "k", jan, 1.5], ["r2", "2024", None, feb, "2,5"], ["r3", "2024", "k", feb, None]]
    coded = [["T"], ["А", "1", "2"], ["n1", 5, 6], [" n2 ", "-", 8], [None, 1, 1]]
    files = {
        "wide.xlsx": W.workbook_bytes([("wide", wide, [(2, 2, 2, 4), (3, 2, 3, 3)]), ("annual", merged, ()), ("rows", by_row, ())]),
        "pack.zip": W.archive_bytes({"Книга 1.xlsx": W.workbook_bytes([("long", long, ()), ("1-coded", coded, ())]), "other.xlsx": W.workbook_bytes([("1-coded", coded, ())]), "x.txt": b"x"}),
    }
    done = S.write_files(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "name string, content binary"), path)
    assert {r["name"]: r["bytes"] for r in done.collect()} == {k: len(v) for k, v in files.items()}
    return path


def test_both_layouts(spark, folder):
    rows = W.sheet_rows(spark, folder, fill="across", sheet="^(wide|annual|rows|long)$")
    got = sorted((r.sheet, *r.dims, r.period, r.year, r.value) for r in W.crosstab(rows).collect() if None not in r.dims)
    jan, feb = W.MONTH_NAMES[:2]
    want = [("wide", "r1", "p", "u", jan, 2023, 1.0), ("wide", "r1", "p", "v", jan, 2023, 2.5), ("wide", "r1", "p", "u", feb, 2023, 3.0), ("wide", "r2", "q", "u", jan, 2023, 1000.0), ("wide", "r2", "q", "u", jan, 2024, 4.0)]
    want += [("annual", "r1", W.ANNUAL, 2023, 10.0), ("annual", "r1", W.ANNUAL, 2024, 20.0), ("annual", "r2", W.ANNUAL, 2024, 30.0)]
    want += [("rows", r, p, y, v) for r, p, a, b in (("r1", jan, 1.0, 2.0), ("r1", feb, 3.0, 4.0), ("r2", jan, 5.0, 6.0)) for y, v in ((2022, a), (2023, b))]
    want += [("long", "r1", "k", jan, 2023, 1.5)]
    assert got == sorted(want)
    # without the ranges, a header still holds up to the next one
    plain = W.crosstab(W.sheet_rows(spark, folder, sheet="^wide$")).collect()
    assert sorted((*r.dims, r.period, r.year, r.value) for r in plain) == sorted(w[1:] for w in want if w[0] == "wide")
    assert {tuple(r.dims) for r in W.crosstab(rows.where("sheet = 'long'")).collect()} == {("r1", "k"), ("r2", None)}


def test_a_table_without_periods_is_an_error(spark, tmp_path):
    S.write_files(spark.createDataFrame([("a.xlsx", bytearray(W.workbook_bytes([("S", [["T"], [None, "2023"], ["r1", 1]], ())])))], "name string, content binary"), str(tmp_path)).count()
    with pytest.raises(Exception, match="no period"):
        W.crosstab(W.sheet_rows(spark, str(tmp_path), glob="*.xlsx")).collect()


def test_code_rows_archives_and_titles(spark, folder):
    rows = W.sheet_rows(spark, folder, sheet="^1(-|$)", book="Книга")
    got = W.by_code_row(rows, "А", {"1": "one", "2": "two", "9": "none"}).collect()
    assert sorted((r.book, r["name"], r.one, r.two, r.none) for r in got) == [("Книга 1.xlsx", "n1", 5.0, 6.0, None), ("Книга 1.xlsx", "n2", None, 8.0, None)]
    assert W.by_code_row(rows, "Z", {"1": "one"}).count() == 0 and W.sheet_rows(spark, folder, sheet="nothing").count() == 0
    titled = W.titled(W.sheet_rows(spark, folder, sheet="^rows$"), {"region": 0, "value": 2}, first_row=2).collect()
    assert [(r.row, r.region, r.value) for r in titled] == [(2, "r1", "1"), (3, "r1", "3"), (4, "r2", "5")]


def test_other_files_are_named(spark, tmp_path):
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip")
    with pytest.raises(Exception, match="neither a workbook nor an archive.*broken.xlsx"):
        W.sheet_rows(spark, str(tmp_path)).collect()
