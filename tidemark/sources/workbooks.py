"""Spreadsheets (.xlsx, and zip archives of them) as tables.

A workbook is a zip of XML parts. Spark lists and reads the files (``binaryFile``), and each is opened on an executor with the standard
library: one row comes out for each row of a sheet, with its cells as an array. A sheet's XML is parsed as a stream, so a task
holds the file itself, its shared strings and a row at a time. Nothing is read on the driver. What a sheet's rows mean is worked out on tables afterwards:
``titled`` for a plain header, ``by_code_row`` for columns named by a row of codes, ``crosstab`` for both layouts of a cross table.

Cases: a blank cell is null, as is a cell that holds an error; booleans are TRUE and FALSE; numbers keep the digits that the file has; a number with a date
format is an ISO date (with a time of day if it has one); of a merged range every cell has the value of its first one, if asked for; a workbook without matching
sheets gives no rows; a file that is neither a workbook nor an archive of some is an error that names it.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import number
from ..session import checkpointed, stored

#: The names by which exports mark periods, and that of a yearly figure.
MONTH_NAMES = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")
PERIOD = rf"^(?:{'|'.join(MONTH_NAMES)})$|квартал|за год|^январь-"
ANNUAL_TITLE, ANNUAL = "за год", "значение показателя за год"
#: Number formats that are dates in every workbook; others are recognised by the letters of their code.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_SHEET = ("file", "book", "sheet")
ROWS = "file string, book string, sheet string, row int, values array<string>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _place(ref: str) -> tuple[int, int]:
    """Row and column, from zero, of a reference such as B3."""
    letters = ref.rstrip("0123456789")
    column = 0
    for c in letters.replace("$", ""):
        column = 26 * column + ord(c) - 64
    return int(ref[len(letters) :]) - 1, column - 1


class Workbook:
    """The sheets of one file, in their order; rows are parsed when asked for."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        root = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets: dict[str, str] = {}
        self.first_day = dt.datetime(1899, 12, 30)
        for e in root.iter():
            if _local(e.tag) == "sheet":
                target = links[next(v for k, v in e.attrib.items() if _local(k) == "id")]
                self.sheets[e.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            elif _local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true"):
                self.first_day = dt.datetime(1904, 1, 1)
        self.strings = list(self._strings()) if "xl/sharedStrings.xml" in names else []
        self.dated = self._dated() if "xl/styles.xml" in names else []

    def _parsed(self, part: str) -> Iterator[ElementTree.Element]:
        """Elements as they end."""
        with self.zip.open(part) as f:
            for _, e in ElementTree.iterparse(f):
                yield e

    @staticmethod
    def _text(e: ElementTree.Element) -> str:
        """The runs of a string; what is only there to be pronounced is left out."""
        if _local(e.tag) == "rPh":
            return ""
        return (e.text or "") if _local(e.tag) == "t" else "".join(map(Workbook._text, e))

    def _strings(self) -> Iterator[str]:
        for e in self._parsed("xl/sharedStrings.xml"):
            if _local(e.tag) == "si":
                yield self._text(e)
                e.clear()

    def _dated(self) -> list[bool]:
        """For each cell style, whether its number format is a date."""
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if _local(e.tag) == "numFmt"}
        dates = {k for k, code in own.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower()))}
        styles = [x for e in root if _local(e.tag) == "cellXfs" for x in e]
        return [int(x.get("numFmtId", 0)) in _DATE_FORMATS | dates for x in styles]

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, raw = cell.get("t", "n"), None
        for e in cell:
            if _local(e.tag) == "is":
                return self._text(e)
            if _local(e.tag) == "v":
                raw = e.text
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(raw)]
        if kind == "b":
            return "TRUE" if raw == "1" else "FALSE"
        style = int(cell.get("s", 0))
        if kind == "n" and style < len(self.dated) and self.dated[style]:
            at = self.first_day + dt.timedelta(milliseconds=round(float(raw) * 86_400_000))
            return at.date().isoformat() if at.time() == dt.time() else at.isoformat(sep=" ")
        return raw

    def merges(self, sheet: str) -> list[tuple[int, int, int, int]]:
        """First row, first column, last row and last column of each merged range."""
        found = []
        for e in self._parsed(self.sheets[sheet]):
            if _local(e.tag) == "mergeCell":
                first, _, last = e.get("ref").partition(":")
                found.append((*_place(first), *_place(last or first)))
            elif _local(e.tag) in ("row", "c"):
                e.clear()
        return found

    def rows(self, sheet: str, fill: str = "none") -> Iterator[tuple[int, list[str | None]]]:
        """(row, cells) of the rows that the file has. ``fill``: "across" repeats a merged cell's value along its first row, "all" in
        its whole range, also in rows that the file leaves out."""
        ranges = self.merges(sheet) if fill != "none" else []
        if fill == "across":
            ranges = [(a, b, a, d) for a, b, _, d in ranges]
        starts: dict[int, list] = {}
        for r in ranges:
            starts.setdefault(r[0], []).append(r)
        open_: list[tuple[int, int, int, str | None]] = []  # last row, first and last column, value

        def filled(at: int, cells: list[str | None]) -> list[str | None]:
            for _, left, _, right in (hold := starts.pop(at, [])):
                cells += [None] * (right + 1 - len(cells))
                cells[left + 1 : right + 1] = [cells[left]] * (right - left)
            for last, left, right, value in open_:
                if at <= last:
                    cells += [None] * (right + 1 - len(cells))
                    cells[left : right + 1] = [value] * (right + 1 - left)
            open_[:] = [o for o in open_ if o[0] > at] + [(last, left, right, cells[left]) for _, left, last, right in hold if last > at]
            return cells

        done = -1
        for e in self._parsed(self.sheets[sheet]):
            if _local(e.tag) != "row":
                continue
            at = int(e.get("r")) - 1 if e.get("r") else done + 1
            while open_ and done + 1 < at and done + 1 <= max(o[0] for o in open_):
                done += 1
                yield done, filled(done, [])
            cells: list[str | None] = []
            for c in e:
                column = _place(c.get("r"))[1] if c.get("r") else len(cells)
                cells += [None] * (column + 1 - len(cells))
                cells[column] = self._value(c)
            yield at, filled(at, cells)
            done = at
            e.clear()
        while open_:
            done += 1
            yield done, filled(done, [])


def _books(content: bytes, file: str) -> Iterator[tuple[str | None, bytes]]:
    """(name in its archive, content): the file itself, or the workbooks of an archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if "xl/workbook.xml" in names:
                yield None, content
                return
            for info in z.infolist():
                if info.filename.lower().endswith(".xlsx"):
                    name = info.filename
                    if not info.flag_bits & 0x800:  # no UTF-8 mark: old archivers write the DOS code page
                        name = name.encode("cp437", "replace").decode("cp866", "replace")
                    yield name, z.read(info)
    except zipfile.BadZipFile as e:
        raise ValueError(f"neither a workbook nor an archive: {file}") from e


def sheet_rows(
    spark: SparkSession, path: str, sheet: str = "", book: str = "", fill: str = "none", glob: str = "*", batch: int = 4096
) -> DataFrame:
    """(file, book, sheet, row, values) of all workbooks under a path, archives included.

    ``sheet`` and ``book`` are patterns that must be found in the names (of the sheet, and of the workbook in its archive); row numbers start at zero.
    """
    wanted, inside = re.compile(sheet), re.compile(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*_SHEET, "row", "values"])

        for some in batches:
            for file, content in zip(some.column("path").to_pylist(), some.column("content"), strict=True):
                rows: list[tuple] = []
                for name, data in _books(content.as_py(), file):
                    if name is not None and not inside.search(name):
                        continue
                    found = Workbook(data)
                    for title in found.sheets:
                        if wanted.search(title):
                            for at, cells in found.rows(title, fill):
                                rows.append((file, name, title, at, cells))
                                if len(rows) >= batch:
                                    yield out(rows)
                                    rows = []
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, ROWS)


def _blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def titled(rows: DataFrame, columns: Mapping[str, int], first_row: int = 1) -> DataFrame:
    """Columns by their place, from a row on; rows whose cells are all blank go. (file, book, sheet, row, the columns.)"""
    some = rows.where(F.col("row") >= first_row).where(F.exists("values", lambda x: ~_blank(x)))
    return some.select(*_SHEET, "row", *(F.get("values", F.lit(k)).alias(name) for name, k in columns.items()))


def by_code_row(rows: DataFrame, marker: str, codes: Mapping[str, str]) -> DataFrame:
    """(file, book, sheet, row, name, a column for each code): rows below the row of codes, which is the first whose first cell is ``marker``.

    ``codes`` gives the columns' names by their code; a code that the sheet doesn't have is null. A sheet without such a row gives none.
    """
    first = F.trim(F.get("values", F.lit(0)))
    trimmed = F.transform("values", lambda x: F.trim(x))
    heads = rows.where(first == marker).groupBy(*_SHEET).agg(F.min(F.struct("row", trimmed.alias("codes"))).alias("h"))  # a row a sheet
    keyed = heads.select(*(F.col(c).alias(f"_{c}") for c in _SHEET), F.col("h.row").alias("_at"), F.col("h.codes").alias("_codes"))
    same = (F.col("file") == F.col("_file")) & F.col("book").eqNullSafe(F.col("_book")) & (F.col("sheet") == F.col("_sheet"))
    below = rows.join(keyed, same).where("row > _at").where(~_blank(first))
    at = lambda code: F.array_position(F.transform("_codes", lambda x: F.coalesce(x, F.lit(""))), code)
    return below.select(*_SHEET, "row", first.alias("name"), *(F.when(at(c) > 0, number(F.get("values", (at(c) - 1).cast("int")))).alias(n) for c, n in codes.items()))


def crosstab(rows: DataFrame, period: str = PERIOD, head: int = 10) -> DataFrame:
    """(file, book, sheet, dims array<string>, period, year, value) of cross tables in either layout.

    Wide: one of the first ``head`` rows holds years only, each over the columns up to the next; the row below may hold
    periods; further rows without labels are dimensions of the columns; what stands left of the first year labels the rows. Without a row of periods, a label column
    that holds nothing else is the period, or else the title must say that the figures are yearly. Long: from the fourth row on, one column
    holds years, one periods, the last one the value, all others dimensions. A sheet is known by its file, so sheets of
    both layouts may be mixed. Years and periods are found by aggregates a sheet and column; cells meet their column's header in a join. The rows
    are written once, as each of these steps reads them.
    """
    key = [F.coalesce("book", F.lit("")).alias("book") if c == "book" else F.col(c) for c in _SHEET]
    rows, _ = stored(rows.select(*key, "row", F.transform("values", lambda x: F.when(~_blank(x), F.trim(x))).alias("v")))  # each file is opened once
    keys = list(_SHEET)
    is_year, is_period = (lambda x: x.rlike("^[0-9]{4}$")), (lambda x: x.rlike(period))
    known = F.filter("v", lambda x: x.isNotNull())
    years = (F.size(known) > 0) & F.forall(known, is_year)
    first = F.array_position(F.transform("v", lambda x: x.isNotNull()), F.lit(True)).cast("int") - 1
    year_rows = rows.where((F.col("row") < head) & years).groupBy(*keys).agg(F.min(F.struct("row", first.alias("first"))).alias("y"))
    year_rows = checkpointed(year_rows.select(*keys, F.col("y.row").alias("year_row"), F.col("y.first").alias("first")))  # a row a sheet
    wide = rows.join(year_rows, keys)
    labelled = F.exists(F.slice("v", F.lit(1), F.col("first")), lambda x: x.isNotNull())
    right = F.filter(F.slice("v", F.col("first") + 1, F.greatest(F.size("v") - F.col("first"), F.lit(0))), lambda x: x.isNotNull())
    below = F.col("row") == F.col("year_row") + 1
    body_row = F.min(F.when((F.col("row") > F.col("year_row")) & labelled, F.col("row")))
    has_periods = F.coalesce(F.bool_or(F.when(below, ~labelled & (F.size(right) > 0) & F.forall(right, is_period))), F.lit(False))
    title = F.max(F.when(F.col("row") == 0, F.get("v", F.lit(0))))
    shape = checkpointed(wide.groupBy(*keys, "year_row", "first").agg(body_row.alias("body_row"), has_periods.alias("has_periods"), title.alias("title")))
    wide = wide.drop("year_row", "first").join(shape, keys)

    # the header of each column: every header row's last value up to it
    top = wide.where((F.col("row") >= F.col("year_row")) & (F.col("row") < F.col("body_row")) & (F.size(right) > 0))
    cells = top.select(*keys, "row", "year_row", "first", "has_periods", F.posexplode("v").alias("col", "x")).where("col >= first")
    width = wide.where("row >= year_row").groupBy(*keys).agg(F.max(F.size("v")).alias("width"))
    spans = cells.where("x is not null").withColumn("next", F.lead("col").over(Window.partitionBy(*keys, "row").orderBy("col")))
    spans = spans.join(width, keys).select(*keys, "row", "year_row", "has_periods", "x", F.explode(F.sequence("col", F.coalesce("next", "width") - 1)).alias("col"))
    role = F.when(F.col("row") == F.col("year_row"), "year").when(F.col("has_periods") & below, "period")
    marked = spans.withColumn("role", role)
    extra = F.array_sort(F.collect_list(F.when(F.col("role").isNull(), F.struct("row", "x"))))
    heads = marked.groupBy(*keys, "col").agg(
        F.max(F.when(F.col("role") == "year", F.col("x"))).alias("year"), F.max(F.when(F.col("role") == "period", F.col("x"))).alias("head_period"),
        F.transform(extra, lambda h: h["x"]).alias("headers"),
    )

    body = wide.where("row >= body_row").select(*keys, "row", "first", "has_periods", "title", "v")
    labels = F.transform(F.sequence(F.lit(0), F.col("first") - 1), lambda k: F.get("v", k))
    body = body.withColumn("labels", F.when(F.col("first") > 0, labels).otherwise(F.array().cast("array<string>")))
    seen = body.where("not has_periods").select(*keys, F.posexplode("labels").alias("k", "x")).where("x is not null")
    periodic = seen.groupBy(*keys, "k").agg(F.bool_and(is_period(F.col("x"))).alias("p")).where("p").groupBy(*keys).agg(F.min("k").alias("period_col"))
    body = body.join(periodic, keys, "left").join(shape.select(*keys), keys, "left_semi")
    long = body.select(*keys, "row", "labels", "period_col", "title", F.posexplode("v").alias("col", "x"), "first").where("col >= first and x is not null").join(heads, [*keys, "col"])
    no_period = F.raise_error(F.concat(F.lit("no period in the header or the rows: "), "file", F.lit(" "), "sheet")).cast("string")
    found = F.coalesce("head_period", F.get("labels", F.col("period_col")), F.when(F.col("title").contains(ANNUAL_TITLE), F.lit(ANNUAL)), no_period)
    kept = F.filter("labels", lambda x, k: ~k.eqNullSafe(F.col("period_col")))
    from_wide = long.select(*keys, F.concat(kept, "headers").alias("dims"), found.alias("period"), F.col("year").try_cast("int").alias("year"), number(F.col("x")).alias("value"))

    flat = rows.where("row >= 3").join(year_rows, keys, "left_anti").select(*keys, "row", "v")
    stats = flat.select(*keys, F.posexplode("v").alias("k", "x")).where("x is not null").groupBy(*keys, "k")
    stats = stats.agg(F.bool_and(is_year(F.col("x"))).alias("y"), F.bool_and(is_period(F.col("x"))).alias("p"))
    cols = stats.groupBy(*keys).agg(F.min(F.when(F.col("y"), F.col("k"))).alias("yc"), F.min(F.when(F.col("p"), F.col("k"))).alias("pc"), F.max("k").alias("vc"))
    flat = flat.join(cols, keys)
    rest = F.filter(F.slice("v", F.lit(1), F.col("vc")), lambda x, k: (k != F.col("yc")) & (k != F.col("pc")))
    from_long = flat.where("yc is not null and pc is not null").select(
        *keys, rest.alias("dims"), F.get("v", F.col("pc")).alias("period"), F.get("v", F.col("yc")).try_cast("int").alias("year"), number(F.get("v", F.col("vc"))).alias("value")
    )
    both = from_wide.unionByName(from_long).where("value is not null and year is not null")
    return both.withColumn("book", F.nullif("book", F.lit("")))


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _reference(row: int, column: int) -> str:
    letters, column = "", column + 1
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row + 1}"


def workbook_bytes(sheets: Sequence[tuple[str, Sequence[Sequence], Sequence[tuple[int, int, int, int]]]]) -> bytes:
    """A workbook of (name, rows, merged ranges): strings are shared, numbers and booleans plain, dates styled numbers, None blank."""
    strings: dict[str, int] = {}
    out = io.BytesIO()

    def cell(row: int, column: int, value) -> str:
        ref = _reference(row, column)
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, dt.date):
            return f'<c r="{ref}" s="1"><v>{(value - dt.date(1899, 12, 30)).days}</v></c>'
        if isinstance(value, str):
            return f'<c r="{ref}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'
        return f'<c r="{ref}"><v>{value!r}</v></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, text: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + text, zipfile.ZIP_DEFLATED)  # equal content, equal bytes

        types, links, names = [], [], []
        for k, (name, rows, merges) in enumerate(sheets, 1):
            lines = (f'<row r="{r + 1}">{"".join(cell(r, c, v) for c, v in enumerate(row) if v is not None)}</row>' for r, row in enumerate(rows))
            joined = "".join(f'<mergeCell ref="{_reference(a, b)}:{_reference(c, d)}"/>' for a, b, c, d in merges)
            put(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData>' + (f"<mergeCells>{joined}</mergeCells>" if joined else "") + "</worksheet>")
            types.append(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
            links.append(f'<Relationship Id="rId{k}" Type="{_LINK}/worksheet" Target="worksheets/sheet{k}.xml"/>')
            names.append(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>')
        put("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{"".join(f"<si><t xml:space=\"preserve\">{escape(s)}</t></si>" for s in strings)}</sst>')
        put("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>')
        put("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINK}"><sheets>{"".join(names)}</sheets></workbook>')
        extra = f'<Relationship Id="s1" Type="{_LINK}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="s2" Type="{_LINK}/styles" Target="styles.xml"/>'
        package = "http://schemas.openxmlformats.org/package/2006"
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{"".join(links)}{extra}</Relationships>')
        put("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        main = '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        put("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{main}{"".join(types)}</Types>')
    return out.getvalue()


def archive_bytes(files: Mapping[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()
