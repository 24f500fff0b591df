"""Spreadsheet workbooks (``.xlsx``) as a source and a sink (SRC1, PRJ3, SNK1).

``scan_workbooks`` lists and opens the files with Spark's ``binaryFile`` reader, so any
path that Spark can open will do, and every workbook is decoded in the task that reads it:
the sheet's XML is streamed out of the archive, a row at a time.  A worksheet holds
1,048,576 rows at most, which bounds a task.  Sheets keep their own headers: a row is a
map from header to text, and ``workbook_columns`` resolves the expected headers in it, so
files with different columns need no driver-side look at any of them.

Defined results: cells are text (numbers as stored, dates as ``yyyy-MM-dd HH:mm:ss``,
booleans ``true`` / ``false``); empty and error cells are NULL; the first row that has
a cell is the header; columns without a header are dropped, of two headers with the same
key the first stays; rows without any cell are skipped.  A file that is no workbook
gives one row with ``error`` and nothing else, a damaged one the rows before the damage and
such a row; an empty sheet gives no row.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlake.sources.files import header_key

ROWS = "source string, sheet string, row_no bigint, cells map<string,string>, error string"
SHEET_ROWS = 1_048_576

# Fixed values of the file format: namespaces, and the built-in number formats that are dates.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for f in root.iter(MAIN + "numFmt"):
        shown = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
        if re.search("[dmyhs]", shown, re.I):
            dates.add(int(f.get("numFmtId")))
    styles = root.find(MAIN + "cellXfs")
    return {i for i, x in enumerate([] if styles is None else styles) if int(x.get("numFmtId", 0)) in dates}


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == MAIN + "si":
                out.append(_plain(e))
                e.clear()
    return out


def _plain(e) -> str:
    """Text of a string item: its runs without the phonetic hints."""
    runs = [e.find(MAIN + "t"), *[r.find(MAIN + "t") for r in e.findall(MAIN + "r")]]
    return "".join(t.text or "" for t in runs if t is not None)


def _date_text(serial: str, from_1904: bool) -> str | None:
    """A day number as text; the 1900 calendar has a 29th of February that never was."""
    days = float(serial)
    if not from_1904 and days < 60:
        days += 1
    try:
        at = (datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)) + timedelta(days=days)
        at += timedelta(microseconds=500)  # day numbers are doubles: whole milliseconds
    except OverflowError:
        return None
    return (at.replace(microsecond=at.microsecond // 1000 * 1000)).isoformat(" ", "auto")


def _column_no(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _cell(c, strings, dates, from_1904) -> str | None:
    kind, value = c.get("t", "n"), c.find(MAIN + "v")
    if kind == "inlineStr":
        item = c.find(MAIN + "is")
        return None if item is None else _plain(item) or None
    if value is None or not value.text or kind == "e":
        return None
    if kind == "s":
        return strings[int(value.text)] or None
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind == "n" and int(c.get("s", 0)) in dates:
        return _date_text(value.text, from_1904)
    return value.text


def sheet_rows(content: bytes):
    """``(sheet, row number, {column number: text})`` of every row that has a cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target") for r in links.iter(PACKAGE_REL + "Relationship")}
        props = workbook.find(MAIN + "workbookPr")
        from_1904 = props is not None and props.get("date1904") in ("1", "true")
        strings, dates = _shared_strings(book), _date_styles(book)
        for sheet in workbook.iter(MAIN + "sheet"):
            path = target[sheet.get(REL + "id")]
            path = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
            with book.open(path) as f:
                number = 0
                for event, e in ElementTree.iterparse(f, ("start", "end")):
                    if event == "start":
                        if e.tag == MAIN + "sheetData":
                            data = e
                        continue
                    if e.tag != MAIN + "row":
                        continue
                    number = int(e.get("r", number + 1))
                    cells, at = {}, -1
                    for c in e.iter(MAIN + "c"):
                        at = _column_no(c.get("r")) if c.get("r") else at + 1
                        text = _cell(c, strings, dates, from_1904)
                        if text is not None:
                            cells[at] = text
                    data.clear()
                    if cells:
                        yield sheet.get("name"), number, cells


def _named_rows(content: bytes):
    """``(sheet, row number, cells by header key)``; row 0 maps each key to its header."""
    sheet, header = None, {}
    for name, number, cells in sheet_rows(content):
        if name != sheet:
            sheet, header, seen = name, {}, set()
            for at, text in sorted(cells.items()):
                key = header_key(text)
                if key not in seen:
                    seen.add(key)
                    header[at] = key
            yield sheet, 0, [(header[at], cells[at]) for at in header]
        else:
            yield sheet, number, [(key, cells.get(at)) for at, key in header.items()]


def read_workbooks(files: DataFrame, rows_per_batch: int = 5_000) -> DataFrame:
    """The rows (``ROWS``) of all sheets of ``files(path, content)``; ``source`` is the
    file's name.  Row 0 of a sheet is its header as spelt in the file."""

    def run(batches):
        schema = pa.schema([("source", pa.string()), ("sheet", pa.string()), ("row_no", pa.int64()),
                            ("cells", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                source = path.as_py().rsplit("/", 1)[-1]
                held = []
                try:
                    for sheet, number, cells in _named_rows(content.as_py()):
                        held.append((source, sheet, number, cells, None))
                        if len(held) == rows_per_batch:
                            yield _batch(held, schema)
                            held = []
                except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, LookupError, RuntimeError, TypeError,
                        ValueError) as e:
                    held.append((source, None, None, None, f"{type(e).__name__}: {e}"))
                if held:
                    yield _batch(held, schema)

    return files.select("path", "content").mapInArrow(run, ROWS)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def scan_workbooks(spark: SparkSession, pattern: str) -> DataFrame:
    """SRC1: every workbook that matches ``pattern``."""
    return read_workbooks(spark.read.format("binaryFile").load(pattern))


def cell(name: str) -> Column:
    """The text below a header, in any of its spellings."""
    return F.col("cells")[header_key(name)]


def workbook_columns(rows: DataFrame, expected, canonical: dict[str, str] | None = None) -> DataFrame:
    """PRJ3: ``source, sheet, row_no`` and the expected columns in order, under their
    canonical names; a header that a sheet lacks gives NULL."""
    return rows.where("row_no > 0").select(
        "source", "sheet", "row_no", *[cell(w).alias((canonical or {}).get(w, w)) for w in expected])


def workbook_drift(rows: DataFrame, expected) -> DataFrame:
    """PRJ3: ``(source, sheet, expected, found, status)`` per sheet and expected header."""
    per_sheet = F.array(*[F.struct(F.lit(w).alias("expected"), cell(w).alias("found")) for w in expected])
    status = (F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("expected"), "ok")
               .otherwise("renamed"))
    return (rows.where("row_no = 0").select("source", "sheet", F.inline(per_sheet)).withColumn("status", status))


def _text_xml(value) -> str:
    # the format cannot hold control characters
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(value)))


def _workbook_bytes(sheet: str, header: list[str], rows) -> bytes:
    """One workbook with one sheet: numbers as numbers, dates as styled day numbers,
    everything else as inline strings."""
    out = io.BytesIO()
    spread = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        def put(name, text):
            # a fixed date: equal rows give equal bytes
            book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)

        put("[Content_Types].xml", f'<Types xmlns="{spread}/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        put("_rels/.rels", f'<Relationships xmlns="{PACKAGE_REL[1:-1]}"><Relationship Id="rId1" '
            f'Type="{REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>'
            f'<sheet name="{_text_xml(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE_REL[1:-1]}">'
            f'<Relationship Id="rId1" Type="{REL[1:-1]}/worksheet" Target="worksheets/sheet1.xml"/>'
            f'<Relationship Id="rId2" Type="{REL[1:-1]}/styles" Target="styles.xml"/></Relationships>')
        put("xl/styles.xml", f'<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="1"><font/></fonts>'
            '<fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
            '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        member = zipfile.ZipInfo("xl/worksheets/sheet1.xml", (1980, 1, 1, 0, 0, 0))
        member.compress_type = zipfile.ZIP_DEFLATED
        with book.open(member, "w") as f:
            f.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            for row in [header, *rows]:
                f.write(("<row>" + "".join(_cell_xml(v) for v in row) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _cell_xml(value) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, datetime):
        days = (value - datetime(1899, 12, 30)) / timedelta(days=1)
        return f'<c s="1"><v>{days - (days < 61)!r}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_text_xml(value)}</t></is></c>'


def as_workbooks(df: DataFrame, book: Column, header: dict[str, str], order: str, sheet: str = "Sheet1") -> DataFrame:
    """``(path, content)``: a workbook per value of ``book`` (which has to bound its rows,
    ``SHEET_ROWS`` at most), rows by ``order``; ``header`` maps columns to their spelling
    in the file.  The shape is that of the ``binaryFile`` reader, so a table of workbooks
    is read back by ``read_workbooks`` as files are."""
    columns, names = list(header), list(header.values())

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows >= SHEET_ROWS:
            raise ValueError(f"{table.num_rows} rows in one sheet: the format holds {SHEET_ROWS} with the header")
        table = table.sort_by(order)
        rows = zip(*[table.column(c).to_pylist() for c in columns])
        content = _workbook_bytes(sheet, names, rows)
        return pa.table({"path": pa.array([table.column("_book")[0].as_py()], pa.string()),
                         "content": pa.array([content], pa.binary())})

    return (df.select(book.cast("string").alias("_book"), *dict.fromkeys([*columns, order]))
              .groupBy("_book").applyInArrow(run, "path string, content binary"))
