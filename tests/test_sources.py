"""Workbooks, rejected records and repeatable partition writes on hand-made files."""

import zipfile
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gridlake.sources import partitions as P
from gridlake.sources import rejects as R
from gridlake.sources import workbooks as W

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _book(path, sheets, strings="", date1904=False):
    """A workbook as spreadsheet programs write it: shared strings and styled dates."""
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><workbookPr date1904="{int(date1904)}"/>'
                   f'<sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/>'
                   '<numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>'
                   '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for i, xml in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{xml}</sheetData></worksheet>")


def test_workbook_cells(spark, tmp_path):
    _book(tmp_path / "a.xlsx", {
        "PV": '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="s"><v>2</v></c><c r="E2" t="s"><v>0</v></c></row>'
              '<row r="4"><c r="A4" s="1"><v>45292.5</v></c><c r="B4"><v>1.5</v></c><c r="C4"><v>9</v></c><c r="D4" t="b"><v>1</v></c><c r="E4"><v>7</v></c></row>'
              '<row r="5"><c r="A5" s="2"><v>59</v></c><c r="B5" t="e"><v>#DIV/0!</v></c><c r="D5" t="inlineStr"><is><t>x &amp; y</t></is></c></row>'
              '<row r="6"><c r="A6"/></row>'
              '<row r="7"><c r="B7" s="3"><v>3</v></c><c r="D7" t="str"><f>A1</f><v>made</v></c></row>',
        "empty": ""},
        "<si><t>Date - Time</t></si><si><r><t>Humi</t></r><r><t>dity </t></r><rPh><t>no</t></rPh></si><si><t>Flag</t></si>")
    _book(tmp_path / "b.xlsx", {"one": '<row><c t="inlineStr"><is><t>Date-Time</t></is></c></row><row><c s="1"><v>0</v></c></row>'},
          date1904=True)
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    rows = W.scan_workbooks(spark, f"{tmp_path}/*.xlsx").cache()
    got = {(r.source, r.row_no): (r.ts, r.humidity, r.flag)
           for r in W.workbook_columns(rows, ["Date-Time", "Humidity", "Flag"],
                                       {"Date-Time": "ts", "Humidity": "humidity", "Flag": "flag"}).collect()}
    assert got == {("a.xlsx", 4): ("2024-01-01 12:00:00", "1.5", "true"),
                   ("a.xlsx", 5): ("1900-02-28 00:00:00", None, "x & y"),
                   ("a.xlsx", 7): (None, "3", "made"),
                   ("b.xlsx", 2): ("1904-01-01 00:00:00", None, None)}
    drift = {(r.source, r.expected): (r.found, r.status)
             for r in W.workbook_drift(rows, ["Date-Time", "Humidity"]).collect()}
    assert drift == {("a.xlsx", "Date-Time"): ("Date - Time", "renamed"), ("a.xlsx", "Humidity"): ("Humidity ", "renamed"),
                     ("b.xlsx", "Date-Time"): ("Date-Time", "ok"), ("b.xlsx", "Humidity"): (None, "missing")}
    bad = rows.where("error is not null").collect()
    assert [r.source for r in bad] == ["broken.xlsx"] and "BadZipFile" in bad[0].error


def test_workbook_written_and_read(spark):
    values = [(1, "a", datetime(2024, 1, 1, 23, 59, 59, 999000), 0.1, True, "<&>\"' \n\x01é"),
              (2, "b", None, None, None, None), (3, "a", datetime(1900, 1, 5), -1e-9, False, "  x  ")]
    df = spark.createDataFrame(values, "id bigint, book string, at timestamp_ntz, x double, flag boolean, note string")
    files = W.as_workbooks(df, F.col("book"), {"id": "Id", "at": "At", "x": "X", "flag": "Flag", "note": "Note"}, "id")
    rows = W.workbook_columns(W.read_workbooks(files), ["Id", "At", "X", "Flag", "Note"])
    got = sorted(tuple(r)[3:] for r in rows.collect())
    assert got == [("1", "2024-01-01 23:59:59.999000", "0.1", "true", "<&>\"' \né"), ("2", None, None, None, None),
                   ("3", "1900-01-05 00:00:00", "-1e-09", "false", "  x  ")]
    assert W.read_workbooks(files.limit(0)).count() == 0


def test_rejected_records(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id,x\n1,2.5\n2,\n3,abc\n4\n5,1,9\n\"6\",\"7\"\n")
    schema = StructType([StructField("id", LongType()), StructField("x", DoubleType())])
    rows, rejected = R.scan_with_rejects(spark, str(tmp_path), schema)
    assert {r.id: r.x for r in rows.collect()} == {1: 2.5, 2: None, 3: None, 6: 7.0} and rows.count() == 4
    assert sorted((r.reason, r.columns, r.record) for r in rejected.collect()) == [
        ("bad_value", ["x"], "3,abc"), ("field_count", None, "4"), ("field_count", None, "5,1,9")]
    assert {r.source for r in rows.collect()} == {"f.csv"}


def test_partition_writes_repeat_and_recover(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 2.0), (None, 3.0)], "site_id int, x double")

    def held():
        return sorted(((r.site_id or 0), r.x, r.run_id) for r in P.read_committed(spark, path).collect())

    P.write_partitions(df, path, "a")
    first = held()
    assert first == [(0, 3.0, "a"), (1, 1.0, "a"), (1, 1.0, "a"), (2, 2.0, "a")]
    P.write_partitions(df, path, "a")
    assert held() == first
    P.write_partitions(df.where("site_id = 2").withColumn("x", F.col("x") * 10), path, "b")
    assert held() == [*first[:3], (2, 20.0, "b")]
    # a run that ends between data and manifest
    (df.where("site_id = 1").withColumn("run_id", F.lit("c")).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("site_id").parquet(path))
    assert [(r.site_id, r.run_id, r.n_rows) for r in P.uncommitted(spark, path).collect()] == [(1, "c", 2)]
    assert held() == [(0, 3.0, "a"), (2, 20.0, "b")]
    P.write_partitions(df.where("site_id = 1"), path, "c")
    assert held() == [(0, 3.0, "a"), (1, 1.0, "c"), (1, 1.0, "c"), (2, 20.0, "b")]
    assert P.uncommitted(spark, path).count() == 0
    P.write_partitions(df.limit(0), path, "d")
    assert P.uncommitted(spark, path).count() == 0
