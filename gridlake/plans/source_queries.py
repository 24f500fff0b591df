"""Registered queries: workbooks, rejected records and repeatable partition writes
(SRC1, SRC2, PRJ3, PRJ5, PRJ6, SNK1).

All of ``events`` goes out in the foreign format and comes back.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampNTZType

from gridlake.config import scratch_path
from gridlake.plans.materialize import materialize
from gridlake.plans.registry import register
from gridlake.sources import files as FS
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX
from gridlake.sources import partitions as P
from gridlake.sources import rejects as R
from gridlake.sources import workbooks as W

#: Rows of a workbook: bounds the task that writes or reads it, whatever a site's size.
BOOK_ROWS = 5_000

# Every third workbook has other spellings and no humidity (header drift).
BOOK_HEADER = {"row_id": "Row ID", "site_id": "Site-ID", "ts": "Date - Time", "temp_c": "Temperature©",
               "humidity": "Humidity", "ghi": "Ground Radiation Intensity (W/m^2)", "pv_kw": "PV Generation (KW)"}
DRIFTED_HEADER = {"pv_kw": "pv generation(KW)", "row_id": "row_id", "site_id": "Site ID", "ts": "Date-Time",
                  "temp_c": "Temperature©", "ghi": "Ground Radiation  Intensity (W/m^2)"}
DRIFT = f"(row_id div {BOOK_ROWS}) % 3 = 2"
DRIFT_SQL = f"(row_id // {BOOK_ROWS}) % 3 = 2"


@register("workbook_roundtrip", sql=S.with_ctes(S.SOLAR) + f"""
SELECT row_id, site_id, ts, temp_c, CASE WHEN {DRIFT_SQL} THEN CAST(NULL AS DOUBLE) ELSE humidity END AS humidity,
       ghi, pv_kw, 'book-' || CAST(row_id // {BOOK_ROWS} AS VARCHAR) || '.xlsx' AS source
FROM solar""", doubles=["temp_c", "humidity", "ghi", "pv_kw"], operators=("SRC1", "PRJ2", "PRJ3", "PRJ5", "SET1"))
def workbook_roundtrip(spark, sf_dir):
    solar = FX.solar(spark, sf_dir)
    book = F.concat(F.lit("book-"), F.expr(f"row_id div {BOOK_ROWS}"), F.lit(".xlsx"))
    books = (W.as_workbooks(solar.where(f"not ({DRIFT})"), book, BOOK_HEADER, "row_id")
              .union(W.as_workbooks(solar.where(DRIFT), book, DRIFTED_HEADER, "row_id")))
    rows = W.read_workbooks(materialize(books, "books"))
    out = W.workbook_columns(rows, list(BOOK_HEADER.values()), {v: k for k, v in BOOK_HEADER.items()})
    out = FS.cast_measures(out, ["temp_c", "humidity", "ghi", "pv_kw"])
    return out.select(F.col("row_id").try_cast("bigint").alias("row_id"), F.col("site_id").try_cast("int").alias("site_id"),
                      F.col("ts").try_cast("timestamp_ntz").alias("ts"), "temp_c", "humidity", "ghi", "pv_kw", "source")


# One fault per kind: a line cut short, a value that is no number, a time that is none.
SHORT, NO_NUMBER, NO_TIME = "row_id % 97 = 5", "row_id % 89 = 7", "row_id % 83 = 11"


@register("rejected_records", sql=S.with_ctes(S.SOLAR) + f"""
SELECT 'row' AS kind, row_id, site_id, CASE WHEN {NO_TIME} THEN CAST(NULL AS TIMESTAMP) ELSE ts END AS ts,
       ghi, CASE WHEN {NO_NUMBER} THEN CAST(NULL AS DOUBLE) ELSE pv_kw END AS pv_kw, CAST(NULL AS VARCHAR) AS columns
FROM solar WHERE NOT ({SHORT})
UNION ALL
SELECT 'field_count', row_id, CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), NULL
FROM solar WHERE {SHORT}
UNION ALL
SELECT 'bad_value', row_id, CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
       concat_ws(',', CASE WHEN {NO_TIME} THEN 'ts' END, CASE WHEN {NO_NUMBER} THEN 'pv_kw' END)
FROM solar WHERE NOT ({SHORT}) AND ({NO_TIME} OR {NO_NUMBER})""", doubles=["ghi", "pv_kw"],
          operators=("SRC2", "PRJ5", "PRJ6"))
def rejected_records(spark, sf_dir):
    """Every line of a file with faults comes back as a row, as a reject, or as both."""
    solar = FX.solar(spark, sf_dir)
    path = scratch_path(spark, "faulty")
    fields = [F.col("row_id").cast("string"), F.col("site_id").cast("string"),
              F.when(F.expr(NO_TIME), "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
              F.col("ghi").cast("string"),
              F.when(F.expr(NO_NUMBER), "n/a").otherwise(F.coalesce(F.col("pv_kw").cast("string"), F.lit("")))]
    line = F.when(F.expr(SHORT), F.concat_ws(",", *fields[:2])).otherwise(F.concat_ws(",", *fields))
    solar.select(line.alias("value")).write.text(path)
    schema = StructType([StructField("row_id", LongType()), StructField("site_id", LongType()),
                         StructField("ts", TimestampNTZType()), StructField("ghi", DoubleType()),
                         StructField("pv_kw", DoubleType())])
    rows, rejected = R.scan_with_rejects(spark, path, schema, header=False, timestamp_format="yyyy-MM-dd HH:mm:ss")
    bad = rejected.select(
        F.col("reason").alias("kind"), F.split("record", ",")[0].cast("bigint").alias("row_id"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("site_id", "bigint"), ("ts", "timestamp_ntz"), ("ghi", "double"),
                                                     ("pv_kw", "double"))],
        F.when(F.col("reason") == "bad_value", F.array_join("columns", ",")).alias("columns"))
    return rows.select(F.lit("row").alias("kind"), "row_id", "site_id", "ts", "ghi", "pv_kw",
                       F.lit(None).cast("string").alias("columns")).unionByName(bad)


@register("partition_reruns", sql=S.with_ctes(S.SOLAR) + """
SELECT site_id, row_id, ts, CASE WHEN site_id IN (1, 2) THEN ghi * 2 ELSE ghi END AS ghi,
       CASE WHEN site_id IN (1, 2) THEN 'second' WHEN site_id = 0 THEN 'first' ELSE 'third' END AS run_id
FROM solar""", doubles=["ghi"], operators=("SNK1",))
def partition_reruns(spark, sf_dir):
    """Runs over sites 0-2, 1-2 (corrected) and all others; the second one runs twice."""
    solar = FX.solar(spark, sf_dir).select("site_id", "row_id", "ts", "ghi")
    path = scratch_path(spark, "reruns")
    fixed = solar.where("site_id in (1, 2)").withColumn("ghi", F.col("ghi") * 2)
    P.write_partitions(solar.where("site_id < 3"), path, "first")
    for _ in range(2):
        P.write_partitions(fixed, path, "second")
    P.write_partitions(solar.where("site_id > 2"), path, "third")
    return P.read_committed(spark, path).select("site_id", "row_id", "ts", "ghi", "run_id")
