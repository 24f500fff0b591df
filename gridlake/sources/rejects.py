"""CSV with every rejected record accounted for (SRC2, PRJ5, PRJ6).

A plain scan in PERMISSIVE mode turns what it cannot parse into NULLs without a trace.
``scan_with_rejects`` reads against an explicit schema and keeps both sides: all records
that have the right number of fields, with bad values as NULL (what a coercing parser
gives), and a quarantine table that names each rejected record, its file, its text and the
reason.

Defined results: a record with too few or too many fields is rejected whole; a non-empty
field that its type cannot parse is NULL in the table and named in the quarantine, and its
record stays; empty fields are NULL and no fault; a header line is skipped per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridlake.plans.materialize import materialize

RECORD = "_record"


def _value(name: str, kind: str, timestamp_format: str | None) -> Column:
    raw = F.col(f"`{name}`")
    if timestamp_format and kind.startswith("timestamp"):
        return F.try_to_timestamp(raw, F.lit(timestamp_format)).cast(kind)
    return raw.try_cast(kind)


def scan_with_rejects(spark: SparkSession, pattern: str, schema: StructType, header: bool = True,
                      timestamp_format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejected)``: the typed columns of ``schema`` with ``source``, and
    ``(source, reason, columns, record)`` with reason ``field_count`` or ``bad_value``.

    The files are read once: fields arrive as text, their types are tried on the way, and
    the outcome is written below the checkpoint folder, where both tables read it."""
    text = StructType([StructField(f.name, StringType()) for f in schema] + [StructField(RECORD, StringType())])
    raw = (spark.read.schema(text).option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", True)
                .option("columnNameOfCorruptRecord", RECORD).csv(pattern)
                .withColumn("source", F.col("_metadata.file_name")))
    typed = [_value(f.name, f.dataType.simpleString(), timestamp_format).alias(f.name) for f in schema]
    faults = F.array_compact(F.array(*[
        F.when(F.col(f"`{f.name}`").isNotNull() & _value(f.name, f.dataType.simpleString(), timestamp_format).isNull(),
               F.lit(f.name)) for f in schema]))
    own = F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema]))
    judged = raw.select(
        "source", *typed,
        F.when(F.col(RECORD).isNotNull(), "field_count").when(F.size(faults) > 0, "bad_value").alias("_reason"),
        F.when(F.col(RECORD).isNull(), faults).alias("_columns"),
        F.when(F.col(RECORD).isNotNull(), F.col(RECORD)).when(F.size(faults) > 0, own).alias(RECORD))
    kept = materialize(judged, "csv-judged")
    names = [f"`{f.name}`" for f in schema]
    rows = kept.where("_reason is null or _reason = 'bad_value'").select("source", *names)
    rejected = kept.where("_reason is not null").select(
        "source", F.col("_reason").alias("reason"), F.col("_columns").alias("columns"), F.col(RECORD).alias("record"))
    return rows, rejected
