"""File sources, column resolution and sinks.

Operators: SRC1 (multi-file scan by glob, file name as source key), SRC2 /
SRC3 (CSV with / without timestamp parsing), PRJ1 (drop ``Unnamed``
columns), PRJ2 (timestamp column from an ordered candidate list), PRJ3
(header normalisation with spacing variants, missing columns as typed
NULLs plus a drift report), PRJ4 (measure lookup by substring, first or
last match), PRJ6 (parse with invalid count), PRJ7 (rename to
``timestamp``), SNK1-SNK3 (table, JSON metrics, key/value summary sinks).

Column resolution reads only ``df.columns`` (metadata); no data reaches the
driver.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Fixed values of the reference: timestamp candidates in order, the expected
# PV and wind headers of the raw workbooks, and our canonical names for them.
TIMESTAMP_CANDIDATES = ("Date-Time ", "Date-Time", "timestamp", "date", "Date", "datetime")
PV_COLUMNS = ("Date - Time", "Time", "Temperature©", "Humidity",
              "Ground Radiation Intensity (W/m^2)", "Upper Atmosphere Radiation Intensity (W/m^2)",
              "PV Generation (KW)")
WIND_COLUMNS = ("Date-Time", "Time", "Air Density", "Wind Speed", "Power Generation")
PV_CANONICAL = {"Date - Time": "ts", "Time": "time_text", "Temperature©": "temp_c",
                "Humidity": "humidity", "Ground Radiation Intensity (W/m^2)": "ghi",
                "Upper Atmosphere Radiation Intensity (W/m^2)": "upper_rad",
                "PV Generation (KW)": "pv_kw"}
WIND_CANONICAL = {"Date-Time": "ts", "Time": "time_text", "Air Density": "air_density",
                  "Wind Speed": "wind_speed", "Power Generation": "wind_kw"}


def scan_files(spark: SparkSession, pattern: str, fmt: str = "csv", schema: StructType | None = None,
               header: bool = True) -> DataFrame:
    """SRC1 / SRC3: read every file matching ``pattern`` as one DataFrame with
    a ``source`` column (the file name, from the scan's metadata column)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", header).option("mode", "PERMISSIVE")
        if schema is None:
            reader = reader.option("inferSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(pattern)
    return df.withColumn("source", F.col("_metadata.file_name"))


def drop_unnamed(df: DataFrame) -> DataFrame:
    """PRJ1."""
    return df.drop(*[c for c in df.columns if "Unnamed" in c])


def first_present(df: DataFrame, candidates) -> str | None:
    for c in candidates:
        if c in df.columns:
            return c
    return None


def any_datetime_column(df: DataFrame) -> str | None:
    """Fallback of PRJ2: the first column whose name mentions date or time."""
    for c in df.columns:
        if "date" in c.lower() or "time" in c.lower():
            return c
    return None


def parse_timestamp(df: DataFrame, col: str, out: str = "timestamp", fmt: str | None = None) -> DataFrame:
    """PRJ2 / PRJ6: parse ``col`` (bad values -> NULL) into ``out`` and drop
    the source column when it has another name."""
    raw = F.col(f"`{col}`")
    parsed = (F.try_to_timestamp(raw.cast("string"), F.lit(fmt)) if fmt
              else F.try_to_timestamp(raw.cast("string")))
    out_df = df.withColumn(out, parsed.cast("timestamp_ntz"))
    return out_df.drop(col) if col != out else out_df


def resolve_timestamp(df: DataFrame, candidates=TIMESTAMP_CANDIDATES, out: str = "timestamp") -> DataFrame:
    """PRJ2: the first candidate present (else any date/time column) becomes
    ``out``."""
    col = first_present(df, candidates) or any_datetime_column(df)
    if col is None:
        raise KeyError(f"none of {list(candidates)} and no other date or time column among {df.columns}")
    return parse_timestamp(df, col, out)


def find_column(df: DataFrame, *groups: tuple[str, ...], last: bool = True,
                exclude: tuple[str, ...] = ()) -> str | None:
    """PRJ4: a column whose lower-cased name contains every word of one of
    the ``groups`` (``('ground', 'radiation')``) and none of ``exclude``;
    the last match by default, the first with ``last=False``."""
    hit = None
    for c in df.columns:
        n = c.lower()
        if any(x in n for x in exclude):
            continue
        if any(all(w in n for w in g) for g in groups):
            if not last:
                return c
            hit = c
    return hit


def header_key(name: str) -> str:
    """What two spellings of one header have in common: lower case, without blanks,
    hyphens and underscores."""
    return re.sub(r"[\s_-]+", "", name).lower()


def normalize_headers(df: DataFrame, expected, canonical: dict[str, str] | None = None,
                      source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """PRJ3: match headers by ``header_key``, keep the expected columns in order, turn
    a missing one into a typed NULL, rename to the canonical names.

    Returns ``(table, drift)``; ``drift`` lists (source, expected, found,
    status) per expected column, so missing columns are reported, not
    silently dropped."""
    by_key: dict[str, str] = {}
    for c in df.columns:
        by_key.setdefault(header_key(c), c)
    cols, report = [], []
    for want in expected:
        found = by_key.get(header_key(want))
        value = F.lit(None).cast("string") if found is None else F.col(f"`{found}`")
        cols.append(value.alias((canonical or {}).get(want, want)))
        status = "missing" if found is None else "ok" if found == want else "renamed"
        report.append((source, want, found, status))
    drift = df.sparkSession.createDataFrame(report, "source string, expected string, found string, status string")
    return df.select(*cols), drift


def cast_measures(df: DataFrame, cols) -> DataFrame:
    """PRJ5 for every listed column present."""
    return df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


def union_files(frames: list[DataFrame]) -> DataFrame | None:
    """SET1: outer union by name (missing columns NULL); one frame passes
    unchanged; none gives None."""
    if not frames:
        return None
    if len(frames) == 1:
        return frames[0]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- sinks -----------------------------------------------------------------

def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=("site_id",),
                mode: str = "overwrite") -> None:
    """SNK1: partitioned table (Parquet by default; ``fmt='csv'`` writes a
    header).  Partitioning by site keeps later per-site reads pruned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*[p for p in partition_by if p in df.columns])
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_metrics_json(df: DataFrame, path: str) -> None:
    """SNK2: one JSON object per row (the metrics dict)."""
    df.write.mode("overwrite").json(path)


def key_value_rows(df: DataFrame, key=("site_id",)) -> DataFrame:
    """SNK3: every non-key column as a (key, name, value-as-text) row."""
    vals = [c for c in df.columns if c not in key]
    return (df.select(*key, *[F.col(c).cast("string").alias(c) for c in vals])
              .unpivot(list(key), vals, "name", "value"))


def write_summary(df: DataFrame, path: str, key=("site_id",)) -> None:
    key_value_rows(df, key).write.mode("overwrite").option("header", True).csv(path)
