"""Registered queries for small inventory operators: header and column lookup, drift and
parse reports, sinks read back, keyed sums, text modes, infinite values and feature
selection (SRC1, SNK2, SNK3, PRJ2-PRJ4, PRJ6, PRJ10, JN5, AGG8, AGG10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.config import scratch_path
from gridlake.operators import features as FE
from gridlake.operators import merge as M
from gridlake.operators import prep as PR
from gridlake.operators import profile as P
from gridlake.operators import validate as V
from gridlake.plans.registry import register
from gridlake.sources import files as FS
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX

FORMAT = "yyyy-MM-dd HH:mm:ss"


@register("column_lookup", sql=S.with_ctes(S.SOLAR) + "SELECT site_id, row_id, ts AS timestamp, ghi, pv_kw FROM solar",
          doubles=["ghi", "pv_kw"], operators=("PRJ2", "PRJ4"))
def column_lookup(spark, sf_dir):
    """Timestamp by the candidate chain, measures by words of their raw headers."""
    raw = FX.solar(spark, sf_dir).select(
        "site_id", "row_id", F.date_format("ts", FORMAT).alias("Date-Time "),
        F.col("ghi").alias("Ground Radiation Intensity (W/m^2)"), F.col("upper_rad").alias("Upper Atmosphere Radiation Intensity (W/m^2)"),
        F.col("pv_kw").alias("PV Generation (KW)"))
    named = FS.resolve_timestamp(raw)
    ghi, pv = FS.find_column(named, ("ground", "radiation")), FS.find_column(named, ("pv", "generation"))
    return named.select("site_id", "row_id", "timestamp", F.col(f"`{ghi}`").alias("ghi"), F.col(f"`{pv}`").alias("pv_kw"))


@register("parse_report", sql=S.with_ctes(S.SOLAR) + """
SELECT site_id, count_if(row_id % 7 = 0) AS n_invalid, count_if(row_id % 7 = 0 OR row_id % 11 = 0) AS n_missing
FROM solar GROUP BY site_id""", operators=("PRJ6", "PRJ2"))
def parse_report(spark, sf_dir):
    """Unparsable and missing timestamps of a text column."""
    text = (F.when(F.col("row_id") % 7 == 0, "not a time").when(F.col("row_id") % 11 == 0, F.lit(None))
             .otherwise(F.date_format("ts", FORMAT)))
    raw = FX.solar(spark, sf_dir).select("site_id", text.alias("raw"), text.alias("when"))
    return V.parse_report(FS.parse_timestamp(raw, "when", "parsed"), "raw", "parsed")


@register("file_sources", sql=S.with_ctes(S.SOLAR) + """, p AS (
  SELECT 'pv' AS file_group, count(*) AS n_rows FROM solar UNION ALL SELECT 'wind', count(*) FROM events),
d(file_group, expected, status) AS (VALUES ('pv', 'Date - Time', 'renamed'), ('pv', 'Time', 'missing'),
  ('pv', 'Humidity', 'renamed'), ('wind', 'Date-Time', 'ok'), ('wind', 'Time', 'missing'), ('wind', 'Wind Speed', 'renamed'))
SELECT file_group, expected, status, n_rows FROM d JOIN p USING (file_group)""", operators=("SRC1", "PRJ3"))
def file_sources(spark, sf_dir):
    """Two folders of files: rows that carry a source, and the drift of each header."""
    out = None
    tables = (("pv", FX.solar(spark, sf_dir).select(F.date_format("ts", FORMAT).alias("date_time "), F.col("humidity").alias("HUMIDITY")),
               ("Date - Time", "Time", "Humidity")),
              ("wind", FX.wind(spark, sf_dir).select(F.date_format("ts", FORMAT).alias("Date-Time"), F.col("wind_speed").alias("Wind-Speed")),
               ("Date-Time", "Time", "Wind Speed")))
    for group, df, expected in tables:
        path = scratch_path(spark, f"sources-{group}")
        FS.write_table(df, path, fmt="csv", partition_by=())
        files = FS.scan_files(spark, path)
        _, drift = FS.normalize_headers(files, expected, source=group)
        rows = files.where(F.col("source").endswith(".csv")).agg(F.count(F.lit(1)).alias("n_rows"))
        part = (drift.select(F.col("source").alias("file_group"), "expected", "status")
                     .join(F.broadcast(rows), F.lit(True)))  # one row
        out = part if out is None else out.unionByName(part)
    return out


SINK_SQL = S.with_ctes(S.SOLAR) + """, g AS (
  SELECT site_id, CAST(count(*) AS VARCHAR) AS n, CAST(max(row_id) AS VARCHAR) AS last_row FROM solar GROUP BY site_id)
SELECT 'json' AS sink, site_id, name, value FROM (UNPIVOT g ON n, last_row INTO NAME name VALUE value)
UNION ALL SELECT 'csv', site_id, name, value FROM (UNPIVOT g ON n, last_row INTO NAME name VALUE value)"""


@register("metrics_sinks", sql=SINK_SQL, operators=("SNK2", "SNK3"))
def metrics_sinks(spark, sf_dir):
    """Metrics as JSON objects and as key/value rows, both read back."""
    metrics = FX.solar(spark, sf_dir).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.max("row_id").alias("last_row"))
    js, kv = scratch_path(spark, "metrics-json"), scratch_path(spark, "metrics-csv")
    FS.write_metrics_json(metrics, js)
    FS.write_summary(metrics, kv)
    back = FS.key_value_rows(spark.read.schema("site_id int, n bigint, last_row bigint").json(js))
    rows = spark.read.option("header", True).schema("site_id int, name string, value string").csv(kv)
    return (back.select(F.lit("json").alias("sink"), "site_id", "name", "value")
                .unionByName(rows.select(F.lit("csv").alias("sink"), "site_id", "name", "value")))


@register("keyed_total", sql=S.with_ctes(S.SOLAR, S.WIND, S.SOLAR_DEDUP, S.WIND_DEDUP) + """
SELECT s.site_id, s.ts, s.pv_kw + w.wind_kw AS total_kw FROM solar_d s JOIN wind_d w ON s.site_id = w.site_id AND s.ts = w.ts""",
          doubles=["total_kw"], operators=("JN5",))
def keyed_total(spark, sf_dir):
    return M.keyed_sum(M.dedup_first(FX.solar(spark, sf_dir)), M.dedup_first(FX.wind(spark, sf_dir)), "pv_kw", "wind_kw", "total_kw")


@register("text_and_infinite", sql=S.with_ctes(S.SOLAR) + """, t AS (
  SELECT CAST(user_id % 5 AS INTEGER) AS site_id, event_type, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT site_id, event_type, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, event_type) AS r FROM t)
SELECT m.site_id, event_type, n_infinite FROM m JOIN (
  SELECT site_id, count_if(upper_rad = 0 AND ghi > 0) AS n_infinite FROM solar GROUP BY site_id) i ON m.site_id = i.site_id
WHERE r = 1""", operators=("AGG8", "AGG10"))
def text_and_infinite(spark, sf_dir):
    """Most frequent event type per site, and infinite radiation ratios."""
    ev = FX.table(spark, sf_dir, "events").select((F.col("user_id") % FX.N_SITES).cast("int").alias("site_id"), "event_type")
    ratio = F.when((F.col("upper_rad") == 0) & (F.col("ghi") > 0), F.lit(float("inf"))).otherwise(F.try_divide("ghi", "upper_rad"))
    infinite = PR.infinite_counts(FX.solar(spark, sf_dir).select("site_id", ratio.alias("radiation_ratio")))
    return P.text_modes(ev, ["event_type"]).join(infinite, "site_id")


FEATURE_LIST = ("ghi", "temp_c", "humidity", "hour", "wind_speed")  # fixed names; the last is not in the table


@register("feature_selection", sql=S.with_ctes(S.SOLAR, S.SOLAR_DEDUP) + """, f AS (
  SELECT site_id, ghi, temp_c, humidity, CAST(hour(ts) AS DOUBLE) AS hour,
         CASE WHEN isodow(ts) >= 6 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_weekend FROM solar_d),
g AS (SELECT site_id, avg(ghi) AS ghi, avg(temp_c) AS temp_c, avg(humidity) AS humidity, avg(hour) AS hour,
      avg(is_weekend) AS is_weekend FROM f GROUP BY site_id)
SELECT site_id, feature, mean FROM (UNPIVOT g ON ghi, temp_c, humidity, hour, is_weekend INTO NAME feature VALUE mean)""",
          doubles=["mean"], operators=("PRJ10",))
def feature_selection(spark, sf_dir):
    """Fixed list met with the columns, plus name patterns; the mean of each chosen feature."""
    table = FE.pv_features_b(M.dedup_first(FX.solar(spark, sf_dir)))
    chosen = PR.select_features(table, FEATURE_LIST, ("weekend",), ("pv_kw",))
    wide = table.groupBy("site_id").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in chosen])
    return wide.unpivot(["site_id"], chosen, "feature", "mean")
