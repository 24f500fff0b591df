"""Registered queries: file round trip, head sample and streams
(SRC1-SRC3, SNK1, PRJ1-PRJ3, PRJ5-PRJ7, SET1, SRT1, SRT3, STR1-STR4).

Inputs are the driver's tables: the raw-format files are written from the
``solar`` table, the streams read ``events`` itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.config import scratch_path
from gridlake.functions import exprs as X
from gridlake.operators import validate as V
from gridlake.plans.merge_queries import merged_table
from gridlake.plans.registry import register
from gridlake.sources import files as FS
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX
from gridlake.streaming import streams as SS

# Raw workbook spellings written for the round trip: first half of the month
# uses the PV header list with a trailing blank on Humidity; the second half
# uses 'Date-Time' and has no Humidity column at all (header drift).
SPLIT_TS = "2024-01-16 00:00:00"


def _raw_groups(solar):
    fmt = "yyyy-MM-dd HH:mm:ss"
    first = solar.where(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz")).select(
        F.lit(0).alias("Unnamed: 0"), "site_id", "row_id",
        F.date_format("ts", fmt).alias("Date - Time"),
        F.date_format("ts", "HH:mm").alias("Time"),
        F.col("temp_c").alias("Temperature©"), F.col("humidity").alias("Humidity "),
        F.col("ghi").alias("Ground Radiation Intensity (W/m^2)"),
        F.col("upper_rad").alias("Upper Atmosphere Radiation Intensity (W/m^2)"),
        F.col("pv_kw").alias("PV Generation (KW)"))
    second = solar.where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz")).select(
        F.lit(0).alias("Unnamed: 0"), "site_id", "row_id",
        F.date_format("ts", fmt).alias("Date-Time"),
        F.date_format("ts", "HH:mm").alias("Time"),
        F.col("temp_c").alias("Temperature©"),
        F.col("ghi").alias("Ground Radiation Intensity (W/m^2)"),
        F.col("upper_rad").alias("Upper Atmosphere Radiation Intensity (W/m^2)"),
        F.col("pv_kw").alias("PV Generation (KW)"))
    return first, second


@register("raw_file_roundtrip", sql=S.with_ctes(S.SOLAR) + f"""
SELECT site_id, row_id, ts, temp_c,
       CASE WHEN ts >= TIMESTAMP '{SPLIT_TS}' THEN CAST(NULL AS DOUBLE) ELSE humidity END AS humidity,
       ghi, upper_rad, pv_kw
FROM solar""", doubles=["temp_c", "humidity", "ghi", "upper_rad", "pv_kw"],
          operators=("SNK1", "SRC1", "SRC2", "SRC3", "PRJ1", "PRJ2", "PRJ3", "PRJ5", "PRJ6",
                     "PRJ7", "SET1"))
def raw_file_roundtrip(spark, sf_dir):
    solar = FX.solar(spark, sf_dir)
    first, second = _raw_groups(solar)
    base = scratch_path(spark, "raw")
    FS.write_table(first, f"{base}/a", fmt="csv")
    FS.write_table(second, f"{base}/b", fmt="csv")
    frames = []
    for part in ("a", "b"):
        raw = FS.drop_unnamed(FS.scan_files(spark, f"{base}/{part}", "csv"))
        ids = [F.col("site_id").cast("int").alias("site_id"), F.col("row_id").cast("bigint").alias("row_id")]
        named, _drift = FS.normalize_headers(raw.select(*ids, *[F.col(f"`{c}`") for c in raw.columns
                                                              if c not in ("site_id", "row_id")]),
                                             ("site_id", "row_id") + FS.PV_COLUMNS,
                                             FS.PV_CANONICAL)
        named = FS.parse_timestamp(named, "ts", "timestamp").drop("time_text")
        named = FS.cast_measures(named, ["temp_c", "humidity", "ghi", "upper_rad", "pv_kw"])
        frames.append(named.withColumnRenamed("timestamp", "ts"))
    out = FS.union_files(frames)
    return out.select("site_id", "row_id", "ts", "temp_c", "humidity", "ghi", "upper_rad", "pv_kw")


@register("head_sample", sql=S.with_ctes(S.SOLAR, S.WIND, S.SOLAR_DEDUP, S.WIND_DEDUP, S.MERGED)
          + "SELECT ts, site_id, pv_kw, wind_kw FROM merged ORDER BY ts, site_id LIMIT 3",
          doubles=["pv_kw", "wind_kw"], operators=("SRT1", "SRT3"))
def head_sample(spark, sf_dir):
    """The first three merged rows in time order (the limit is the feature)."""
    return merged_table(spark, sf_dir).select("ts", "site_id", "pv_kw", "wind_kw").orderBy(
        "ts", "site_id").limit(3)


def _event_stream(spark, sf_dir):
    """``events`` as a file stream, whether the table is one file or a folder."""
    return (spark.readStream.schema(FX.table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1)
            .parquet(SS.stream_path(f"{sf_dir.rstrip('/')}/events.parquet")))


def _solar_stream(spark, sf_dir):
    """The ``solar`` derivation applied to a stream of ``events`` rows."""
    return _solar_events(_event_stream(spark, sf_dir))


def _solar_events(ev):
    k = F.regexp_extract(F.col("props"), r"([0-9]+)", 1).cast("double")
    power = (F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
              .when(F.col("event_type") == "signup", -F.col("value")).otherwise(F.col("value")))
    return ev.select(
        F.col("event_id").alias("row_id"), (F.col("user_id") % FX.N_SITES).cast("int").alias("site_id"),
        X.to_event_time(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")).alias("ts"),
        (k / F.lit(2.5)).alias("temp_c"), (F.lit(100.0) - k).alias("humidity"),
        (k * F.lit(10.0)).alias("ghi"),
        F.when(F.col("event_id") % 10 == 0, F.lit(0.0)).otherwise(k * F.lit(10.0) + F.lit(200.0))
         .alias("upper_rad"), power.alias("pv_kw"))


@register("stream_dedup", sql=S.with_ctes(S.SOLAR, S.SOLAR_DEDUP)
          + "SELECT site_id, ts, row_id, ghi, pv_kw FROM solar_d", doubles=["ghi", "pv_kw"], operators=("STR1", "WIN8"))
def stream_dedup(spark, sf_dir):
    """The kept rows equal the batch de-duplication in any order of arrival; the state
    holds the keys of two hours and of one trigger."""
    out, _ = SS.sealed_first_rows(_solar_stream(spark, sf_dir), _solar_events(FX.table(spark, sf_dir, "events")))
    return out.select("site_id", X.from_event_time("ts").alias("ts"), "row_id", "ghi", "pv_kw")


@register("stream_rules", sql=S.with_ctes(S.SOLAR) + """
SELECT row_id, site_id, list_filter([
    CASE WHEN NOT coalesce(ghi >= 0, false) THEN 'ghi_negative' END,
    CASE WHEN NOT coalesce(upper_rad >= 0, false) THEN 'upper_negative' END,
    CASE WHEN coalesce(ghi = 0 AND pv_kw > 0, false) THEN 'night_generation' END,
    CASE WHEN coalesce(CASE WHEN ghi > 0 THEN pv_kw / ghi ELSE CAST(0 AS DOUBLE) END > 1, false)
         THEN 'efficiency_above_1' END], lambda x: x IS NOT NULL) AS broken_rules
FROM solar WHERE len(list_filter([
    CASE WHEN NOT coalesce(ghi >= 0, false) THEN 'a' END,
    CASE WHEN NOT coalesce(upper_rad >= 0, false) THEN 'b' END,
    CASE WHEN coalesce(ghi = 0 AND pv_kw > 0, false) THEN 'c' END,
    CASE WHEN coalesce(CASE WHEN ghi > 0 THEN pv_kw / ghi ELSE CAST(0 AS DOUBLE) END > 1, false)
         THEN 'd' END], lambda x: x IS NOT NULL)) > 0""", operators=("STR2", "FLT5"))
def stream_rules(spark, sf_dir):
    out = SS.run_available_now(SS.rule_stream(_solar_stream(spark, sf_dir), V.solar_rules()), "rules")
    return out.select("row_id", "site_id", "broken_rules")


@register("stream_totals", sql=S.with_ctes(S.SOLAR) + """
SELECT site_id, ts AS window_start, ts + INTERVAL 1 HOUR AS window_end, count(*) AS n,
       sum(ghi) AS ghi_sum, avg(ghi) AS ghi_mean, sum(pv_kw) AS pv_kw_sum, avg(pv_kw) AS pv_kw_mean
FROM solar GROUP BY site_id, ts""", doubles=["ghi_sum", "ghi_mean", "pv_kw_sum", "pv_kw_mean"],
          operators=("STR3",))
def stream_totals(spark, sf_dir):
    """Windows are sealed two hours after their end, late rows corrected."""
    out, _ = SS.sealed_totals(_solar_stream(spark, sf_dir), _solar_events(FX.table(spark, sf_dir, "events")), ["ghi", "pv_kw"])
    return out.select("site_id", "window_start", "window_end", "n",
                      "ghi_sum", "ghi_mean", "pv_kw_sum", "pv_kw_mean")


def _telemetry_stream(spark, sf_dir):
    ev = _event_stream(spark, sf_dir)
    k = F.regexp_extract(F.col("props"), r"([0-9]+)", 1).cast("double")
    return ev.select(
        F.col("event_id").alias("row_id"), (F.col("user_id") % FX.N_SITES).cast("int").alias("site_id"),
        X.to_event_time(F.col("ts").cast("timestamp_ntz")).alias("ts"), (F.lit(49.4) + k / F.lit(80.0)).alias("frequency"),
        (F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))).alias("p_battery"))


STATE_SQL = "WITH RECURSIVE " + ",\n".join([S.TELEMETRY, """tr AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY ts, row_id) - 1 AS BIGINT) AS rn,
         lag(frequency, 1) OVER (PARTITION BY site_id ORDER BY ts, row_id) AS frequency_lag_1
  FROM telemetry)""", """sb AS (
  SELECT *, CASE WHEN p_battery > 0
                 THEN -(least(p_battery, CAST(7000 AS DOUBLE)) * (CAST(1 AS DOUBLE) / CAST(30 AS DOUBLE))
                        / CAST(0.95 AS DOUBLE))
                 ELSE least(-p_battery, CAST(7000 AS DOUBLE)) * (CAST(1 AS DOUBLE) / CAST(30 AS DOUBLE))
                      * CAST(0.95 AS DOUBLE) END AS a
  FROM tr)""", """rec AS (
  SELECT site_id, rn, least(greatest(CAST(5000 AS DOUBLE) + a, CAST(1000 AS DOUBLE)), CAST(9000 AS DOUBLE)) AS e
  FROM sb WHERE rn = 0
  UNION ALL
  SELECT b.site_id, b.rn, least(greatest(rec.e + b.a, CAST(1000 AS DOUBLE)), CAST(9000 AS DOUBLE))
  FROM rec JOIN sb b ON b.site_id = rec.site_id AND b.rn = rec.rn + 1)"""]) + """
SELECT sb.row_id, sb.site_id, sb.frequency_lag_1, sb.frequency - sb.frequency_lag_1 AS frequency_ramp,
       rec.e AS energy_kwh
FROM sb JOIN rec ON sb.site_id = rec.site_id AND sb.rn = rec.rn"""


@register("stream_state", sql=STATE_SQL, doubles=["frequency_lag_1", "frequency_ramp", "energy_kwh"],
          operators=("STR4", "ST2", "WIN1", "WIN3"))
def stream_state(spark, sf_dir):
    """Rows wait in RocksDB until the watermark has passed their hour; sites with later
    rows are worked out again."""
    out, _ = SS.sealed_series(_telemetry_stream(spark, sf_dir), "frequency", "p_battery")
    return out.select("row_id", "site_id", "frequency_lag_1", "frequency_ramp", "energy_kwh")

