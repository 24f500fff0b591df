"""Registered queries: validation and alignment (AGG2-7, FLT5-7, WIN7, JN3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import merge as M
from gridlake.operators import profile as P
from gridlake.operators import validate as V
from gridlake.plans.registry import register
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX

SOLAR_MEASURES = ["temp_c", "humidity", "ghi", "upper_rad", "pv_kw"]

STEP_CTE = """st AS (
  SELECT *, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY site_id ORDER BY ts, row_id))
                 AS DOUBLE) / CAST(1e6 AS DOUBLE) AS step_s
  FROM solar)"""

QUALITY_SQL = S.with_ctes(S.SOLAR, STEP_CTE, """base AS (
  SELECT site_id, count(*) AS n_rows,
         count_if(temp_c IS NULL) AS missing_temp_c, count_if(humidity IS NULL) AS missing_humidity,
         count_if(ghi IS NULL) AS missing_ghi, count_if(upper_rad IS NULL) AS missing_upper_rad,
         count_if(pv_kw IS NULL) AS missing_pv_kw,
         min(pv_kw) AS min_pv_kw, max(pv_kw) AS max_pv_kw,
         count(*) - count(DISTINCT ts) - CASE WHEN count_if(ts IS NULL) > 0
                                              THEN count_if(ts IS NULL) - 1 ELSE 0 END AS duplicate_ts
  FROM st GROUP BY site_id)""", """md AS (
  SELECT site_id, step_s AS modal_step_s FROM (
    SELECT site_id, step_s,
           row_number() OVER (PARTITION BY site_id ORDER BY count(*) DESC, step_s) AS r
    FROM st WHERE step_s IS NOT NULL GROUP BY site_id, step_s) WHERE r = 1)""", """gaps AS (
  SELECT st.site_id, count_if(st.step_s IS NOT NULL AND st.step_s <> md.modal_step_s) AS n_gaps
  FROM st JOIN md ON st.site_id = md.site_id GROUP BY st.site_id)""", """dups AS (
  SELECT site_id, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM (
    SELECT site_id, ts, temp_c, humidity, ghi, upper_rad, pv_kw, count(*) AS c
    FROM solar GROUP BY ALL) GROUP BY site_id)""") + """
SELECT base.*, md.modal_step_s, gaps.n_gaps, dups.duplicate_rows, base.min_pv_kw < 0 AS negative_pv_kw
FROM base LEFT JOIN md ON base.site_id = md.site_id
LEFT JOIN gaps ON base.site_id = gaps.site_id LEFT JOIN dups ON base.site_id = dups.site_id"""


@register("quality_report", sql=QUALITY_SQL,
          doubles=["min_pv_kw", "max_pv_kw", "modal_step_s"],
          operators=("AGG2", "AGG3", "AGG4", "AGG6", "AGG7", "FLT7", "WIN7"))
def quality_report(spark, sf_dir):
    return P.quality_report(FX.solar(spark, sf_dir), SOLAR_MEASURES, ["pv_kw"])


STEP_HIST_SQL = S.with_ctes(S.SOLAR, STEP_CTE) + """
SELECT site_id, step_s, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT site_id, step_s, count(*) AS n,
         row_number() OVER (PARTITION BY site_id ORDER BY count(*) DESC, step_s) AS rank
  FROM st WHERE step_s IS NOT NULL GROUP BY site_id, step_s) WHERE rank <= 5"""


@register("step_histogram", sql=STEP_HIST_SQL, doubles=["step_s"],
          operators=("AGG5", "WIN7", "SRT2"))
def step_histogram(spark, sf_dir):
    return P.step_histogram(FX.solar(spark, sf_dir))


TOP_MISSING_SQL = S.with_ctes(S.SOLAR) + """
SELECT site_id, "column", n_missing, CAST(rank AS INTEGER) AS rank FROM (
  SELECT site_id, "column", n_missing,
         row_number() OVER (PARTITION BY site_id ORDER BY n_missing DESC, "column") AS rank
  FROM (UNPIVOT (SELECT site_id, count_if(temp_c IS NULL) AS temp_c,
                        count_if(humidity IS NULL) AS humidity, count_if(ghi IS NULL) AS ghi,
                        count_if(upper_rad IS NULL) AS upper_rad, count_if(pv_kw IS NULL) AS pv_kw
                 FROM solar GROUP BY site_id)
        ON temp_c, humidity, ghi, upper_rad, pv_kw INTO NAME "column" VALUE n_missing))
WHERE rank <= 5"""


@register("top_missing", sql=TOP_MISSING_SQL, operators=("AGG2", "SRT2"))
def top_missing(spark, sf_dir):
    return P.top_missing(FX.solar(spark, sf_dir), SOLAR_MEASURES)


SANITY_SQL = S.with_ctes(S.SOLAR, S.WIND) + """
SELECT 'solar' AS source, site_id, rule, violations FROM (UNPIVOT (
  SELECT site_id,
         count_if(NOT coalesce(ghi >= 0, false)) AS ghi_negative,
         count_if(NOT coalesce(upper_rad >= 0, false)) AS upper_negative,
         count_if(coalesce(ghi = 0 AND pv_kw > 0, false)) AS night_generation,
         count_if(coalesce(CASE WHEN ghi > 0 THEN pv_kw / ghi ELSE CAST(0 AS DOUBLE) END > 1, false))
           AS efficiency_above_1
  FROM solar GROUP BY site_id)
  ON ghi_negative, upper_negative, night_generation, efficiency_above_1
  INTO NAME rule VALUE violations)
UNION ALL
SELECT 'wind', site_id, rule, violations FROM (UNPIVOT (
  SELECT site_id,
         count_if(NOT coalesce(wind_speed >= 0, false)) AS speed_negative,
         count_if(NOT coalesce(air_density > 0, false)) AS density_not_positive,
         count_if(NOT coalesce(wind_kw >= 0, false)) AS power_negative,
         count_if(coalesce(wind_speed > 50, false)) AS speed_above_50,
         count_if(coalesce(air_density < 0.5, false)) AS density_below_0_5
  FROM wind GROUP BY site_id)
  ON speed_negative, density_not_positive, power_negative, speed_above_50, density_below_0_5
  INTO NAME rule VALUE violations)"""


@register("sanity_rules", sql=SANITY_SQL, operators=("FLT5", "FLT6", "SC16"))
def sanity_rules(spark, sf_dir):
    s = V.rule_counts(FX.solar(spark, sf_dir), V.solar_rules()).withColumn("source", F.lit("solar"))
    w = V.rule_counts(FX.wind(spark, sf_dir), V.wind_rules()).withColumn("source", F.lit("wind"))
    return s.unionByName(w).select("source", "site_id", "rule", "violations")


QUARANTINE_SQL = S.with_ctes(S.WIND) + """
SELECT * FROM (
  SELECT *, list_filter([
      CASE WHEN NOT coalesce(wind_speed >= 0, false) THEN 'speed_negative' END,
      CASE WHEN NOT coalesce(air_density > 0, false) THEN 'density_not_positive' END,
      CASE WHEN NOT coalesce(wind_kw >= 0, false) THEN 'power_negative' END,
      CASE WHEN coalesce(wind_speed > 50, false) THEN 'speed_above_50' END,
      CASE WHEN coalesce(air_density < 0.5, false) THEN 'density_below_0_5' END],
      lambda x: x IS NOT NULL) AS broken_rules
  FROM wind) WHERE len(broken_rules) > 0"""


@register("quarantine_wind", sql=QUARANTINE_SQL,
          doubles=["air_density", "wind_speed", "wind_kw"], operators=("FLT6",))
def quarantine_wind(spark, sf_dir):
    return V.quarantine(FX.wind(spark, sf_dir), V.wind_rules())


ALIGN_SQL = S.with_ctes(S.SOLAR, S.WIND, S.SOLAR_DEDUP, S.WIND_DEDUP, """rng AS (
  SELECT a.site_id, greatest(a.lo, b.lo) AS common_start, least(a.hi, b.hi) AS common_end
  FROM (SELECT site_id, min(ts) lo, max(ts) hi FROM solar_d GROUP BY site_id) a
  JOIN (SELECT site_id, min(ts) lo, max(ts) hi FROM wind_d GROUP BY site_id) b
  ON a.site_id = b.site_id)""", """grid AS (
  SELECT site_id, unnest(generate_series(common_start, common_end, INTERVAL 15 MINUTE)) AS ts
  FROM rng WHERE common_start <= common_end)""") + """
SELECT g.site_id, g.ts, s.row_id AS row_id_solar, s.pv_kw AS pv_kw_solar,
       w.row_id AS row_id_wind, w.wind_kw AS wind_kw_wind
FROM grid g LEFT JOIN solar_d s ON g.site_id = s.site_id AND g.ts = s.ts
LEFT JOIN wind_d w ON g.site_id = w.site_id AND g.ts = w.ts"""


@register("align_grid", sql=ALIGN_SQL, doubles=["pv_kw_solar", "wind_kw_wind"],
          operators=("JN3", "FLT3"))
def align_grid(spark, sf_dir):
    s = M.dedup_first(FX.solar(spark, sf_dir)).select("site_id", "ts", "row_id", "pv_kw")
    w = M.dedup_first(FX.wind(spark, sf_dir)).select("site_id", "ts", "row_id", "wind_kw")
    rng = M.common_range([s, w])
    out = V.align({"solar": s, "wind": w}, rng, 15)
    return out.select("site_id", "ts", "row_id_solar", "pv_kw_solar", "row_id_wind", "wind_kw_wind")
