"""Registered queries: merging solar and wind (WIN8, FLT3, JN1, JN4, JN6, SC6, SC7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import merge as M
from gridlake.plans.registry import register
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX

MERGED_COLS = ["site_id", "ts", "row_id_solar", "temp_c", "humidity", "ghi", "upper_rad",
               "pv_kw", "row_id_wind", "air_density", "wind_speed", "wind_kw",
               "complementarity_index", "total_renewable_power", "renewable_capacity_factor"]
MERGED_DOUBLES = ["temp_c", "humidity", "ghi", "upper_rad", "pv_kw", "air_density", "wind_speed",
                  "wind_kw", "complementarity_index", "total_renewable_power",
                  "renewable_capacity_factor"]


def merged_table(spark, sf_dir):
    return M.unified_timeline(FX.solar(spark, sf_dir), FX.wind(spark, sf_dir)).select(*MERGED_COLS)


@register("merge_complementarity",
          sql=S.with_ctes(S.SOLAR, S.WIND, S.SOLAR_DEDUP, S.WIND_DEDUP, S.MERGED)
          + "SELECT * FROM merged",
          doubles=MERGED_DOUBLES,
          operators=("WIN8", "FLT3", "JN1", "JN6", "SC6", "SC7"))
def merge_complementarity(spark, sf_dir):
    return merged_table(spark, sf_dir)


@register("dedup_first",
          sql=S.with_ctes(S.SOLAR, S.SOLAR_DEDUP) + "SELECT * FROM solar_d",
          doubles=["temp_c", "humidity", "ghi", "upper_rad", "pv_kw"],
          operators=("WIN8",))
def dedup_first(spark, sf_dir):
    return M.dedup_first(FX.solar(spark, sf_dir), ("site_id", "ts"))


@register("overlap_filter",
          sql=S.with_ctes(S.SOLAR, S.WIND) + """
SELECT s.* FROM solar s JOIN (
  SELECT a.site_id, greatest(a.lo, b.lo) AS common_start, least(a.hi, b.hi) AS common_end
  FROM (SELECT site_id, min(ts) lo, max(ts) hi FROM solar GROUP BY site_id) a
  JOIN (SELECT site_id, min(ts) lo, max(ts) hi FROM wind GROUP BY site_id) b USING (site_id)) r
ON s.site_id = r.site_id AND s.ts BETWEEN r.common_start AND r.common_end""",
          doubles=["temp_c", "humidity", "ghi", "upper_rad", "pv_kw"],
          operators=("FLT3",))
def overlap_filter(spark, sf_dir):
    s, w = FX.solar(spark, sf_dir), FX.wind(spark, sf_dir)
    return M.overlap_filter(s, M.common_range([s, w]))


@register("row_zip",
          sql=S.with_ctes(S.SOLAR, S.WIND) + """
SELECT s.site_id, s.rn, s.row_id AS row_id_solar, s.ts AS ts_solar, s.pv_kw AS pv_kw_solar,
       w.row_id AS row_id_wind, w.ts AS ts_wind, w.wind_kw AS wind_kw_wind
FROM (SELECT site_id, row_id, ts, pv_kw,
             CAST(row_number() OVER (PARTITION BY site_id ORDER BY ts, row_id) - 1 AS BIGINT) AS rn
      FROM solar) s
JOIN (SELECT site_id, row_id, ts, wind_kw,
             CAST(row_number() OVER (PARTITION BY site_id ORDER BY ts, row_id) - 1 AS BIGINT) AS rn
      FROM wind) w
ON s.site_id = w.site_id AND s.rn = w.rn""",
          doubles=["pv_kw_solar", "wind_kw_wind"],
          operators=("JN4",))
def row_zip(spark, sf_dir):
    s = FX.solar(spark, sf_dir).select("site_id", "row_id", "ts", "pv_kw")
    w = FX.wind(spark, sf_dir).select("site_id", "row_id", "ts", "wind_kw")
    z = M.row_zip(s, w)
    return z.select("site_id", "rn", "row_id_solar", "ts_solar", "pv_kw_solar",
                    "row_id_wind", "ts_wind", "wind_kw_wind")


@register("generation_summary",
          sql=S.with_ctes(S.SOLAR, S.WIND, S.SOLAR_DEDUP, S.WIND_DEDUP, S.MERGED) + """
SELECT site_id, count(*) AS total_samples,
       avg(pv_kw) AS solar_mean_kw, avg(wind_kw) AS wind_mean_kw,
       avg(total_renewable_power) AS total_mean_kw,
       max(pv_kw) AS solar_max_kw, max(wind_kw) AS wind_max_kw,
       max(total_renewable_power) AS total_max_kw,
       avg(complementarity_index) AS complementarity_index
FROM merged GROUP BY site_id""",
          doubles=["solar_mean_kw", "wind_mean_kw", "total_mean_kw", "solar_max_kw",
                   "wind_max_kw", "total_max_kw", "complementarity_index"],
          operators=("AGG16",))
def generation_summary(spark, sf_dir):
    from gridlake.operators.profile import generation_summary as gs
    return gs(merged_table(spark, sf_dir))
