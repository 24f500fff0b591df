"""Registered queries: cleaning (PRJ5, FLT1, FLT2, WIN4, WIN5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import exprs as X
from gridlake.operators import clean as C
from gridlake.plans.registry import register
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX
from gridlake.sources.sql_fill import fill_case, neighbour_ctes

SOLAR_OUT = ["site_id", "row_id", "ts", "hour", "temp_c", "humidity", "ghi", "upper_rad", "pv_kw"]
WIND_OUT = ["site_id", "row_id", "ts", "air_density", "wind_speed", "wind_kw"]

DAY = "hour BETWEEN 6 AND 20"


def _iqr_hit(c: str, q: str = "qb", side: str = "a") -> str:
    v = f"{side}.{c}"
    return (f"({v} < {q}.{c}__q1 - CAST(3 AS DOUBLE) * ({q}.{c}__q3 - {q}.{c}__q1) "
            f"OR {v} > {q}.{c}__q3 + CAST(3 AS DOUBLE) * ({q}.{c}__q3 - {q}.{c}__q1))")


SOLAR_CLEAN_SQL = S.with_ctes(S.SOLAR, f"""a AS (
  SELECT site_id, row_id, ts, CAST(hour(ts) AS INTEGER) AS hour, temp_c, humidity, ghi, upper_rad,
         CASE WHEN pv_kw < 0 AND (hour(ts) < 6 OR hour(ts) > 20) THEN CAST(0 AS DOUBLE)
              WHEN pv_kw < 0 THEN CAST(NULL AS DOUBLE) ELSE pv_kw END AS pv_kw
  FROM solar)""", f"""qb AS (
  SELECT site_id, quantile_cont(pv_kw, 0.25) AS pv_kw__q1, quantile_cont(pv_kw, 0.75) AS pv_kw__q3
  FROM a WHERE {DAY} AND pv_kw IS NOT NULL GROUP BY site_id)""", f"""b AS (
  SELECT a.* REPLACE (CASE WHEN a.{DAY} AND {_iqr_hit('pv_kw')} THEN CAST(NULL AS DOUBLE)
                           ELSE a.pv_kw END AS pv_kw)
  FROM a LEFT JOIN qb ON a.site_id = qb.site_id)""", """r AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts, row_id) - 1 AS rn FROM b)""",
    neighbour_ctes("r", ["pv_kw"], "g")) + f"""
SELECT site_id, row_id, ts, hour, temp_c, humidity, ghi, upper_rad, {fill_case('pv_kw', 3, 10)} AS pv_kw
FROM g"""

WIND_CLEAN_SQL = S.with_ctes(S.WIND, """a AS (
  SELECT site_id, row_id, ts, air_density,
         CASE WHEN wind_speed < 0 THEN CAST(0 AS DOUBLE) ELSE wind_speed END AS wind_speed,
         CASE WHEN wind_kw < 0 THEN CAST(0 AS DOUBLE) ELSE wind_kw END AS wind_kw
  FROM wind)""", """qb AS (
  SELECT site_id,
         quantile_cont(wind_kw, 0.25) AS wind_kw__q1, quantile_cont(wind_kw, 0.75) AS wind_kw__q3,
         quantile_cont(wind_speed, 0.25) AS wind_speed__q1,
         quantile_cont(wind_speed, 0.75) AS wind_speed__q3
  FROM a GROUP BY site_id)""", f"""b AS (
  SELECT a.* REPLACE (
           CASE WHEN {_iqr_hit('wind_kw')} THEN CAST(NULL AS DOUBLE) ELSE a.wind_kw END AS wind_kw,
           CASE WHEN {_iqr_hit('wind_speed')} THEN CAST(NULL AS DOUBLE) ELSE a.wind_speed END
             AS wind_speed)
  FROM a LEFT JOIN qb ON a.site_id = qb.site_id)""", """r AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts, row_id) - 1 AS rn FROM b)""",
    neighbour_ctes("r", ["wind_kw", "wind_speed"], "g")) + f"""
SELECT site_id, row_id, ts, air_density, {fill_case('wind_speed', 0, 10)} AS wind_speed,
       {fill_case('wind_kw', 3, 10)} AS wind_kw
FROM g"""


@register("clean_solar", sql=SOLAR_CLEAN_SQL,
          doubles=["temp_c", "humidity", "ghi", "upper_rad", "pv_kw"],
          operators=("PRJ5", "FLT1", "FLT2", "WIN4", "WIN5"))
def clean_solar(spark, sf_dir):
    return C.clean_solar(FX.solar(spark, sf_dir)).select(*SOLAR_OUT)


@register("clean_wind", sql=WIND_CLEAN_SQL,
          doubles=["air_density", "wind_speed", "wind_kw"],
          operators=("PRJ5", "FLT1", "FLT2", "WIN4", "WIN5"))
def clean_wind(spark, sf_dir):
    return C.clean_wind(FX.wind(spark, sf_dir)).select(*WIND_OUT)


OUTLIER_SQL = S.with_ctes(S.SOLAR, S.WIND, """a AS (
  SELECT site_id, CAST(hour(ts) AS INTEGER) AS hour,
         CASE WHEN pv_kw < 0 AND (hour(ts) < 6 OR hour(ts) > 20) THEN CAST(0 AS DOUBLE)
              WHEN pv_kw < 0 THEN CAST(NULL AS DOUBLE) ELSE pv_kw END AS v
  FROM solar)""", """sq AS (
  SELECT site_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
  FROM a WHERE hour BETWEEN 6 AND 20 AND v IS NOT NULL GROUP BY site_id)""", """wl AS (
  SELECT site_id, 'wind_kw' AS col, CASE WHEN wind_kw < 0 THEN CAST(0 AS DOUBLE) ELSE wind_kw END AS v
  FROM wind
  UNION ALL
  SELECT site_id, 'wind_speed', CASE WHEN wind_speed < 0 THEN CAST(0 AS DOUBLE) ELSE wind_speed END
  FROM wind)""", """wq AS (
  SELECT site_id, col, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
  FROM wl WHERE v IS NOT NULL GROUP BY site_id, col)""") + """
SELECT 'solar' AS source, sq.site_id, 'pv_kw' AS "column", sq.q1, sq.q3,
       sq.q1 - CAST(3 AS DOUBLE) * (sq.q3 - sq.q1) AS lower,
       sq.q3 + CAST(3 AS DOUBLE) * (sq.q3 - sq.q1) AS upper,
       CAST(count_if(a.hour BETWEEN 6 AND 20 AND (a.v < sq.q1 - CAST(3 AS DOUBLE) * (sq.q3 - sq.q1)
                     OR a.v > sq.q3 + CAST(3 AS DOUBLE) * (sq.q3 - sq.q1))) AS BIGINT) AS n_outliers
FROM a JOIN sq ON a.site_id = sq.site_id GROUP BY ALL
UNION ALL
SELECT 'wind', wq.site_id, wq.col, wq.q1, wq.q3,
       wq.q1 - CAST(3 AS DOUBLE) * (wq.q3 - wq.q1), wq.q3 + CAST(3 AS DOUBLE) * (wq.q3 - wq.q1),
       CAST(count_if(wl.v < wq.q1 - CAST(3 AS DOUBLE) * (wq.q3 - wq.q1)
                     OR wl.v > wq.q3 + CAST(3 AS DOUBLE) * (wq.q3 - wq.q1)) AS BIGINT)
FROM wl JOIN wq ON wl.site_id = wq.site_id AND wl.col = wq.col GROUP BY ALL"""


@register("outlier_bounds", sql=OUTLIER_SQL, doubles=["q1", "q3", "lower", "upper"],
          operators=("FLT2",))
def outlier_bounds(spark, sf_dir):
    s = FX.solar(spark, sf_dir).withColumn("hour", F.hour("ts"))
    s = s.withColumn("pv_kw", F.when((F.col("pv_kw") < 0) & ~X.is_daylight("hour"), F.lit(0.0))
                     .when(F.col("pv_kw") < 0, F.lit(None).cast("double")).otherwise(F.col("pv_kw")))
    w = FX.wind(spark, sf_dir)
    for c in ("wind_kw", "wind_speed"):
        w = w.withColumn(c, F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)))
    sb = C.outlier_bounds(s, ["pv_kw"], X.is_daylight("hour")).withColumn("source", F.lit("solar"))
    wb = C.outlier_bounds(w, ["wind_kw", "wind_speed"]).withColumn("source", F.lit("wind"))
    return sb.unionByName(wb)
