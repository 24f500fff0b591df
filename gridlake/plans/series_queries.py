"""Registered query: rolling features over long supplier series
(``yield_series`` from ``lineitem``; WIN1-WIN3, WIN9-style 12-row mean)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.plans.registry import register
from gridlake.plans.sequence import SeriesSpec, windowed
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX

YIELD_SPEC = SeriesSpec(order=FX.YIELD_ORDER)


def yield_rolling_df(df, spec: SeriesSpec = YIELD_SPEC):
    def cols(w):
        return {
            "pv_lag_1": F.lag("pv_kw", 1).over(w),
            "pv_lag_24": F.lag("pv_kw", 24).over(w),
            "pv_ramp": F.col("pv_kw") - F.lag("pv_kw", 1).over(w),
            "pv_mean_12": F.avg("pv_kw").over(w.rowsBetween(-11, 0)),
            "pv_std_12": F.stddev_samp("pv_kw").over(w.rowsBetween(-11, 0)),
        }
    out = windowed(df.drop("wind_speed"), cols, halo=24, spec=spec)
    return out


W = "OVER (PARTITION BY site_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey, pv_kw"


@register("yield_rolling", sql=S.with_ctes(S.YIELD) + f"""
SELECT site_id, ts, l_orderkey, l_linenumber, l_partkey, pv_kw,
       CAST(row_number() {W}) - 1 AS BIGINT) AS rn,
       lag(pv_kw, 1) {W}) AS pv_lag_1, lag(pv_kw, 24) {W}) AS pv_lag_24,
       pv_kw - lag(pv_kw, 1) {W}) AS pv_ramp,
       avg(pv_kw) {W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS pv_mean_12,
       stddev_samp(pv_kw) {W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS pv_std_12
FROM yield_series""", doubles=["pv_kw", "pv_lag_1", "pv_lag_24", "pv_ramp", "pv_mean_12", "pv_std_12"],
          operators=("WIN1", "WIN2", "WIN3"))
def yield_rolling(spark, sf_dir):
    return yield_rolling_df(FX.yield_series(spark, sf_dir))
