"""Registered queries: design-document operators (DOC1-DOC4, DOC6-DOC9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import features as FE
from gridlake.operators import regime as R
from gridlake.plans.feature_queries import ENGINEERED_CTES, engineered_features
from gridlake.plans.merge_queries import merged_table
from gridlake.plans.registry import register
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX

D = "AS DOUBLE"


def c(x) -> str:
    return f"CAST({x} {D})"


def sdiv(a, b):
    return f"CASE WHEN {b} = 0 THEN CAST(NULL {D}) ELSE {a} / {b} END"



REGIME_COLS = ["site_id", "ts", "rn", "total_volatility", "complementarity_index",
               "total_renewable_power", "forecast_uncertainty", "regime", "vol_norm", "k_inertia",
               "k_droop", "s_base_kw", "p_pu"]

REGIME_SQL = S.with_ctes(*ENGINEERED_CTES, """u AS (
  SELECT *, stddev_samp(total_rate_of_change) OVER (PARTITION BY site_id ORDER BY ts
              ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS forecast_uncertainty FROM fe)""", """th AS (
  SELECT site_id, quantile_cont(total_volatility, 0.25) AS v1,
         quantile_cont(total_volatility, 0.75) AS v2, quantile_cont(total_volatility, 0.9) AS v3,
         quantile_cont(forecast_uncertainty, 0.75) AS u1, max(total_volatility) AS vmax,
         avg(total_renewable_power) AS s_base_kw
  FROM u GROUP BY site_id)""", f"""g AS (
  SELECT u.*, th.v1, th.v2, th.v3, th.u1, th.s_base_kw,
         {sdiv('u.total_volatility', 'th.vmax')} AS vol_norm
  FROM u JOIN th ON u.site_id = th.site_id)""") + f"""
SELECT site_id, ts, rn, total_volatility, complementarity_index, total_renewable_power,
       forecast_uncertainty,
       CASE WHEN total_volatility < v1 THEN 'STABLE'
            WHEN complementarity_index > 0.7 THEN 'COMPLEMENTARY'
            WHEN total_volatility > v3 AND forecast_uncertainty > u1 THEN 'EXTREME'
            WHEN total_volatility > v2 THEN 'TURBULENT' ELSE 'RAMPING' END AS regime,
       vol_norm,
       {c(4000)} * ({c(1)} + {c(0.5)} * vol_norm) * ({c(1)} - complementarity_index) AS k_inertia,
       {c(6000)} * ({c(1)} + {c(0.5)} * vol_norm) * ({c(1)} - complementarity_index) AS k_droop,
       s_base_kw, {sdiv('total_renewable_power', 's_base_kw')} AS p_pu
FROM g"""


@register("regime_label", sql=REGIME_SQL,
          doubles=["total_volatility", "complementarity_index", "total_renewable_power",
                   "forecast_uncertainty", "vol_norm", "k_inertia", "k_droop", "s_base_kw", "p_pu"],
          operators=("DOC1", "DOC2", "DOC3", "DOC9"))
def regime_label(spark, sf_dir):
    fe = engineered_features(spark, sf_dir)
    u = R.forecast_uncertainty(fe, "total_rate_of_change", spec=FE.MERGED_SPEC)
    return R.adaptive_gains(R.regime_labels(u)).select(*REGIME_COLS)


W = "OVER (PARTITION BY site_id ORDER BY ts, row_id"
TEL = ["frequency", "soc", "p_renewable", "p_load", "p_thermal", "p_battery"]

RISK_SQL = S.with_ctes(S.TELEMETRY, S.SOLAR, S.WIND, S.SOLAR_DEDUP, S.WIND_DEDUP, S.MERGED, """tc AS (
  SELECT t.*, m.complementarity_index FROM telemetry t
  LEFT JOIN merged m ON m.site_id = t.site_id AND m.ts = date_trunc('hour', t.ts))""", f"""a AS (
  SELECT *, CAST(row_number() {W}) - 1 AS BIGINT) AS rn,
         lag(p_renewable, 1) {W}) AS forecast_renewable, lag(p_load, 1) {W}) AS forecast_load
  FROM tc)""", """b AS (
  SELECT *, p_renewable - forecast_renewable AS forecast_error,
         abs(p_renewable - forecast_renewable) AS renewable_volatility FROM a)""", f"""u AS (
  SELECT *, stddev_samp(forecast_error) {W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
           AS forecast_uncertainty FROM b)""", """st AS (
  SELECT site_id, max(forecast_uncertainty) AS umax, max(renewable_volatility) AS vmax
  FROM u GROUP BY site_id)""", f"""n AS (
  SELECT u.*, coalesce({sdiv('u.forecast_uncertainty', 'st.umax')}, {c(0)}) AS uncertainty_norm,
         coalesce({sdiv('u.renewable_volatility', 'st.vmax')}, {c(0)}) AS vol_norm,
         abs(u.soc - {c(0.5)}) / {c(0.5)} AS soc_risk,
         {c(0.25)} * ({c(1)} - coalesce(u.complementarity_index, {c(0)})) AS _comp_term
  FROM u JOIN st ON u.site_id = st.site_id)""") + f"""
SELECT * EXCLUDE (_comp_term),
       {c(0.25)} * vol_norm + {c(0.25)} * uncertainty_norm + _comp_term + {c(0.25)} * soc_risk > 0.5 AS fri_alert
FROM (
  SELECT *, {c(-0.5)} * (forecast_renewable - forecast_load) * ({c(1)} - uncertainty_norm) AS p_predictive,
         {c(0.25)} * vol_norm + {c(0.25)} * uncertainty_norm + _comp_term + {c(0.25)} * soc_risk AS fri,
         p_renewable - p_load AS renewable_excess,
         greatest(p_renewable - p_load - {c(7000)}, {c(0)}) AS curtailment_kw,
         least(p_renewable, p_load + {c(7000)}) AS p_renewable_effective
  FROM n)"""


@register("grid_risk", sql=RISK_SQL,
          doubles=TEL + ["complementarity_index", "forecast_renewable", "forecast_load", "forecast_error", "renewable_volatility",
                         "forecast_uncertainty", "uncertainty_norm", "vol_norm", "soc_risk",
                         "p_predictive", "fri", "renewable_excess", "curtailment_kw",
                         "p_renewable_effective"],
          operators=("DOC4", "DOC6", "DOC7", "DOC2"))
def grid_risk(spark, sf_dir):
    """The risk index of the merged table: telemetry rows with the complementarity of
    their site and hour."""
    hours = merged_table(spark, sf_dir).select("site_id", F.col("ts").alias("_hour"), "complementarity_index")
    tel = FX.telemetry(spark, sf_dir).withColumn("_hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    rows = tel.join(hours, ["site_id", "_hour"], "left").drop("_hour")
    return R.curtailment(R.predictive_term(rows, comp="complementarity_index"))


@register("battery_requirement", sql=S.with_ctes(S.TELEMETRY) + f"""
SELECT site_id, max_delta_p_kw, {c(0.8)} * max_delta_p_kw AS required_kw,
       {c(7000)} >= {c(0.8)} * max_delta_p_kw AS adequate,
       {c(7000)} < {c(0.8)} * max_delta_p_kw AS curtailment_required
FROM (SELECT site_id, max(abs(p_renewable - p_load)) AS max_delta_p_kw FROM telemetry GROUP BY site_id)""",
          doubles=["max_delta_p_kw", "required_kw"], operators=("DOC8",))
def battery_requirement(spark, sf_dir):
    return R.battery_requirement(FX.telemetry(spark, sf_dir))
