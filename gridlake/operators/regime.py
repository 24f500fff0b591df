"""Operators specified in the reference's design documents (DOC1-DOC9).

The documents fix the formulas, not all constants; our defaults are the
``RegimeParams`` below (percentile thresholds per site, gains 4000 / 6000 as
in the simulator, weights 0.25).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gridlake.operators.telemetry import PARAMS, GridParams
from gridlake.plans.grouping import exact_quantiles
from gridlake.plans.materialize import join_small
from gridlake.plans.sequence import DEFAULT_SPEC, SeriesSpec, windowed


@dataclass(frozen=True)
class RegimeParams:
    # documented values: complementarity threshold 0.7, battery requirement
    # factor 0.8, low-pass alpha 0.2-0.3
    complementarity_threshold: float = 0.7
    v1_pct: float = 0.25      # STABLE below this volatility percentile
    v2_pct: float = 0.75      # TURBULENT above
    v3_pct: float = 0.90      # EXTREME above (with high uncertainty)
    u1_pct: float = 0.75      # high forecast uncertainty
    uncertainty_rows: int = 6
    alpha_inertia: float = 0.5
    alpha_droop: float = 0.5
    k_forecast: float = 0.5
    fri_weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)
    fri_threshold: float = 0.5
    requirement_factor: float = 0.8


REGIME = RegimeParams()


def forecast_uncertainty(df: DataFrame, error: str, rows: int = REGIME.uncertainty_rows,
                         spec: SeriesSpec = DEFAULT_SPEC, out: str = "forecast_uncertainty") -> DataFrame:
    """DOC2: rolling sample std of the forecast error over ``rows`` rows."""
    def cols(w):
        return {out: F.stddev_samp(error).over(w.rowsBetween(-(rows - 1), 0))}
    return windowed(df, cols, halo=rows - 1, spec=spec)


def regime_labels(df: DataFrame, vol: str = "total_volatility", comp: str = "complementarity_index",
                  unc: str = "forecast_uncertainty", p: RegimeParams = REGIME,
                  key=("site_id",)) -> DataFrame:
    """DOC1: ordered rules with per-site percentile thresholds."""
    th = exact_quantiles(df, key, {"_v": (F.col(vol), [p.v1_pct, p.v2_pct, p.v3_pct]), "_u": (F.col(unc), [p.u1_pct])})
    th = th.select(*key, F.col("_v")[0].alias("_v1"), F.col("_v")[1].alias("_v2"),
                   F.col("_v")[2].alias("_v3"), F.col("_u")[0].alias("_u1"))
    j = join_small(df, th, list(key), "left", name="regime_thresholds")
    label = (F.when(F.col(vol) < F.col("_v1"), "STABLE")
              .when(F.col(comp) > p.complementarity_threshold, "COMPLEMENTARY")
              .when((F.col(vol) > F.col("_v3")) & (F.col(unc) > F.col("_u1")), "EXTREME")
              .when(F.col(vol) > F.col("_v2"), "TURBULENT")
              .otherwise("RAMPING"))
    return j.withColumn("regime", label).drop("_v1", "_v2", "_v3", "_u1")


def adaptive_gains(df: DataFrame, vol: str = "total_volatility", comp: str = "complementarity_index",
                   total: str = "total_renewable_power", p: RegimeParams = REGIME,
                   g: GridParams = PARAMS, key=("site_id",)) -> DataFrame:
    """DOC3 + DOC9: ``k (1 + alpha vol / max vol) (1 - compl)`` and per-unit
    power with ``S_base = mean(total)`` per site."""
    st = df.groupBy(*key).agg(F.max(vol).alias("_vmax"), F.avg(total).alias("s_base_kw"))
    j = join_small(df, st, list(key), "left", name="gain_stats")
    vn = F.try_divide(F.col(vol), F.col("_vmax"))
    return (j.withColumn("vol_norm", vn)
             .withColumn("k_inertia", F.lit(g.k_inertia) * (F.lit(1.0) + F.lit(p.alpha_inertia) * F.col("vol_norm"))
                         * (F.lit(1.0) - F.col(comp)))
             .withColumn("k_droop", F.lit(g.k_droop) * (F.lit(1.0) + F.lit(p.alpha_droop) * F.col("vol_norm"))
                         * (F.lit(1.0) - F.col(comp)))
             .withColumn("p_pu", F.try_divide(F.col(total), F.col("s_base_kw")))
             .drop("_vmax"))


def curtailment(df: DataFrame, renewable: str = "p_renewable", load: str = "p_load",
                g: GridParams = PARAMS) -> DataFrame:
    """DOC4: renewable excess beyond the battery's power is curtailed."""
    excess = F.col(renewable) - F.col(load)
    return (df.withColumn("renewable_excess", excess)
              .withColumn("curtailment_kw", F.greatest(excess - F.lit(g.battery_kw), F.lit(0.0)))
              .withColumn("p_renewable_effective",
                          F.least(F.col(renewable), F.col(load) + F.lit(g.battery_kw))))


def predictive_term(df: DataFrame, renewable: str = "p_renewable", load: str = "p_load",
                    soc: str = "soc", comp: str | None = None, p: RegimeParams = REGIME,
                    g: GridParams = PARAMS, spec: SeriesSpec = DEFAULT_SPEC,
                    key=("site_id",)) -> DataFrame:
    """DOC6 + DOC7: persistence forecasts of renewable and load, their
    uncertainty (rolling std of the renewable forecast error), the
    uncertainty-discounted predictive power term and the frequency risk
    index ``w1 vol + w2 uncertainty + w3 (1 - complementarity) + w4 SOC
    risk``.  ``comp`` names the complementarity; a row without one counts as not
    complementary at all.  Without ``comp`` the term is left out."""
    rows = p.uncertainty_rows

    def first(w):
        return {"forecast_renewable": F.lag(renewable, 1).over(w),
                "forecast_load": F.lag(load, 1).over(w)}
    d = windowed(df, first, halo=1, spec=spec)
    d = (d.withColumn("forecast_error", F.col(renewable) - F.col("forecast_renewable"))
          .withColumn("renewable_volatility", F.abs(F.col("forecast_error"))))
    d = forecast_uncertainty(d, "forecast_error", rows, spec)
    st = d.groupBy(*key).agg(F.max("forecast_uncertainty").alias("_umax"),
                             F.max("renewable_volatility").alias("_vmax"))
    j = join_small(d, st, list(key), "left", name="risk_stats")
    un = F.coalesce(F.try_divide(F.col("forecast_uncertainty"), F.col("_umax")), F.lit(0.0))
    vn = F.coalesce(F.try_divide(F.col("renewable_volatility"), F.col("_vmax")), F.lit(0.0))
    soc_risk = F.abs(F.col(soc) - F.lit(g.soc_target)) / F.lit(g.soc_target)
    w1, w2, w3, w4 = p.fri_weights
    return (j.withColumn("uncertainty_norm", un).withColumn("vol_norm", vn)
             .withColumn("p_predictive", F.lit(-p.k_forecast)
                         * (F.col("forecast_renewable") - F.col("forecast_load"))
                         * (F.lit(1.0) - F.col("uncertainty_norm")))
             .withColumn("soc_risk", soc_risk)
             .withColumn("fri", F.lit(w1) * F.col("vol_norm") + F.lit(w2) * F.col("uncertainty_norm")
                         + (F.lit(w3) * (F.lit(1.0) - F.coalesce(F.col(comp), F.lit(0.0))) if comp else F.lit(0.0))
                         + F.lit(w4) * F.col("soc_risk"))
             .withColumn("fri_alert", F.col("fri") > p.fri_threshold)
             .drop("_umax", "_vmax"))


def battery_requirement(df: DataFrame, renewable: str = "p_renewable", load: str = "p_load",
                        p: RegimeParams = REGIME, g: GridParams = PARAMS, key=("site_id",)) -> DataFrame:
    """DOC8: ``P_battery >= 0.8 * max |renewable - load|``."""
    g2 = df.groupBy(*key).agg(F.max(F.abs(F.col(renewable) - F.col(load))).alias("max_delta_p_kw"))
    req = F.lit(p.requirement_factor) * F.col("max_delta_p_kw")
    return (g2.withColumn("required_kw", req)
              .withColumn("adequate", F.lit(g.battery_kw) >= req)
              .withColumn("curtailment_required", F.lit(g.battery_kw) < req))
