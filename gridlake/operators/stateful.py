"""Stateful per-series operators (ST1-ST4, DOC5).

ST2 (state of charge), ST3 (clamped AGC integral) and DOC5 (low-pass
filter) compose and run chunk-parallel (``plans.fold``); ST1 (ramp-limited
follower) does not compose but is monotone with a bounded state, so it runs
chunk-parallel by coupling from both ends; ST4 (bounded history) is the
12-row moving average of ``telemetry.dispatch_setpoint``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridlake.operators.telemetry import PARAMS, GridParams
from gridlake.plans.fold import affine_scan, clamp_scan, monotone_scan
from gridlake.plans.sequence import DEFAULT_SPEC, SeriesSpec


def soc_step(power: str = "p_battery", p: GridParams = PARAMS):
    """Energy change of one step: discharge (power > 0) removes
    ``min(P, max) dt / eff``; charge adds ``min(-P, max) dt eff``."""
    pw = F.col(power)
    dis = F.least(pw, F.lit(p.battery_kw))
    chg = F.least(-pw, F.lit(p.battery_kw))
    return (F.when(pw > 0, -(dis * F.lit(p.dt_hours) / F.lit(p.efficiency)))
             .otherwise(chg * F.lit(p.dt_hours) * F.lit(p.efficiency)))


def soc_balance(df: DataFrame, power: str = "p_battery", p: GridParams = PARAMS,
                spec: SeriesSpec = DEFAULT_SPEC) -> DataFrame:
    """ST2: battery energy bounded to [10 %, 90 %] of capacity, starting at
    50 %; returns ``energy_kwh``, ``soc`` and the power really moved
    (positive = discharge), which is below the command when a bound bites."""
    lo = p.soc_min * p.battery_kwh
    hi = p.soc_max * p.battery_kwh
    d = df.withColumn("_de", soc_step(power, p))
    s = clamp_scan(d, "_de", lo, hi, p.soc_initial * p.battery_kwh, spec, out="energy_kwh")
    pw = F.col(power)
    before, after = F.col("energy_kwh_before"), F.col("energy_kwh")
    moved = (F.when(pw > 0,
                    F.when(before + F.col("_de") < F.lit(lo),
                           (before - after) * F.lit(p.efficiency) / F.lit(p.dt_hours))
                     .otherwise(F.least(pw, F.lit(p.battery_kw))))
              .otherwise(-F.when(before + F.col("_de") > F.lit(hi),
                                 (after - before) / (F.lit(p.dt_hours) * F.lit(p.efficiency)))
                          .otherwise(F.least(-pw, F.lit(p.battery_kw)))))
    return (s.withColumn("soc_after", after / F.lit(p.battery_kwh))
             .withColumn("p_moved", moved)
             .drop("_de", "energy_kwh_before"))


def agc_integral(terms: DataFrame, freq: str = "frequency", p: GridParams = PARAMS,
                 spec: SeriesSpec = DEFAULT_SPEC) -> DataFrame:
    """ST3: ``I = clip(I + (k_i (50 - f) + k_aw (actual - command)) dt, +-5000)``
    with back-calculation anti-windup; ``p_agc`` is the integral."""
    step = ((F.lit(p.k_i_agc) * (F.lit(p.nominal_hz) - F.col(freq))
             + F.lit(p.k_aw) * (F.col("p_actual") - F.col("p_command"))) * F.lit(p.dt_hours))
    d = terms.withColumn("_di", step)
    s = clamp_scan(d, "_di", -p.integral_limit, p.integral_limit, 0.0, spec, out="p_agc")
    return s.drop("_di", "p_agc_before")


def ramp_follow(df: DataFrame, target: str = "thermal_setpoint", p: GridParams = PARAMS,
                spec: SeriesSpec = DEFAULT_SPEC) -> DataFrame:
    """ST1: ``y += clip(clip(target, 0, max) - y, -ramp, +ramp)`` from 0."""
    cap, ramp = p.thermal_kw, p.ramp_per_step

    def step(y, row):
        t = row[target]  # NULL target: hold
        return np.where(np.isnan(t), y, y + np.clip(np.clip(t, 0.0, cap) - y, -ramp, ramp))

    # each step is monotone in y and keeps y in [0, cap]: chunk-parallel
    return monotone_scan(df, step, [target], 0.0, 0.0, cap, spec, out="p_thermal_dispatch",
                         holds=lambda cols: np.isnan(cols[target]))


def low_pass(df: DataFrame, col: str, alpha: float = 0.25, spec: SeriesSpec = DEFAULT_SPEC,
             out: str | None = None) -> DataFrame:
    """DOC5: ``s = alpha x + (1 - alpha) s_prev``, started at the first value;
    a NULL input keeps the previous smoothed value."""
    out = out or f"{col}_smooth"
    d = (df.withColumn("_m", F.when(F.col(col).isNull(), F.lit(1.0)).otherwise(F.lit(1.0 - alpha)))
           .withColumn("_b", F.when(F.col(col).isNull(), F.lit(0.0))
                       .otherwise(F.lit(alpha) * F.col(col))))
    s = affine_scan(d, "_m", "_b", x0_col=col, spec=spec, out=out)
    return s.drop("_m", "_b")
