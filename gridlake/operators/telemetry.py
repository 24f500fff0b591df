"""Grid telemetry: load profile, sizing, dispatch, control terms, KPIs.

Operators: SC17 (load profile), AGG19 (battery sizing), WIN9 (trailing
12-row moving average -> thermal setpoint), WIN10 (RoCoF), SC18 (stability
flag), SC19 (open-loop control terms), SC20 (power clamps, ramp margin),
SC21 (per-unit imbalance), AGG17 (KPIs), AGG18 (KPI target gate).

These are the open-loop pieces of the reference's closed-loop simulator,
applied to telemetry tables (one series per ``site_id``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gridlake.functions.exprs import counter_normal
from gridlake.plans.materialize import join_small
from gridlake.plans.sequence import DEFAULT_SPEC, SeriesSpec, number_rows, windowed


@dataclass(frozen=True)
class GridParams:
    """Fixed values of the reference's microgrid (kW, kWh, Hz, hours)."""

    dt_hours: float = 1.0 / 30.0          # 2-minute step
    nominal_hz: float = 50.0
    freq_min: float = 49.5
    freq_max: float = 50.5
    s_base_kw: float = 2000.0
    battery_kwh: float = 10000.0
    battery_kw: float = 7000.0
    efficiency: float = 0.95
    soc_min: float = 0.1
    soc_max: float = 0.9
    soc_initial: float = 0.5
    soc_target: float = 0.5
    thermal_kw: float = 5000.0
    thermal_ramp_kw_per_min: float = 50.0
    k_inertia: float = 4000.0
    k_droop: float = 6000.0
    k_i_agc: float = 5.0
    k_aw: float = 0.5
    integral_limit: float = 5000.0
    k_soc: float = 1000.0
    ace_beta: float = 20.0
    ma_window: int = 12
    load_factor: float = 1.70
    load_swing: float = 0.25
    load_floor_kw: float = 800.0
    load_noise_kw: float = 40.0

    @property
    def dt_seconds(self) -> float:
        return self.dt_hours * 3600.0

    @property
    def ramp_per_step(self) -> float:
        return self.thermal_ramp_kw_per_min * self.dt_hours * 60.0


PARAMS = GridParams()


def load_profile(df: DataFrame, renewable: str = "p_renewable", p: GridParams = PARAMS,
                 spec: SeriesSpec = DEFAULT_SPEC, noise_seed: int | None = None) -> DataFrame:
    """SC17: ``hours = (i * dt) % 24``; load = 1.7 * mean(renewable) *
    (1 + 0.25 sin(2 pi (h - 6) / 24)) [+ N(0, 40)], floored at 800 kW.
    ``noise_seed=None`` turns the noise off; with a seed it depends on the seed, the key
    and the position alone."""
    numbered = number_rows(df, spec)
    means = numbered.groupBy(*spec.key).agg(F.avg(renewable).alias("_mean_ren"))
    j = join_small(numbered, means, list(spec.key), "left", name="renewable_mean")
    hours = (F.col("rn").cast("double") * F.lit(p.dt_hours)) % F.lit(24.0)
    daily = F.lit(1.0) + F.lit(p.load_swing) * F.sin(F.lit(2.0 * math.pi) * (F.col("hours") - F.lit(6.0))
                                                   / F.lit(24.0))
    load = F.lit(p.load_factor) * F.col("_mean_ren") * daily
    if noise_seed is not None:
        load = load + counter_normal(noise_seed, "load", *spec.key, "rn") * F.lit(p.load_noise_kw)
    return (j.withColumn("hours", hours)
             .withColumn("p_load_profile", F.greatest(load, F.lit(p.load_floor_kw)))
             .drop("_mean_ren"))


def battery_sizing(df: DataFrame, renewable: str = "p_renewable", load: str = "p_load",
                   p: GridParams = PARAMS, key=("site_id",)) -> DataFrame:
    """AGG19: required power = 2 * population std of (renewable - load)."""
    g = df.groupBy(*key).agg(F.stddev_pop(F.col(renewable) - F.col(load)).alias("imbalance_std_kw"))
    req = F.lit(2.0) * F.col("imbalance_std_kw")
    return (g.withColumn("required_kw", req)
             .withColumn("rated_kw", F.lit(p.battery_kw))
             .withColumn("adequate", F.lit(p.battery_kw) >= req)
             .withColumn("shortfall_kw", F.greatest(req - F.lit(p.battery_kw), F.lit(0.0))))


def dispatch_setpoint(df: DataFrame, renewable: str = "p_renewable", load: str = "p_load",
                      p: GridParams = PARAMS, spec: SeriesSpec = DEFAULT_SPEC) -> DataFrame:
    """WIN9: ``max(0, load - mean(last 12 renewable values))`` (shorter at the
    start of a series)."""
    def cols(w):
        ma = F.avg(renewable).over(w.rowsBetween(-(p.ma_window - 1), 0))
        return {"renewable_ma": ma}
    out = windowed(df, cols, halo=p.ma_window - 1, spec=spec)
    return out.withColumn("thermal_setpoint",
                          F.greatest(F.lit(0.0), F.col(load) - F.col("renewable_ma")))


def control_terms(df: DataFrame, freq: str = "frequency", soc: str = "soc", p: GridParams = PARAMS,
                  spec: SeriesSpec = DEFAULT_SPEC) -> DataFrame:
    """WIN10 + SC18-SC21 on telemetry rows.

    RoCoF uses the previous frequency of the series (nominal 50 Hz before the
    first row) over the fixed step; the battery command is the VSM term plus
    the SOC term, clamped by the power available at the row's SOC."""
    def cols(w):
        prev = F.lag(freq, 1, p.nominal_hz).over(w)
        return {"_prev_f": prev}
    d = windowed(df, cols, halo=1, spec=spec)
    dts = F.lit(p.dt_seconds)
    dev = F.col(freq) - F.lit(p.nominal_hz)
    d = (d.withColumn("rocof", F.when(dts > 0, (F.col(freq) - F.col("_prev_f")) / dts).otherwise(F.lit(0.0)))
          .drop("_prev_f")
          .withColumn("is_stable", F.col(freq).between(p.freq_min, p.freq_max))
          .withColumn("p_inertia", F.lit(-p.k_inertia) * F.col("rocof"))
          .withColumn("p_droop", F.lit(-p.k_droop) * dev)
          .withColumn("p_vsm", F.col("p_inertia") + F.col("p_droop"))
          .withColumn("ace", F.lit(p.ace_beta) * dev)
          .withColumn("p_soc", F.lit(p.k_soc) * (F.col(soc) - F.lit(p.soc_target)))
          .withColumn("avail_discharge_kw", F.when(F.col(soc) > p.soc_min, F.lit(p.battery_kw)).otherwise(F.lit(0.0)))
          .withColumn("avail_charge_kw", F.when(F.col(soc) < p.soc_max, F.lit(p.battery_kw)).otherwise(F.lit(0.0)))
          .withColumn("p_command", F.col("p_vsm") + F.col("p_soc"))
          .withColumn("p_actual", F.when(F.col("p_command") > 0,
                                         F.least(F.col("p_command"), F.col("avail_discharge_kw")))
                                   .otherwise(F.greatest(F.col("p_command"), -F.col("avail_charge_kw")))))
    cols_present = set(df.columns)
    if {"p_renewable", "p_thermal", "p_battery", "p_load"} <= cols_present:
        d = (d.withColumn("p_total_gen", F.col("p_renewable") + F.col("p_thermal") + F.col("p_battery"))
              .withColumn("imbalance_pu", (F.col("p_total_gen") - F.col("p_load")) / F.lit(p.s_base_kw))
              .withColumn("thermal_ramp_margin", F.lit(p.thermal_kw) - F.col("p_thermal")))
    return d


def telemetry_kpis(terms: DataFrame, p: GridParams = PARAMS, key=("site_id",)) -> DataFrame:
    """AGG17: frequency, battery, thermal, ACE, RoCoF and control-term KPIs."""
    aggs = [
        F.avg("frequency").alias("frequency_mean_hz"),
        F.stddev_samp("frequency").alias("frequency_std_hz"),
        F.min("frequency").alias("frequency_min_hz"),
        F.max("frequency").alias("frequency_max_hz"),
        F.avg(F.col("is_stable").cast("double")).alias("stability_rate"),
        F.avg("soc").alias("battery_soc_mean"),
        F.stddev_samp("soc").alias("battery_soc_std"),
        F.avg(F.abs("p_battery")).alias("battery_power_mean"),
        F.max(F.abs("p_battery")).alias("battery_power_max"),
        F.avg("p_thermal").alias("thermal_power_mean"),
        (F.avg("p_thermal") / F.lit(p.thermal_kw)).alias("thermal_utilization"),
        F.avg(F.abs("ace")).alias("ace_mean_kw"),
        F.max(F.abs("ace")).alias("ace_max_kw"),
        F.avg(F.abs("rocof")).alias("rocof_mean"),
        F.max(F.abs("rocof")).alias("rocof_max"),
        F.avg(F.abs("p_vsm")).alias("p_vsm_mean"),
        F.avg(F.abs("p_soc")).alias("p_soc_mean"),
    ]
    if "p_agc" in terms.columns:
        aggs.append(F.avg(F.abs("p_agc")).alias("p_agc_mean"))
    return terms.groupBy(*key).agg(*aggs)


def kpi_gate(kpis: DataFrame, p: GridParams = PARAMS) -> DataFrame:
    """AGG18: four targets; 'operational' when at least three are met."""
    met = (F.col("frequency_mean_hz").between(p.freq_min, p.freq_max).cast("int")
           + (F.col("stability_rate") > 0.95).cast("int")
           + (F.col("battery_soc_mean") * 100).between(45, 55).cast("int")
           + (F.col("ace_mean_kw") < 300).cast("int"))
    return (kpis.withColumn("targets_met", met)
                .withColumn("operational", F.col("targets_met") >= 3))

