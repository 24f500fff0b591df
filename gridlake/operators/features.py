"""Feature engineering (SC1-SC16, WIN1-WIN3).

Lineage A works on the merged solar x wind table; lineage B on each
de-duplicated source.  All window features of one table share one
(site_id, chunk) window ordered by ``rn``, so Spark evaluates them in a
single sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlake.functions import exprs as X
from gridlake.plans.sequence import DEFAULT_SPEC, SeriesSpec, windowed

# The merged (lineage A) table is unique per (site_id, ts): time alone orders it.
MERGED_SPEC = SeriesSpec(order=("ts",))

# Lineage A lags 1, 2, 3, 6, 12, 24 rows and a 6-row rolling
# window (named "_6h"); lineage B PV lags 1 and 3, wind lag 1, 3-row rolling.
LAGS_A = (1, 2, 3, 6, 12, 24)
ROLL_A = 6
LAGS_PV_B = (1, 3)
LAGS_WIND_B = (1,)
ROLL_B = 3


def calendar_a(df: DataFrame, ts: str = "ts") -> DataFrame:
    """SC1 + SC3: day_of_week (Mon=0), day_of_year, month, ISO week, hour,
    cyclic hour (24) and day-of-year (365) encodings."""
    out = df
    if "hour" not in df.columns:
        out = out.withColumn("hour", F.hour(ts))
    out = (out.withColumn("day_of_week", X.weekday(ts))
              .withColumn("day_of_year", F.dayofyear(ts))
              .withColumn("month", F.month(ts))
              .withColumn("week_of_year", F.weekofyear(ts)))
    hs, hc = X.cyclic("hour", 24)
    ds, dc = X.cyclic("day_of_year", X.DAYS_PER_YEAR)
    return (out.withColumn("hour_sin", hs).withColumn("hour_cos", hc)
               .withColumn("day_sin", ds).withColumn("day_cos", dc))


def calendar_b(df: DataFrame, ts: str = "ts") -> DataFrame:
    """SC2 + SC3: hour, day, month, weekday, is_weekend, sin/cos hour."""
    out = (df.withColumn("hour", F.hour(ts))
             .withColumn("day", F.dayofmonth(ts))
             .withColumn("month", F.month(ts))
             .withColumn("weekday", X.weekday(ts))
             .withColumn("is_weekend", X.is_weekend(ts)))
    hs, hc = X.cyclic("hour", 24)
    return out.withColumn("sin_hour", hs).withColumn("cos_hour", hc)


def physics_a(df: DataFrame, ghi="ghi", pv="pv_kw", rho="air_density", v="wind_speed",
              wind="wind_kw", strict: bool = False) -> DataFrame:
    """SC4, SC5, SC8, SC9 on the merged table."""
    if "hour" not in df.columns:
        df = df.withColumn("hour", F.hour("ts"))
    return (df.withColumn("clearness_index_kt", X.clearness_index(ghi, "hour", strict))
              .withColumn("wind_power_coefficient_cp", X.power_coefficient(wind, rho, v))
              .withColumn("solar_efficiency", X.solar_efficiency(pv, ghi))
              .withColumn("wind_power_per_speed", X.wind_power_per_speed(wind, v)))


def temporal_a(df: DataFrame, solar="pv_kw", wind="wind_kw", total="total_renewable_power",
               spec: SeriesSpec = MERGED_SPEC) -> DataFrame:
    """WIN1-WIN3 (lineage A): lags, 6-row rolling mean/std (min 1 value),
    first differences and their absolute values."""
    def cols(w):
        out = {}
        for name, c in (("solar", solar), ("wind", wind)):
            for k in LAGS_A:
                out[f"{name}_lag_{k}"] = F.lag(c, k).over(w)
        frame = w.rowsBetween(-(ROLL_A - 1), 0)
        for name, c in (("solar", solar), ("wind", wind)):
            out[f"{name}_rolling_mean_6h"] = F.avg(c).over(frame)
            out[f"{name}_rolling_std_6h"] = F.stddev_samp(c).over(frame)
        for name, c in (("solar", solar), ("wind", wind), ("total", total)):
            d = F.col(c) - F.lag(c, 1).over(w)
            out[f"{name}_rate_of_change"] = d
            out[f"{name}_volatility"] = F.abs(d)
        return out
    return windowed(df, cols, halo=max(LAGS_A), spec=spec)


def engineered_a(merged: DataFrame, spec: SeriesSpec = MERGED_SPEC, strict: bool = False) -> DataFrame:
    """Lineage A feature table: physics, calendar and temporal features."""
    return temporal_a(calendar_a(physics_a(merged, strict=strict)), spec=spec)


def pv_features_b(df: DataFrame, spec: SeriesSpec = DEFAULT_SPEC, ghi="ghi", upper="upper_rad",
                  temp="temp_c", pv="pv_kw") -> DataFrame:
    """Lineage B PV features (SC2, SC10-SC12, SC15, WIN1-WIN3)."""
    d = (calendar_b(df)
         .withColumn("radiation_ratio", X.ratio(ghi, upper))
         .withColumn("temp_squared", X.square(temp))
         .withColumn("temp_derating", X.floor_at(F.col(temp) - F.lit(25.0), 0.0))
         .withColumn("pv_per_wm2", X.ratio(pv, ghi))
         .withColumn("pv_efficiency", X.clip("pv_per_wm2", 0.0, 0.3)))

    def cols(w):
        frame = w.rowsBetween(-(ROLL_B - 1), 0)
        out = {"radiation_change": F.col(ghi) - F.lag(ghi, 1).over(w)}
        for k in LAGS_PV_B:
            out[f"pv_lag_{k}"] = F.lag(pv, k).over(w)
        out["pv_roll_mean_3"] = F.avg(pv).over(frame)
        out["pv_roll_std_3"] = F.stddev_samp(pv).over(frame)
        out["pv_ramp_rate"] = F.col(pv) - F.lag(pv, 1).over(w)
        return out
    return windowed(d, cols, halo=max(max(LAGS_PV_B), ROLL_B - 1), spec=spec)


def wind_features_b(df: DataFrame, spec: SeriesSpec = DEFAULT_SPEC, v="wind_speed",
                    rho="air_density", power="wind_kw") -> DataFrame:
    """Lineage B wind features (SC2, SC10, SC13, SC14, WIN1-WIN3)."""
    d = (calendar_b(df)
         .withColumn("wind_speed_cubed", X.cube(v))
         .withColumn("wind_power_density", X.wind_power_density(rho, v))
         .withColumn("power_per_ws", X.ratio(power, v)))

    def cols(w):
        frame = w.rowsBetween(-(ROLL_B - 1), 0)
        out = {f"wind_lag_{k}": F.lag(power, k).over(w) for k in LAGS_WIND_B}
        out["wind_roll_mean_3"] = F.avg(power).over(frame)
        out["wind_roll_std_3"] = F.stddev_samp(power).over(frame)
        out["wind_ramp"] = F.col(power) - F.lag(power, 1).over(w)
        return out
    out = windowed(d, cols, halo=max(max(LAGS_WIND_B), ROLL_B - 1), spec=spec)
    return out.withColumn("turbulence_intensity", X.ratio("wind_roll_std_3", "wind_roll_mean_3"))
