"""Preparing feature tables for models: imputation, scaling, column selection.

Operators: ML1 (imputation policy by column-name rule), ML2 (standard scaling
with population std), ML3 (scaling fitted on training rows only, inverse
transform), PRJ8 (drop leakage columns), PRJ9-PRJ13 (feature / target
selection, by dtype, fixed lists, assembler order), AGG8 (infinite values),
WIN6 (ffill + bfill for temporal columns).

Statistics are one aggregate per key, broadcast after a size check, and
applied with ``coalesce`` / arithmetic: the table is read twice, never
collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from gridlake.operators.clean import ffill_bfill
from gridlake.plans.grouping import exact_quantiles, modal_values
from gridlake.plans.materialize import join_small
from gridlake.plans.sequence import SeriesSpec, spec_of

# Fixed keyword lists of the reference's imputation policy and leakage filter.
TEMPORAL_KEYWORDS = ("lag", "roll", "diff", "ramp")
PV_RATIO_KEYWORDS = ("efficiency", "per_wm2", "ratio", "per_")
WIND_RATIO_KEYWORDS = ("turbulence", "intensity", "per_ws", "density")
MERGED_RATIO_KEYWORDS = ("efficiency", "ratio", "per_", "intensity")
LEAKAGE_KEYWORDS = ("lag", "roll", "ramp")
PV_LEAKAGE = ("pv_roll_mean_3", "pv_roll_std_3", "pv_lag_1", "pv_lag_3", "pv_ramp_rate")
WIND_LEAKAGE = ("wind_roll_mean_3", "wind_roll_std_3", "wind_lag_1", "wind_lag_3", "wind_ramp")

KEY_COLUMNS = ("site_id", "row_id", "row_id_solar", "row_id_pv", "row_id_wind", "rn", "ts")


@dataclass(frozen=True)
class ImputePolicy:
    temporal: tuple[str, ...] = TEMPORAL_KEYWORDS
    ratio: tuple[str, ...] = PV_RATIO_KEYWORDS
    exclude: tuple[str, ...] = KEY_COLUMNS


PV_POLICY = ImputePolicy()
WIND_POLICY = ImputePolicy(ratio=WIND_RATIO_KEYWORDS)
MERGED_POLICY = ImputePolicy(ratio=MERGED_RATIO_KEYWORDS)


def _has(name: str, words) -> bool:
    n = name.lower()
    return any(w in n for w in words)


def numeric_cols(df: DataFrame, exclude=()) -> list[str]:
    """PRJ11: numeric columns by dtype."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def text_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRJ11: leftover text features become numbers (unparsable -> NULL)."""
    return df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def plan_imputation(df: DataFrame, policy: ImputePolicy = PV_POLICY) -> dict[str, list[str]]:
    """Which rule fills which column (metadata only)."""
    nums = numeric_cols(df, policy.exclude)
    temporal = [c for c in nums if _has(c, policy.temporal)]
    ratio = [c for c in nums if c not in temporal and _has(c, policy.ratio)]
    rest = [c for c in nums if c not in temporal and c not in ratio]
    return {"temporal": temporal, "ratio": ratio, "median": rest,
            "mode": text_cols(df, policy.exclude)}


def impute(df: DataFrame, policy: ImputePolicy = PV_POLICY, spec: SeriesSpec | None = None) -> DataFrame:
    """ML1: temporal columns -> forward then backward fill along the series;
    every other numeric column -> its median per key (infinite values count
    as missing, AGG8); text columns -> most frequent value ('' if none)."""
    spec = spec_of(df, spec)
    plan = plan_imputation(df, policy)
    key = list(spec.key)
    out = ffill_bfill(df, plan["temporal"], spec) if plan["temporal"] else df
    med_cols = plan["ratio"] + plan["median"]
    inf = F.lit(float("inf"))

    def finite(c):
        return F.when(F.abs(F.col(c).cast("double")) != inf, F.col(c).cast("double"))

    stats = out.select(*key).distinct()
    if med_cols:
        medians = exact_quantiles(out, key, {f"{c}__med": (finite(c), [0.5]) for c in med_cols})
        stats = stats.join(medians.select(*key, *[F.col(f"{c}__med")[0].alias(f"{c}__med") for c in med_cols]), key, "left")
    if plan["mode"]:
        modes = modal_values(out, key, plan["mode"], default="")
        stats = stats.join(modes.select(*key, *[F.col(c).alias(f"{c}__mode") for c in plan["mode"]]),
                           key, "left")
    j = join_small(out, stats, key, "left", name="impute_stats")
    sel = []
    for c in out.columns:
        if c in med_cols:
            x, med = F.col(c), F.col(f"{c}__med")
            dtype = df.schema[c].dataType
            if dtype.typeName() in ("double", "float"):
                sel.append(F.when(x.isNull() | (F.abs(x) == inf), med).otherwise(x).alias(c))
            else:  # integral columns keep their type
                sel.append(F.coalesce(x, med.cast(dtype)).alias(c))
        elif c in plan["mode"]:
            sel.append(F.coalesce(F.col(c), F.col(f"{c}__mode")).alias(c))
        else:
            sel.append(F.col(c))
    return j.select(*sel)


def infinite_counts(df: DataFrame, key=("site_id",), exclude=KEY_COLUMNS) -> DataFrame:
    """AGG8: number of +-inf cells per key."""
    cols = numeric_cols(df, exclude)
    inf = F.lit(float("inf"))
    total = sum((F.count_if(F.abs(F.col(c).cast("double")) == inf) for c in cols), F.lit(0))
    return df.groupBy(*key).agg(total.cast("bigint").alias("n_infinite"))


def drop_leakage(df: DataFrame, keywords=LEAKAGE_KEYWORDS, explicit=()) -> DataFrame:
    """PRJ8: drop columns named like a lag / rolling / ramp feature, or listed."""
    drop = [c for c in df.columns if _has(c, keywords) or c in explicit]
    return df.drop(*drop)


def feature_columns(df: DataFrame, targets, exclude=KEY_COLUMNS) -> list[str]:
    """PRJ9 / PRJ10: every numeric column except keys, timestamp and targets,
    in table order (the assembler input order, PRJ13)."""
    return [c for c in numeric_cols(df, exclude) if c not in targets]


def select_features(df: DataFrame, fixed, patterns=(), targets=()) -> list[str]:
    """PRJ10: the fixed names that are present, in their order, then every other numeric
    column whose name contains one of ``patterns``."""
    numeric = numeric_cols(df, KEY_COLUMNS)
    chosen = [c for c in fixed if c in numeric and c not in targets]
    return chosen + [c for c in numeric if c not in chosen and c not in targets and _has(c, patterns)]


def scaling_stats(df: DataFrame, cols: list[str], key=("site_id",), fit_on=None) -> DataFrame:
    """Mean and population std per key, optionally over ``fit_on`` rows only (ML3)."""
    src = df if fit_on is None else df.where(fit_on)
    return src.groupBy(*key).agg(
        *[F.avg(F.col(c).cast("double")).alias(f"{c}__mu") for c in cols],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__sd") for c in cols])


def _scale(c: str):
    sd = F.col(f"{c}__sd")
    # StandardScaler keeps zero-variance columns unscaled (scale 1).
    den = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return (F.col(c).cast("double") - F.col(f"{c}__mu")) / den


def standardize(df: DataFrame, cols: list[str], key=("site_id",), fit_on=None) -> DataFrame:
    """ML2 / ML3: ``(x - mean) / std_pop`` per key."""
    stats = scaling_stats(df, cols, key, fit_on)
    j = join_small(df, stats, list(key), "left", name="scaling")
    return j.select(*[(_scale(c).alias(c) if c in cols else F.col(c)) for c in df.columns])


def unscale(df: DataFrame, stats: DataFrame, col: str, source: str, key=("site_id",)) -> DataFrame:
    """ML3 inverse transform: ``z * std + mean`` with the stats of ``source``."""
    s = stats.select(*key, F.col(f"{source}__mu").alias("_mu"), F.col(f"{source}__sd").alias("_sd"))
    j = join_small(df, s, list(key), "left", name="unscale")
    sd = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    return j.withColumn(col, F.col(col) * sd + F.col("_mu")).drop("_mu", "_sd")
