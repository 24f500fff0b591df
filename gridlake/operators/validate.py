"""Validation rules (FLT5, FLT6, FLT7, PRJ6, SC16) and the grid alignment (JN3).

A rule is a named boolean expression that is TRUE for a violating row; NULL
inputs count as violations for the "all values >= 0" rules, as
``(series >= 0).all()`` is False when a value is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridlake.functions.exprs import micros_between


def _not_true(cond: Column) -> Column:
    return ~F.coalesce(cond, F.lit(False))


def solar_rules(ghi="ghi", upper="upper_rad", pv="pv_kw") -> dict[str, Column]:
    """FLT5 + SC16 (validation-time efficiency ``ghi > 0 ? pv / ghi : 0``)."""
    eff = F.when(F.col(ghi) > 0, F.col(pv) / F.col(ghi)).otherwise(F.lit(0.0))
    return {
        "ghi_negative": _not_true(F.col(ghi) >= 0),
        "upper_negative": _not_true(F.col(upper) >= 0),
        "night_generation": F.coalesce((F.col(ghi) == 0) & (F.col(pv) > 0), F.lit(False)),
        "efficiency_above_1": F.coalesce(eff > 1, F.lit(False)),
    }


def wind_rules(speed="wind_speed", density="air_density", power="wind_kw") -> dict[str, Column]:
    """FLT6: physical ranges and extreme values."""
    return {
        "speed_negative": _not_true(F.col(speed) >= 0),
        "density_not_positive": _not_true(F.col(density) > 0),
        "power_negative": _not_true(F.col(power) >= 0),
        "speed_above_50": F.coalesce(F.col(speed) > 50, F.lit(False)),
        "density_below_0_5": F.coalesce(F.col(density) < 0.5, F.lit(False)),
    }


def rule_counts(df: DataFrame, rules: dict[str, Column], key=("site_id",)) -> DataFrame:
    """Violations per key and rule in one aggregate, as rows (key, rule, n)."""
    wide = df.groupBy(*key).agg(*[F.count_if(r).alias(n) for n, r in rules.items()])
    return wide.unpivot(list(key), list(rules), "rule", "violations")


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking at least one rule, with the names of the broken rules."""
    names = F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]))
    return df.withColumn("broken_rules", names).where(F.size("broken_rules") > 0)


def parse_report(df: DataFrame, raw: str, parsed: str, key=("site_id",)) -> DataFrame:
    """PRJ6: unparsable timestamps per key (raw present, parsed NULL) and all
    missing ones."""
    return df.groupBy(*key).agg(
        F.count_if(F.col(raw).isNotNull() & F.col(parsed).isNull()).alias("n_invalid"),
        F.count_if(F.col(parsed).isNull()).alias("n_missing"))


# --- alignment ----------------------------------------------------------------

BLOCK = 1024  # grid points generated per task-sized block


def time_grid(ranges: DataFrame, step_minutes: int = 15, key=("site_id",),
              start="common_start", end="common_end") -> DataFrame:
    """Every ``start + k * step`` up to ``end`` (inclusive) per key.

    Generated in two levels -- blocks, then points inside a block, with a
    repartition in between -- so a long range is spread over many tasks
    instead of being exploded by one."""
    step_us = step_minutes * 60 * 1_000_000
    n = F.floor(micros_between(start, end) / F.lit(step_us)).cast("bigint")
    blocks = (ranges.where(F.col(start) <= F.col(end))
                    .select(*key, F.col(start).alias("_start"), n.alias("_n"))
                    .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                               F.floor(F.col("_n") / BLOCK).cast("bigint"))))
                    .repartition(*key, "_block"))
    lo = F.col("_block") * BLOCK
    hi = F.least(F.col("_n"), lo + BLOCK - 1)
    pts = blocks.withColumn("_k", F.explode(F.sequence(lo, hi)))
    return pts.select(*key, F.expr(f"_start + _k * INTERVAL '{step_minutes}' MINUTE").alias("ts"))


def align(frames: dict[str, DataFrame], ranges: DataFrame, step_minutes: int = 15,
          key=("site_id",)) -> DataFrame:
    """JN3: left join every (de-duplicated) frame onto the common grid by
    exact timestamp equality (a reindex, not a resample)."""
    grid = time_grid(ranges, step_minutes, key)
    out = grid
    for name, f in frames.items():
        cols = [c for c in f.columns if c not in (*key, "ts")]
        side = f.select(*key, "ts", *[F.col(c).alias(f"{c}_{name}") for c in cols])
        out = out.join(side, [*key, "ts"], "left")
    return out
