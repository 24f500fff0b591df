"""Aggregations and data profiles (AGG1-AGG14, AGG16).

Every per-column statistic is computed in one aggregate pass and turned into
rows with ``unpivot``; grouping is by ``site_id`` so partial aggregation
combines hot sites map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import NumericType, StringType

from gridlake.functions.exprs import micros_between
from gridlake.plans.grouping import modal_values, quantiles, top_k_per_key
from gridlake.plans.sequence import DEFAULT_SPEC, SeriesSpec, windowed


def struct_rows(wide: DataFrame, key, cols: list[str], name: str = "column") -> DataFrame:
    """One row per (key, struct column), the struct's fields as columns.

    ``inline`` over an array of structs: one Generate over the aggregate,
    evaluated once.  (``unpivot`` of struct columns trips a code-generation
    bug -- subexpression elimination inside Expand -- and a union of
    projections would evaluate the aggregate once per column.)"""
    fields = wide.schema[cols[0]].dataType.fieldNames()
    items = [F.struct(F.lit(c).alias(name), *[F.col(f"{c}.{f}").alias(f) for f in fields])
             for c in cols]
    return wide.select(*key, F.inline(F.array(*items)))


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def generation_summary(merged: DataFrame, solar_col="pv_kw", wind_col="wind_kw",
                       key=("site_id",)) -> DataFrame:
    """AGG16: count, per-source and total mean / max, mean complementarity."""
    total = F.col(solar_col) + F.col(wind_col)
    return merged.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.avg(solar_col).alias("solar_mean_kw"),
        F.avg(wind_col).alias("wind_mean_kw"),
        F.avg(total).alias("total_mean_kw"),
        F.max(solar_col).alias("solar_max_kw"),
        F.max(wind_col).alias("wind_max_kw"),
        F.max(total).alias("total_max_kw"),
        F.avg("complementarity_index").alias("complementarity_index"),
    )


def signature_sets(df: DataFrame, power_col: str, key=("site_id",), ts="ts") -> DataFrame:
    """AGG1: hourly mean/std/max, day-of-year mean/std and overall mean/std
    in one pass with GROUPING SETS."""
    d = df.select(*key, F.hour(ts).alias("hour"), F.dayofyear(ts).alias("day_of_year"),
                  F.col(power_col).alias("_p"))
    k = list(key)
    g = d.groupingSets([k + ["hour"], k + ["day_of_year"], k], *k, "hour", "day_of_year").agg(
        F.avg("_p").alias("mean"), F.stddev_samp("_p").alias("std"), F.max("_p").alias("max"),
        F.grouping_id().alias("_gid"))
    return g.select(*k, F.when(F.col("_gid") == 1, "hourly").when(F.col("_gid") == 2, "daily")
                    .otherwise("overall").alias("level"), "hour", "day_of_year",
                    "mean", "std", F.when(F.col("_gid") == 1, F.col("max")).alias("max"))


def missing_counts(df: DataFrame, cols: list[str], key=("site_id",)) -> DataFrame:
    """AGG2: NULL count per column and key, as rows (key, column, n_missing)."""
    wide = df.groupBy(*key).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot(list(key), cols, "column", "n_missing")


def top_missing(df: DataFrame, cols: list[str], k: int = 5, key=("site_id",)) -> DataFrame:
    """AGG2 + SRT2: the ``k`` columns with most NULLs per key (ties by name)."""
    rows = missing_counts(df, cols, key)
    w = Window.partitionBy(*key).orderBy(F.desc("n_missing"), F.asc("column"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def step_seconds(df: DataFrame, spec: SeriesSpec = DEFAULT_SPEC, ts="ts") -> DataFrame:
    """WIN7: seconds since the previous row of the key (NULL on the first)."""
    def cols(w):
        prev = F.lag(F.col(ts), 1).over(w)
        return {"step_s": micros_between(prev, F.col(ts)).cast("double") / F.lit(1e6)}
    return windowed(df, cols, halo=1, spec=spec)


def quality_report(df: DataFrame, measure_cols: list[str], power_cols: list[str],
                   spec: SeriesSpec = DEFAULT_SPEC, ts="ts", ignore=("row_id",)) -> DataFrame:
    """AGG2-4, AGG6-7, FLT7 as one row per key."""
    key = list(spec.key)
    stepped = step_seconds(df, spec, ts)
    content = [c for c in df.columns if c not in ignore]
    modal = (modal_values(stepped, key, ["step_s"], all_keys=False)
             .withColumnRenamed("step_s", "modal_step_s"))
    distinct_ts = (df.where(F.col(ts).isNotNull()).groupBy(*key, ts).agg(F.lit(1).alias("_one"))
                     .groupBy(*key).agg(F.count(F.lit(1)).alias("_distinct_ts")))
    base = (stepped.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in measure_cols],
        F.count_if(F.col(ts).isNull()).alias("_null_ts"),
        *[F.min(c).alias(f"min_{c}") for c in power_cols],
        *[F.max(c).alias(f"max_{c}") for c in power_cols],
    ).join(modal, key, "left").join(distinct_ts, key, "left")
       .fillna({"_distinct_ts": 0}))
    # steps that differ from the modal step
    gaps = (stepped.join(base.select(*key, "modal_step_s"), key, "inner")
                   .groupBy(*key)
                   .agg(F.count_if(F.col("step_s").isNotNull()
                                   & (F.col("step_s") != F.col("modal_step_s"))).alias("n_gaps")))
    # full-row duplicates (NULL equals NULL, as pandas duplicated())
    dups = (df.groupBy(*content).agg(F.count(F.lit(1)).alias("_c"))
              .groupBy(*key).agg(F.sum(F.col("_c") - 1).cast("bigint").alias("duplicate_rows")))
    out = (base.join(gaps, key, "left").join(dups, key, "left")
               .withColumn("duplicate_ts",
                           F.col("n_rows") - F.col("_distinct_ts")
                           - F.when(F.col("_null_ts") > 0, F.col("_null_ts") - 1).otherwise(0))
               .drop("_distinct_ts", "_null_ts"))
    for c in power_cols:
        out = out.withColumn(f"negative_{c}", F.col(f"min_{c}") < 0)
    return out


def step_histogram(df: DataFrame, spec: SeriesSpec = DEFAULT_SPEC, k: int = 5, ts="ts") -> DataFrame:
    """AGG5: the ``k`` most frequent steps per key (ties: shorter step)."""
    key = list(spec.key)
    counts = (step_seconds(df, spec, ts).where(F.col("step_s").isNotNull())
              .groupBy(*key, "step_s").agg(F.count(F.lit(1)).alias("n")))
    return top_k_per_key(counts, key, [F.desc("n"), F.asc("step_s")], k, F.col("step_s"))


def column_stats(df: DataFrame, cols: list[str], key=("site_id",),
                 exact: bool = True) -> DataFrame:
    """AGG7, AGG8, AGG9, AGG11-13 for many columns in one aggregate, as rows
    (key, column, n, n_missing, n_infinite, n_zero, min, max, mean, std, median).
    Medians are exact unless ``exact=False`` asks for approximate ones."""
    inf = F.lit(float("inf"))
    aggs = []
    medians = quantiles(df, key, {f"_{c}__med": (F.when(F.abs(F.col(c).cast("double")) != inf, F.col(c).cast("double")), [0.5])
                                  for c in cols}, exact)
    for c in cols:
        x = F.col(c).cast("double")
        finite = F.when(F.abs(x) != inf, x)
        aggs.append(F.struct(
            F.count(x).alias("n"),
            F.count_if(x.isNull()).alias("n_missing"),
            F.count_if(F.abs(x) == inf).alias("n_infinite"),
            F.count_if(x == 0).alias("n_zero"),
            F.min(finite).alias("min"), F.max(finite).alias("max"),
            F.avg(finite).alias("mean"), F.stddev_samp(finite).alias("std"),
        ).alias(c))
    wide = df.groupBy(*key).agg(*aggs).join(medians, list(key), "left")
    return struct_rows(wide.select(*key, *[F.col(c).withField("median", F.col(f"_{c}__med")[0]).alias(c) for c in cols]),
                       list(key), cols)


def pearson(x: str, y: str):
    """Pearson r over rows where both are present; NULL when either side has
    zero variance (Spark's ``corr`` raises there under ANSI mode)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xv = F.when(both, F.col(x).cast("double"))
    yv = F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(xv, yv), F.stddev_pop(xv) * F.stddev_pop(yv))


def correlation_top(df: DataFrame, features: list[str], target: str, k: int = 6,
                    key=("site_id",), digits: int = 6) -> DataFrame:
    """AGG14: |Pearson r| of each feature (and the target itself) with the
    target; the ``k`` largest per key.  Values equal to ``digits`` decimals
    tie and are ordered by feature name."""
    from gridlake.plans.registry import round_half_away

    cols = list(dict.fromkeys(features + [target]))
    wide = df.groupBy(*key).agg(*[pearson(c, target).alias(c) for c in cols])
    long = wide.unpivot(list(key), cols, "feature", "r").withColumn("abs_corr", F.abs("r"))
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(round_half_away("abs_corr", digits)),
                                         F.asc("feature"))
    return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .drop("r"))


def text_modes(df: DataFrame, cols: list[str], key=("site_id",)) -> DataFrame:
    """AGG10: most frequent value per text column (lowest on ties, '' if none)."""
    return modal_values(df, key, cols, default="")
