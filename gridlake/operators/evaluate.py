"""Time-ordered splits and regression metrics (WIN11, WIN12, ML6, ML7, ML8, JN5).

Splits are decided per row from its position ``rn`` and the series length of
its key -- no shuffling of rows, no driver loop over folds.  Metrics are one
aggregate per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridlake.plans.materialize import join_small
from gridlake.plans.sequence import SeriesSpec, number_rows, series_counts, spec_of

# Fixed split parameters of the reference: last 20 % held out (test size is
# ceil(0.2 n)); a 70 / 30 chronological split (int(0.7 n) training rows);
# TimeSeriesSplit with 5 folds (test size n // 6).
HOLDOUT_FRACTION = 0.2
STRESS_TRAIN_FRACTION = 0.7
N_FOLDS = 5


def with_lengths(df: DataFrame, spec: SeriesSpec | None = None) -> DataFrame:
    """Position ``rn`` and length ``n_rows`` of the series as it is now: a number that came
    along may have gaps after a filter, so rows are always numbered here."""
    spec = spec_of(df, spec)
    numbered = number_rows(df, spec)
    return join_small(numbered, series_counts(numbered, spec), list(spec.key), "left",
                      name="lengths")


def chrono_split(df: DataFrame, spec: SeriesSpec | None = None) -> DataFrame:
    """WIN11: ``holdout_role`` (last ceil(0.2 n) rows are 'test') and
    ``stress_role`` (first int(0.7 n) rows are 'train')."""
    d = with_lengths(df, spec)
    n = F.col("n_rows")
    test_size = F.ceil(F.lit(HOLDOUT_FRACTION) * n.cast("double"))
    train_70 = F.floor(F.lit(STRESS_TRAIN_FRACTION) * n.cast("double"))
    return (d.withColumn("holdout_role", F.when(F.col("rn") >= n - test_size, "test").otherwise("train"))
             .withColumn("stress_role", F.when(F.col("rn") < train_70, "train").otherwise("test")))


def fold_role(fold: Column, n_splits: int = N_FOLDS) -> Column:
    """The part of a row (``rn`` of ``n_rows``) in a fold: ``test``, ``train`` or none.  A
    fold is two ranges of positions, so it needs no copy of the rows."""
    n = F.col("n_rows")
    t = F.floor(n / F.lit(n_splits + 1)).cast("bigint")
    start = n - (F.lit(n_splits) - fold) * t
    return F.when(t > 0, F.when(F.col("rn") < start, "train").when(F.col("rn") < start + t, "test"))


def cv_folds(df: DataFrame, n_splits: int = N_FOLDS, spec: SeriesSpec | None = None) -> DataFrame:
    """WIN12: expanding-window folds of ``TimeSeriesSplit(n_splits)``.

    Fold i tests rows [n - (k - i) t, n - (k - i - 1) t) with t = n // (k + 1)
    and trains on every earlier row.  Each row is emitted once per fold it
    belongs to (at most ``n_splits`` copies), with ``role`` train / test."""
    d = with_lengths(df, spec)
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return d.withColumn("role", fold_role(F.col("fold"), n_splits)).where(F.col("role").isNotNull())


def regression_metrics(df: DataFrame, y: str, p: str, group=("site_id",)) -> DataFrame:
    """ML6: R^2, RMSE, MAE over rows where both values are present.

    ``SS_tot = n * var_pop(y)`` keeps it one pass."""
    both = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    err = F.col(y) - F.col(p)
    return both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(1.0) - F.sum(err * err) / (F.count(F.lit(1)) * F.var_pop(y))).alias("r2"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"))


def cv_summary(fold_metrics: DataFrame, group=("site_id",)) -> DataFrame:
    """ML7: mean and population std of the fold metrics."""
    return fold_metrics.groupBy(*group).agg(
        F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"),
        F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"),
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"))
