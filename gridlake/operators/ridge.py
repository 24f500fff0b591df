"""Ridge regression by normal equations (ML10, ML9).

The second moments of features and target are one aggregate per key, combined before the
shuffle, whatever the number of rows; the solve is a matrix of (features x features) per
key.  ``dilated_lags`` and ``forecast`` make it a forecaster of a series from its own past:
lags that double reach far back with few coefficients, as a dilated convolution does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridlake.plans.materialize import join_small
from gridlake.plans.sequence import DEFAULT_SPEC, SeriesSpec, series_counts, windowed

#: Lags 1, 2, 4: three layers of dilation 2.
DILATED_LAGS = (1, 2, 4)


def moments(df: DataFrame, features: list[str], target: str, key=("site_id",)) -> DataFrame:
    """One row per key: the number of complete rows, means, and the population covariances
    of every pair, rows with a missing value left out."""
    cols = [*features, target]
    whole = df.na.drop(subset=cols)
    pairs = [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for i, a in enumerate(cols) for b in cols[:i + 1]]
    return whole.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col(c).cast("double")) for c in cols]).alias("means"),
                                   F.array(*pairs).alias("covariances"))


def coefficients(stats: DataFrame, n_features: int, penalty: float, key=("site_id",)) -> DataFrame:
    """``(key, intercept, weights)`` from ``moments``: (C + penalty I) w = c."""
    size = n_features + 1
    row, col = np.tril_indices(size)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields if f.name in key)

    def solve(frames):
        for frame in frames:
            weights, intercepts = [], []
            for means, pairs in zip(frame["means"], frame["covariances"]):
                c = np.zeros((size, size))
                c[row, col] = c[col, row] = pairs
                w = np.linalg.solve(c[:-1, :-1] + penalty * np.eye(n_features), c[:-1, -1])
                weights.append(w.tolist())
                intercepts.append(float(means[-1] - w @ np.asarray(means[:-1])))
            yield pd.DataFrame({**{k: frame[k] for k in key}, "intercept": intercepts, "weights": weights})

    return stats.mapInPandas(solve, f"{kinds}, intercept double, weights array<double>")


def fit(train: DataFrame, features: list[str], target: str, penalty: float = 1e-3, key=("site_id",)) -> DataFrame:
    """The model: a row of coefficients per key."""
    return coefficients(moments(train, features, target, key), len(features), penalty, key)


def predict(model: DataFrame, df: DataFrame, features: list[str], out: str = "prediction", key=("site_id",)) -> DataFrame:
    """``df`` with the key's prediction (missing where a feature or the model is)."""
    joined = join_small(df, model, list(key), "left", name="ridge")
    value = F.col("intercept")
    for i, c in enumerate(features):
        value = value + F.col("weights")[i] * F.col(c)
    return joined.withColumn(out, value).drop("intercept", "weights")


def dilated_lags(df: DataFrame, value: str, lags=DILATED_LAGS, spec: SeriesSpec = DEFAULT_SPEC) -> DataFrame:
    """``{value}_lag_{k}`` for every lag."""
    return windowed(df, lambda w: {f"{value}_lag_{k}": F.lag(value, k).over(w) for k in lags}, halo=max(lags), spec=spec)


def forecast(model: DataFrame, df: DataFrame, value: str, steps: int, lags=DILATED_LAGS,
             spec: SeriesSpec = DEFAULT_SPEC) -> DataFrame:
    """``(key, step, prediction)``: each series carried on by ``steps`` values, every
    prediction being the past of the next.  Only the last ``max(lags)`` rows of a series
    are gathered.  A series with fewer rows, or a missing value among them, has none."""
    key, reach = list(spec.key), max(lags)
    numbered = windowed(df.select(*key, *spec.order, value), lambda w: {}, halo=0, spec=spec)
    sized = join_small(numbered, series_counts(numbered, spec), key, "inner", name="ends")
    ends = (sized.where((F.col("rn") >= F.col("n_rows") - reach) & (F.col("n_rows") >= reach))
                 .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rn", F.col(value).cast("double").alias("v")))).alias("last")))
    start = F.struct(F.transform("last", lambda x: x["v"]).alias("past"), F.array().cast("array<double>").alias("out"))

    def step(state, _):
        y = F.col("intercept")
        for i, k in enumerate(lags):
            y = y + F.col("weights")[i] * F.element_at(state["past"], -k)
        return F.struct(F.concat(F.slice(state["past"], 2, reach), F.array(y)).alias("past"),
                        F.concat(state["out"], F.array(y)).alias("out"))

    made = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["out"]
    rows = ends.join(model, key).select(*key, F.posexplode(made).alias("step", "prediction"))
    return rows.where("prediction is not null").withColumn("step", F.col("step") + 1)
