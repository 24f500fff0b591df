"""Noise robustness of forecasts (ML9): PV, wind and both together.

The first 70 % of every series train, the rest is scored twice: as it is, and with noise on
its scaled features.  The sources are scored apart and, where a site has both at one time,
as their sum.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, functions as F

from gridlake.operators import evaluate as E
from gridlake.operators import models as MD
from gridlake.operators import prep as PR

SCENARIOS = ("baseline", f"noise_{MD.NOISE_STD}")


def prepared(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Complete rows with ``stress_role``; features scaled by the training rows' statistics."""
    rows = E.chrono_split(df.na.drop(subset=[*features, target])).drop("rn", "n_rows", "holdout_role")
    return PR.standardize(rows, features, fit_on=F.col("stress_role") == "train")


def scored(rows: DataFrame, features: list[str], target: str, predict: Callable[[DataFrame], DataFrame],
           std: float = MD.NOISE_STD, seed: int = MD.SEED) -> DataFrame:
    """``(site_id, ts, scenario, actual, predicted)`` of the test rows of ``prepared``."""
    test = rows.where("stress_role = 'test'")
    out = None
    for name, frame in zip(SCENARIOS, (test, MD.add_noise(test, features, std, seed))):
        part = predict(frame).select("site_id", "ts", F.lit(name).alias("scenario"), F.col(target).alias("actual"),
                                     F.col("prediction").alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def stress_metrics(pv: DataFrame, wind: DataFrame) -> DataFrame:
    """``(source, scenario, n, r2, rmse, mae)``; ``combined`` adds the two where both are."""
    w = wind.select("site_id", "ts", "scenario", F.col("actual").alias("_a"), F.col("predicted").alias("_p"))
    both = (pv.join(w, ["site_id", "ts", "scenario"])
              .select("site_id", "ts", "scenario", (F.col("actual") + F.col("_a")).alias("actual"),
                      (F.col("predicted") + F.col("_p")).alias("predicted")))
    rows = None
    for name, df in (("pv", pv), ("wind", wind), ("combined", both)):
        part = df.withColumn("source", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return E.regression_metrics(rows, "actual", "predicted", ("source", "scenario"))
