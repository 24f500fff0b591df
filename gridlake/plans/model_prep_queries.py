"""Registered queries: imputation, scaling, profiles, splits, metrics
(ML1, ML2, ML6-ML8, AGG7-AGG14, WIN6, WIN11, WIN12, PRJ8-PRJ13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import evaluate as E
from gridlake.operators import features as FE
from gridlake.operators import merge as M
from gridlake.operators import prep as PR
from gridlake.operators import profile as P
from gridlake.plans.feature_queries import ENGINEERED_CTES, PV_B_CTES, c, engineered_features
from gridlake.plans.registry import register
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX
from gridlake.sources.sql_fill import neighbour_ctes

PV_B_INT = ["hour", "day", "month", "weekday", "is_weekend"]
PV_B_DBL = ["temp_c", "humidity", "ghi", "upper_rad", "pv_kw", "sin_hour", "cos_hour",
            "radiation_ratio", "temp_squared", "temp_derating", "pv_per_wm2", "pv_efficiency",
            "radiation_change", "pv_lag_1", "pv_lag_3", "pv_roll_mean_3", "pv_roll_std_3",
            "pv_ramp_rate"]
PV_TEMPORAL = ["pv_lag_1", "pv_lag_3", "pv_roll_mean_3", "pv_roll_std_3", "pv_ramp_rate"]
PV_MEDIAN = [x for x in PV_B_INT + PV_B_DBL if x not in PV_TEMPORAL]
PV_FEATURES = [x for x in PV_B_DBL + PV_B_INT if x != "pv_kw"]


def pv_b(spark, sf_dir):
    return FE.pv_features_b(M.dedup_first(FX.solar(spark, sf_dir)))


def pv_imputed(spark, sf_dir):
    return PR.impute(pv_b(spark, sf_dir), PR.PV_POLICY)


def _pv_ctes(*more: str) -> str:
    """``WITH`` clause holding the lineage B PV feature table ``pf``."""
    return S.with_ctes(*PV_B_CTES, *more)


def _impute_sql() -> str:
    meds = ", ".join(f"median(CASE WHEN isinf({x}) THEN NULL ELSE {x} END) AS {x}__med"
                     if x in PV_B_DBL else f"median({x}) AS {x}__med" for x in PV_MEDIAN)
    cols = []
    for x in ["site_id", "row_id", "ts", "rn"] + PV_B_INT + PV_B_DBL:
        if x in PV_TEMPORAL:
            cols.append(f"coalesce({x}, {x}__v0, {x}__v1) AS {x}")
        elif x in PV_B_DBL:
            cols.append(f"CASE WHEN {x} IS NULL OR isinf({x}) THEN {x}__med ELSE {x} END AS {x}")
        elif x in PV_B_INT:
            cols.append(f"coalesce({x}, CAST({x}__med AS INTEGER)) AS {x}")
        else:
            cols.append(f"g.{x}" if x == "site_id" else x)
    return _pv_ctes(neighbour_ctes("pf", PV_TEMPORAL, "g"),
                    f"meds AS (SELECT site_id, {meds} FROM g GROUP BY site_id)",
                    f"imp AS (SELECT {', '.join(cols)} FROM g JOIN meds ON g.site_id = meds.site_id)")


IMPUTE_CTES = _impute_sql()


@register("impute_policy", sql=IMPUTE_CTES + "SELECT * FROM imp", doubles=PV_B_DBL,
          operators=("ML1", "WIN6", "AGG9"))
def impute_policy(spark, sf_dir):
    return pv_imputed(spark, sf_dir)


def _standardize_sql() -> str:
    stats = ", ".join(f"avg(CAST({x} AS DOUBLE)) AS {x}__mu, stddev_pop(CAST({x} AS DOUBLE)) AS {x}__sd"
                      for x in PV_FEATURES)
    cols = ["i.site_id", "row_id", "ts", "rn", "pv_kw"] + [
        f"(CAST({x} AS DOUBLE) - {x}__mu) / CASE WHEN {x}__sd = 0 THEN {c(1)} ELSE {x}__sd END AS {x}"
        for x in PV_FEATURES]
    return IMPUTE_CTES + f""", st AS (SELECT site_id, {stats} FROM imp GROUP BY site_id)
SELECT {', '.join(cols)} FROM imp i JOIN st ON i.site_id = st.site_id"""


@register("standardize", sql=_standardize_sql(), doubles=PV_B_DBL + PV_B_INT,
          operators=("ML2", "PRJ9", "PRJ11", "PRJ12"))
def standardize(spark, sf_dir):
    d = pv_imputed(spark, sf_dir)
    feats = PR.feature_columns(d, ["pv_kw"])
    return PR.standardize(d, feats)


def _corr_sql() -> str:
    feats = PV_FEATURES + ["pv_kw"]

    def pear(x):
        xv = f"CASE WHEN {x} IS NOT NULL AND pv_kw IS NOT NULL THEN CAST({x} AS DOUBLE) END"
        yv = f"CASE WHEN {x} IS NOT NULL AND pv_kw IS NOT NULL THEN pv_kw END"
        den = f"(stddev_pop({xv}) * stddev_pop({yv}))"
        return f"CASE WHEN {den} = 0 THEN NULL ELSE covar_pop({xv}, {yv}) / {den} END AS {x}"

    rnd = (f"sign(abs_corr) * CAST(floor(abs(abs_corr) * CAST(1e6 AS DOUBLE) + CAST({S.HALF} AS DOUBLE))"
           " AS DOUBLE) / CAST(1e6 AS DOUBLE)")
    return IMPUTE_CTES + f""", w AS (SELECT site_id, {', '.join(pear(x) for x in feats)}
      FROM imp GROUP BY site_id),
l AS (SELECT site_id, feature, abs(r) AS abs_corr
      FROM (UNPIVOT w ON {', '.join(feats)} INTO NAME feature VALUE r))
SELECT site_id, feature, abs_corr, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY {rnd} DESC NULLS LAST, feature) AS rank
  FROM l) WHERE rank <= 6"""


@register("feature_correlation", sql=_corr_sql(), doubles=["abs_corr"], operators=("AGG14", "SRT2"))
def feature_correlation(spark, sf_dir):
    d = pv_imputed(spark, sf_dir)
    feats = PR.feature_columns(d, ["pv_kw"])
    out = P.correlation_top(d, feats, "pv_kw", 6)
    return out


def _column_stats_sql() -> str:
    cols = PV_B_INT + PV_B_DBL
    parts = []
    for x in cols:
        v = f"CAST({x} AS DOUBLE)"
        fin = f"CASE WHEN isinf({v}) THEN NULL ELSE {v} END"
        parts.append(f"""SELECT site_id, '{x}' AS "column", count({v}) AS n,
  count_if({v} IS NULL) AS n_missing, count_if(isinf({v})) AS n_infinite,
  count_if({v} = 0) AS n_zero, min({fin}) AS min, max({fin}) AS max, avg({fin}) AS mean,
  stddev_samp({fin}) AS std, median({fin}) AS median FROM pf GROUP BY site_id""")
    return _pv_ctes() + "\nUNION ALL\n".join(parts)


@register("column_stats", sql=_column_stats_sql(),
          doubles=["min", "max", "mean", "std", "median"],
          operators=("AGG7", "AGG8", "AGG9", "AGG11", "AGG12", "AGG13"))
def column_stats(spark, sf_dir):
    return P.column_stats(pv_b(spark, sf_dir), PV_B_INT + PV_B_DBL)


SPLIT_BASE = S.with_ctes(S.SOLAR, S.SOLAR_DEDUP, """r AS (
  SELECT site_id, row_id, ts,
         CAST(row_number() OVER (PARTITION BY site_id ORDER BY ts, row_id) - 1 AS BIGINT) AS rn,
         count(*) OVER (PARTITION BY site_id) AS n_rows
  FROM solar_d)""")


@register("chrono_split", sql=SPLIT_BASE + f"""
SELECT *, CASE WHEN rn >= n_rows - ceil({c(0.2)} * CAST(n_rows AS DOUBLE)) THEN 'test' ELSE 'train' END
            AS holdout_role,
          CASE WHEN rn < floor({c(0.7)} * CAST(n_rows AS DOUBLE)) THEN 'train' ELSE 'test' END
            AS stress_role
FROM r""", operators=("WIN11",))
def chrono_split(spark, sf_dir):
    s = M.dedup_first(FX.solar(spark, sf_dir)).select("site_id", "row_id", "ts")
    return E.chrono_split(s)


CV_SQL = SPLIT_BASE + """, f AS (
  SELECT *, n_rows // 6 AS t, unnest([0, 1, 2, 3, 4]) AS fold FROM r)
SELECT site_id, row_id, ts, rn, n_rows, CAST(fold AS INTEGER) AS fold,
       CASE WHEN rn >= n_rows - (5 - fold) * t AND rn < n_rows - (5 - fold) * t + t THEN 'test'
            ELSE 'train' END AS role
FROM f WHERE t > 0 AND rn < n_rows - (5 - fold) * t + t"""


@register("cv_folds", sql=CV_SQL, operators=("WIN12",))
def cv_folds(spark, sf_dir):
    s = M.dedup_first(FX.solar(spark, sf_dir)).select("site_id", "row_id", "ts")
    return E.cv_folds(s)


METRIC_SEL = f"""count(*) AS n,
       {c(1)} - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2,
       sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae"""


@register("forecast_metrics", sql=_pv_ctes() + f"""
SELECT site_id, {METRIC_SEL}
FROM (SELECT site_id, pv_kw AS y, pv_lag_1 AS p FROM pf)
WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY site_id""",
          doubles=["r2", "rmse", "mae"], operators=("ML6",))
def forecast_metrics(spark, sf_dir):
    return E.regression_metrics(pv_b(spark, sf_dir), "pv_kw", "pv_lag_1")


CV_METRICS_SQL = _pv_ctes("r AS (SELECT *, count(*) OVER (PARTITION BY site_id) AS n_rows FROM pf)",
                          "f AS (SELECT *, n_rows // 6 AS t, unnest([0, 1, 2, 3, 4]) AS fold FROM r)",
                          f"""fm AS (
  SELECT site_id, fold, {METRIC_SEL}
  FROM (SELECT site_id, fold, pv_kw AS y, pv_lag_1 AS p FROM f
        WHERE t > 0 AND rn >= n_rows - (5 - fold) * t AND rn < n_rows - (5 - fold) * t + t)
  WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY site_id, fold)""") + """
SELECT site_id, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std, avg(rmse) AS rmse_mean,
       stddev_pop(rmse) AS rmse_std, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std
FROM fm GROUP BY site_id"""


@register("cv_metrics", sql=CV_METRICS_SQL,
          doubles=["r2_mean", "r2_std", "rmse_mean", "rmse_std", "mae_mean", "mae_std"],
          operators=("ML7", "WIN12", "ML6"))
def cv_metrics(spark, sf_dir):
    folds = E.cv_folds(pv_b(spark, sf_dir)).where(F.col("role") == "test")
    per_fold = E.regression_metrics(folds, "pv_kw", "pv_lag_1", ("site_id", "fold"))
    return E.cv_summary(per_fold)


@register("combined_metrics", sql=S.with_ctes(*ENGINEERED_CTES) + f"""
SELECT site_id, {METRIC_SEL}
FROM (SELECT site_id, total_renewable_power AS y, solar_lag_1 + wind_lag_1 AS p FROM fe)
WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY site_id""",
          doubles=["r2", "rmse", "mae"], operators=("ML8", "ML6"))
def combined_metrics(spark, sf_dir):
    fe = engineered_features(spark, sf_dir)
    pred = fe.withColumn("p", F.col("solar_lag_1") + F.col("wind_lag_1"))
    return E.regression_metrics(pred, "total_renewable_power", "p")

