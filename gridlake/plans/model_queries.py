"""Registered queries: forecasting models (ML3-ML5, ML8-ML10, SNK4, FLT4).

Checked on rows only: model values are not comparable across engines.
Fitted models are saved below ``spark.checkpoint.dir`` and loaded back by
the queries that reuse them (the reference's train-then-load flow).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from gridlake.config import checkpoint_root, scratch_path
from gridlake.operators import evaluate as E
from gridlake.operators import features as FE
from gridlake.operators import merge as M
from gridlake.operators import models as MD
from gridlake.operators import prep as PR
from gridlake.operators import ridge as RG
from gridlake.operators import stress as ST
from gridlake.plans.feature_queries import c
from gridlake.plans.materialize import materialize, written_bytes
from gridlake.plans.model_prep_queries import METRIC_SEL, SPLIT_BASE, pv_imputed
from gridlake.plans.registry import register
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX


def _split(df):
    return E.chrono_split(df).drop("n_rows", "stress_role")


def _frame(df, target):
    d, feats = MD.model_frame(df, target)
    return d.na.drop(subset=feats + [target]), feats  # FLT4


def _model_path(spark, name, sf_dir, *parts):
    """Where a model of these inputs lies: the key covers the table's files with their
    sizes, the features and the parameters, so other data or settings never meet it."""
    events = FX.table(spark, sf_dir, "events")
    text = repr((sorted(events.inputFiles()), written_bytes(events), parts, MD.FOREST_TREES, MD.FOREST_DEPTH, MD.SEED))
    return f"{checkpoint_root(spark)}/gridlake/models/{name}-{hashlib.sha1(text.encode()).hexdigest()[:16]}"


def _exists(spark, path) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _forest(spark, sf_dir, name, table, target):
    """Fit (or load the saved) forest for ``table``; returns (model, frame)."""
    d, feats = _frame(_split(table), target)
    path = _model_path(spark, name, sf_dir, feats, target)
    if _exists(spark, path):
        return MD.load_model(path), d, feats
    model = MD.fit(MD.forest_pipeline(feats, target), d.where(F.col("holdout_role") == "train"))
    MD.save_model(model, path)
    return model, d, feats


def _wind_imputed(spark, sf_dir):
    w = FE.wind_features_b(M.dedup_first(FX.wind(spark, sf_dir)))
    return PR.impute(w, PR.WIND_POLICY)


LINEAR_SQL = SPLIT_BASE + """, d AS (
  SELECT s.site_id, s.row_id, s.ts, s.ghi, s.pv_kw,
         CASE WHEN rn >= n_rows - ceil(CAST(0.2 AS DOUBLE) * CAST(n_rows AS DOUBLE)) THEN 'test' ELSE 'train' END AS role
  FROM r JOIN solar_d s ON s.site_id = r.site_id AND s.row_id = r.row_id WHERE s.pv_kw IS NOT NULL),
st AS (SELECT site_id, avg(ghi) AS mx, stddev_pop(ghi) AS sx, avg(pv_kw) AS my, stddev_pop(pv_kw) AS sy
       FROM d WHERE role = 'train' GROUP BY site_id),
z AS (SELECT d.*, (ghi - mx) / sx AS x, (pv_kw - my) / sy AS y, my, sy FROM d JOIN st ON d.site_id = st.site_id),
m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM z WHERE role = 'train')
SELECT site_id, row_id, ts, pv_kw, (a + b * x) * sy + my AS prediction FROM z, m WHERE role = 'test'"""


@register("linear_forecast", sql=LINEAR_SQL, doubles=["pv_kw", "prediction"],
          operators=("ML3", "ML5", "PRJ8", "PRJ13", "FLT4", "SNK4", "WIN11"))
def linear_forecast(spark, sf_dir):
    """Least squares on one feature, in closed form in SQL: leakage columns dropped, rows
    without a target dropped, scaling fitted on the training rows of each site, the model
    saved and loaded back, its prediction transformed back to kW."""
    table = FE.pv_features_b(M.dedup_first(FX.solar(spark, sf_dir)))
    d = _split(PR.drop_leakage(table)).na.drop(subset=["ghi", "pv_kw"])
    train_rows = F.col("holdout_role") == "train"
    stats = PR.scaling_stats(d, ["ghi", "pv_kw"], fit_on=train_rows)
    scaled = PR.standardize(d, ["ghi", "pv_kw"], fit_on=train_rows)
    path = scratch_path(spark, "linear-model")
    MD.save_model(MD.fit(MD.linear_pipeline(["ghi"], "pv_kw"), scaled.where(train_rows)), path)
    pred = PR.unscale(MD.predict(MD.load_model(path), scaled.where(~train_rows)), stats, "prediction", "pv_kw")
    actual = d.select("site_id", "row_id", F.col("pv_kw").alias("actual"))
    return (pred.select("site_id", "row_id", "ts", "prediction").join(actual, ["site_id", "row_id"])
                .select("site_id", "row_id", "ts", F.col("actual").alias("pv_kw"), "prediction"))


@register("forest_forecast", operators=("ML4", "ML5", "PRJ8", "PRJ13", "FLT4", "SNK4", "WIN11"))
def forest_forecast(spark, sf_dir):
    d, feats = _frame(_split(pv_imputed(spark, sf_dir)), "pv_kw")
    model = MD.fit(MD.forest_pipeline(feats, "pv_kw"),
                   d.where(F.col("holdout_role") == "train"))
    MD.save_model(model, _model_path(spark, "pv_forest", sf_dir, feats, "pv_kw"))
    test = d.where(F.col("holdout_role") == "test")
    return MD.predict(model, test).select("site_id", "row_id", "ts", "pv_kw", "prediction")


@register("wind_forest_forecast", operators=("ML4", "ML5", "PRJ8", "FLT4", "SNK4", "WIN11"))
def wind_forest_forecast(spark, sf_dir):
    """The wind model of the reference's training step (same forest)."""
    d, feats = _frame(_split(_wind_imputed(spark, sf_dir)), "wind_kw")
    model = MD.fit(MD.forest_pipeline(feats, "wind_kw"), d.where(F.col("holdout_role") == "train"))
    MD.save_model(model, _model_path(spark, "wind_forest", sf_dir, feats, "wind_kw"))
    test = d.where(F.col("holdout_role") == "test")
    return MD.predict(model, test).select("site_id", "row_id", "ts", "wind_kw", "prediction")


PV_STRESS, WIND_STRESS = ["ghi", "upper_rad"], ["wind_speed", "air_density"]
PENALTY = 1e-3


def _stress_sql(name: str, table: str, x: str, y: str, target: str) -> str:
    """Ridge on two scaled features in closed form, scored on the last 30 % as it is and
    with noise: ``{name}_s(site_id, ts, scenario, actual, predicted)``."""
    noise = ", ".join(f"{f} + {S.normal_sql(MD.SEED, f, 'site_id', 'row_id')} * {c(MD.NOISE_STD)} AS {f}" for f in (x, y))
    return f"""{name}_n AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts, row_id) - 1 AS rn, count(*) OVER (PARTITION BY site_id) AS n_rows
  FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {target} IS NOT NULL),
{name}_r AS (SELECT *, rn < floor({c(0.7)} * n_rows) AS train FROM {name}_n),
{name}_st AS (SELECT site_id, avg({x}) AS mx, stddev_pop({x}) AS sx, avg({y}) AS my, stddev_pop({y}) AS sy
  FROM {name}_r WHERE train GROUP BY site_id),
{name}_z AS (SELECT r.site_id, r.row_id, r.ts, r.train, r.{target} AS t,
         (r.{x} - mx) / CASE WHEN sx = 0 THEN 1 ELSE sx END AS {x}, (r.{y} - my) / CASE WHEN sy = 0 THEN 1 ELSE sy END AS {y}
  FROM {name}_r r JOIN {name}_st st ON r.site_id = st.site_id),
{name}_c AS (SELECT site_id, avg({x}) AS mx, avg({y}) AS my, avg(t) AS mt, var_pop({x}) + {c(PENALTY)} AS xx,
         var_pop({y}) + {c(PENALTY)} AS yy, covar_pop({x}, {y}) AS xy, covar_pop({x}, t) AS xt, covar_pop({y}, t) AS yt
  FROM {name}_z WHERE train GROUP BY site_id),
{name}_w AS (SELECT *, (xt * yy - yt * xy) / (xx * yy - xy * xy) AS wx, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS wy FROM {name}_c),
{name}_f AS (
  SELECT site_id, ts, 'baseline' AS scenario, t, {x}, {y} FROM {name}_z WHERE NOT train
  UNION ALL
  SELECT site_id, ts, 'noise_{MD.NOISE_STD}', t, {noise} FROM {name}_z WHERE NOT train),
{name}_s AS (SELECT f.site_id, f.ts, f.scenario, f.t AS actual,
         w.mt + w.wx * (f.{x} - w.mx) + w.wy * (f.{y} - w.my) AS predicted
  FROM {name}_f f JOIN {name}_w w ON f.site_id = w.site_id)"""


STRESS_SQL = S.with_ctes(S.SOLAR, S.WIND, S.SOLAR_DEDUP, S.WIND_DEDUP, _stress_sql("pv", "solar_d", *PV_STRESS, "pv_kw"),
                         _stress_sql("wi", "wind_d", *WIND_STRESS, "wind_kw"), """s AS (
  SELECT 'pv' AS source, scenario, actual AS y, predicted AS p FROM pv_s
  UNION ALL SELECT 'wind', scenario, actual, predicted FROM wi_s
  UNION ALL SELECT 'combined', a.scenario, a.actual + b.actual, a.predicted + b.predicted
  FROM pv_s a JOIN wi_s b ON a.site_id = b.site_id AND a.ts = b.ts AND a.scenario = b.scenario)""") + f"""
SELECT source, scenario, {METRIC_SEL} FROM s GROUP BY source, scenario"""


@register("noise_robustness", sql=STRESS_SQL, doubles=["r2", "rmse", "mae"], operators=("ML9", "ML2", "ML6", "ML8", "WIN11"))
def noise_robustness(spark, sf_dir):
    """The stress test on ridge models: scaled features, the last 30 %, PV, wind and both."""
    parts = []
    for rows, features, target in ((FX.solar(spark, sf_dir), PV_STRESS, "pv_kw"), (FX.wind(spark, sf_dir), WIND_STRESS, "wind_kw")):
        d = materialize(ST.prepared(M.dedup_first(rows), features, target), "stress")
        model = materialize(RG.fit(d.where("stress_role = 'train'"), features, target, PENALTY), "stress-model")
        parts.append(ST.scored(d, features, target, lambda f, m=model, x=features: RG.predict(m, f, x)))
    return ST.stress_metrics(*parts)


@register("forest_noise", operators=("ML9", "ML4", "ML5", "ML6"))
def forest_noise(spark, sf_dir):
    """The same on the forests of the reference over all features."""
    parts = []
    for table, target in ((pv_imputed(spark, sf_dir), "pv_kw"), (_wind_imputed(spark, sf_dir), "wind_kw")):
        d, features = MD.model_frame(table, target)
        d = materialize(ST.prepared(d, features, target), "stress")
        model = MD.fit(MD.forest_pipeline(features, target), d.where("stress_role = 'train'"))
        parts.append(ST.scored(d, features, target, lambda f, m=model: MD.predict(m, f)))
    return ST.stress_metrics(*parts)


LAGS = RG.DILATED_LAGS
LAG_COLS = [f"p_renewable_lag_{k}" for k in LAGS]


def _lag_ctes() -> list[str]:
    """``m``: the coefficients of ridge on three lags, by Cramer's rule; ``lt`` the rows."""
    e, g, h = "egh"
    pairs = [(e, e), (e, g), (e, h), (g, g), (g, h), (h, h)]
    sums = ", ".join([f"avg({x}) AS m{x}" for x in (e, g, h, "t")]
                     + [f"covar_pop({x}, {y}){f' + {c(PENALTY)}' if x == y else ''} AS {x}{y}" for x, y in pairs]
                     + [f"covar_pop({x}, t) AS {x}t" for x in (e, g, h)])

    def det(m):
        (p, q, r), (s, t, u), (v, w, x) = m
        return f"({p} * ({t} * {x} - {u} * {w}) - {q} * ({s} * {x} - {u} * {v}) + {r} * ({s} * {w} - {t} * {v}))"

    rows = [["ee", "eg", "eh"], ["eg", "gg", "gh"], ["eh", "gh", "hh"]]
    solved = [det([[f"{x}t" if j == k else row[j] for j in range(3)] for row, x in zip(rows, (e, g, h))]) + f" / {det(rows)} AS w{k}"
              for k in range(3)]
    lags = ", ".join(f"lag(p_renewable, {k}) OVER (PARTITION BY site_id ORDER BY ts, row_id) AS {x}" for k, x in zip(LAGS, (e, g, h)))
    return [S.TELEMETRY, f"""lt AS (
  SELECT site_id, row_id, ts, p_renewable AS t, {lags},
         row_number() OVER (PARTITION BY site_id ORDER BY ts, row_id) - 1 AS rn, count(*) OVER (PARTITION BY site_id) AS n_rows
  FROM telemetry)""", f"""mo AS (
  SELECT site_id, {sums} FROM lt
  WHERE rn < n_rows - ceil({c(0.2)} * CAST(n_rows AS DOUBLE)) AND e IS NOT NULL AND g IS NOT NULL AND h IS NOT NULL AND t IS NOT NULL
  GROUP BY site_id)""", f"""m AS (
  SELECT *, mt - w0 * me - w1 * mg - w2 * mh AS w FROM (SELECT *, {', '.join(solved)} FROM mo))"""]


def _lag_model(spark, sf_dir):
    d = E.chrono_split(RG.dilated_lags(FX.telemetry(spark, sf_dir), "p_renewable"))
    return d, materialize(RG.fit(d.where("holdout_role = 'train'"), LAG_COLS, "p_renewable", PENALTY), "lag-model")


@register("lag_ridge_forecast", sql=S.with_ctes(*_lag_ctes()) + f"""
SELECT lt.site_id, row_id, ts, t AS p_renewable, w + w0 * e + w1 * g + w2 * h AS prediction
FROM lt JOIN m ON lt.site_id = m.site_id WHERE rn >= n_rows - ceil({c(0.2)} * CAST(n_rows AS DOUBLE))""",
          doubles=["p_renewable", "prediction"], operators=("ML10", "WIN1", "WIN11"))
def lag_ridge_forecast(spark, sf_dir):
    """The sequence forecaster: the next value from dilated lags, by normal equations."""
    d, model = _lag_model(spark, sf_dir)
    return RG.predict(model, d.where("holdout_role = 'test'"), LAG_COLS).select("site_id", "row_id", "ts", "p_renewable", "prediction")


STEPS = 6


@register("lag_ridge_steps", sql="WITH RECURSIVE " + ",\n".join(_lag_ctes()) + f""",
st AS (SELECT site_id, max(CASE WHEN rn = n_rows - 1 THEN t END) AS y1, max(CASE WHEN rn = n_rows - 2 THEN t END) AS y2,
              max(CASE WHEN rn = n_rows - 3 THEN t END) AS y3, max(CASE WHEN rn = n_rows - 4 THEN t END) AS y4 FROM lt GROUP BY site_id),
f AS (
  SELECT st.site_id, 1 AS step, w + w0 * y1 + w1 * y2 + w2 * y4 AS y1, y1 AS y2, y2 AS y3, y3 AS y4
  FROM st JOIN m ON st.site_id = m.site_id
  UNION ALL
  SELECT f.site_id, step + 1, w + w0 * y1 + w1 * y2 + w2 * y4, y1, y2, y3
  FROM f JOIN m ON f.site_id = m.site_id WHERE step < {STEPS})
SELECT site_id, CAST(step AS INTEGER) AS step, y1 AS prediction FROM f WHERE y1 IS NOT NULL""",
          doubles=["prediction"], operators=("ML10",))
def lag_ridge_steps(spark, sf_dir):
    """Every site carried on by six values, each prediction being the past of the next."""
    _, model = _lag_model(spark, sf_dir)
    return RG.forecast(model, FX.telemetry(spark, sf_dir), "p_renewable", STEPS)


@register("hybrid_forecast", operators=("ML8", "JN5", "ML5", "ML6"))
def hybrid_forecast(spark, sf_dir):
    pm, pd_, _ = _forest(spark, sf_dir, "pv_forest", pv_imputed(spark, sf_dir), "pv_kw")
    wm, wd, _ = _forest(spark, sf_dir, "wind_forest", _wind_imputed(spark, sf_dir), "wind_kw")
    pv = MD.predict(pm, pd_.where(F.col("holdout_role") == "test"), "pv_pred")
    wi = MD.predict(wm, wd.where(F.col("holdout_role") == "test"), "wind_pred")
    both = (pv.select("site_id", "ts", "pv_kw", "pv_pred")
              .join(wi.select("site_id", "ts", "wind_kw", "wind_pred"), ["site_id", "ts"], "inner")
              .withColumn("total_actual", F.col("pv_kw") + F.col("wind_kw"))
              .withColumn("total_pred", F.col("pv_pred") + F.col("wind_pred")))
    return E.regression_metrics(both, "total_actual", "total_pred")


@register("boosted_forecast", operators=("ML10", "ML3", "WIN1", "WIN2"))
def boosted_forecast(spark, sf_dir):
    """Sequence forecaster re-aimed: gradient-boosted trees on lag / rolling
    features, with features and target scaled on training rows only (ML3)
    and the prediction transformed back."""
    d = _split(pv_imputed(spark, sf_dir))
    lagged = ["pv_lag_1", "pv_lag_3", "pv_roll_mean_3", "pv_roll_std_3", "ghi", "temp_c",
              "sin_hour", "cos_hour"]
    cols = lagged + ["pv_kw"]
    train_rows = F.col("holdout_role") == "train"
    stats = PR.scaling_stats(d, cols, fit_on=train_rows)
    scaled = PR.standardize(d, cols, fit_on=train_rows).na.drop(subset=cols)
    model = MD.fit(MD.boosted_pipeline(lagged, "pv_kw"),
                   scaled.where(train_rows))
    pred = MD.predict(model, scaled.where(~train_rows))
    out = PR.unscale(pred, stats, "prediction", "pv_kw")
    actual = d.select("site_id", "row_id", F.col("pv_kw").alias("actual_kw"))
    return (out.select("site_id", "row_id", "ts", "prediction")
               .join(actual, ["site_id", "row_id"], "inner"))


def _summary(per_fold):
    """The folds and a row (``fold`` NULL) with their mean metrics and population std."""
    summary = per_fold.groupBy().agg(
        F.sum("n").alias("n"), F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"),
        F.avg("mae").alias("mae"), F.stddev_pop("r2").alias("r2_std"),
        F.stddev_pop("rmse").alias("rmse_std"), F.stddev_pop("mae").alias("mae_std"))
    return per_fold.unionByName(summary.withColumn("fold", F.lit(None).cast("int")), allowMissingColumns=True)


@register("forest_cv", operators=("ML4", "ML7", "WIN12"))
def forest_cv(spark, sf_dir):
    """The reference's training loop: five expanding-window folds, a 300-tree
    forest per fold."""
    d, feats = _frame(pv_imputed(spark, sf_dir), "pv_kw")
    return _summary(MD.cross_validate(d, feats, "pv_kw", MD.forest_pipeline))


#: Steps over the hour and the parity of the day: eight values, each a rectangle of the two features,
#: so every tree that has seen all hours ends in eight pure leaves.
STEP_SQL = f"(10 * (hour // 6) + {c(5)} * odd_day)"
STEP_CTES = SPLIT_BASE + f""", d AS (
  SELECT *, {STEP_SQL} AS level FROM (
    SELECT site_id, row_id, ts, rn, n_rows, CAST(hour(ts) AS INTEGER) AS hour,
           CAST(day(ts) % 2 AS INTEGER) AS odd_day FROM r))"""


def _steps(spark, sf_dir):
    d = FE.calendar_b(M.dedup_first(FX.solar(spark, sf_dir)).select("site_id", "row_id", "ts"))
    odd = F.col("day") % 2
    return d.select("site_id", "row_id", "ts", "hour", odd.alias("odd_day"),
                    (F.lit(10.0) * F.floor(F.col("hour") / 6) + F.lit(5.0) * odd).alias("level"))


@register("forest_steps", sql=STEP_CTES + f"""
SELECT site_id, row_id, ts, level, level AS prediction, CAST(8 AS BIGINT) AS fewest_leaves, CAST(8 AS BIGINT) AS most_leaves
FROM d WHERE rn >= n_rows - ceil({c(0.2)} * CAST(n_rows AS DOUBLE))""",
          doubles=["level", "prediction"], operators=("ML4", "ML5", "SNK4", "WIN11"))
def forest_steps(spark, sf_dir):
    """The forest on a target it can learn exactly, saved and loaded back; the leaves are
    counted in the saved files."""
    d = E.chrono_split(_steps(spark, sf_dir))
    path = scratch_path(spark, "steps-forest")
    MD.save_model(MD.fit(MD.forest_pipeline(["hour", "odd_day"], "level"), d.where("holdout_role = 'train'")), path)
    leaves = MD.leaf_counts(path, spark).agg(F.min("leaves").alias("fewest_leaves"), F.max("leaves").alias("most_leaves"))
    test = MD.predict(MD.load_model(path), d.where("holdout_role = 'test'"))
    return test.join(F.broadcast(leaves)).select("site_id", "row_id", "ts", "level", "prediction", "fewest_leaves", "most_leaves")


@register("forest_steps_cv", sql=STEP_CTES + """, f AS (
  SELECT unnest([0, 1, 2, 3, 4]) AS fold, n_rows // 6 AS t, rn, n_rows FROM d),
m AS (SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(1 AS DOUBLE) AS r2, CAST(0 AS DOUBLE) AS rmse, CAST(0 AS DOUBLE) AS mae
      FROM f WHERE t > 0 AND rn >= n_rows - (5 - fold) * t AND rn < n_rows - (5 - fold) * t + t GROUP BY fold)
SELECT *, CAST(NULL AS DOUBLE) AS r2_std, CAST(NULL AS DOUBLE) AS rmse_std, CAST(NULL AS DOUBLE) AS mae_std FROM m
UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), avg(r2), avg(rmse), avg(mae), stddev_pop(r2), stddev_pop(rmse), stddev_pop(mae) FROM m""",
          doubles=["r2", "rmse", "mae", "r2_std", "rmse_std", "mae_std"], operators=("ML4", "ML7", "WIN12"))
def forest_steps_cv(spark, sf_dir):
    """The training loop on that target: every fold is learnt exactly."""
    return _summary(MD.cross_validate(_steps(spark, sf_dir), ["hour", "odd_day"], "level", MD.forest_pipeline))
