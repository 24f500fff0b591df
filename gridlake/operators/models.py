"""Forecasting models on MLlib (ML3-ML5, ML9, ML10, SNK4).

Training is distributed by MLlib; predictions are ``PipelineModel.transform``
(a projection, no shuffle).  The reference's Keras sequence model is
re-aimed as MLlib regressors over the same features (see README).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from gridlake.functions.exprs import counter_normal
from gridlake.operators import prep as PR

# Fixed forest settings of the reference: 300 trees, depth 12, seed 42.
FOREST_TREES = 300
FOREST_DEPTH = 12
SEED = 42
NOISE_STD = 0.05


#: Split statistics a tree task may hold (MLlib's ``maxMemoryInMB``): a fixed
#: parameter, so the same rows and seed give the same forest on any heap.  More of it
#: means more nodes per pass over the rows.
TREE_MEMORY_MB = 256
#: Rows a partition of the training rows should have: each sends the statistics of all
#: open nodes in every pass, so partitions of few rows cost more than they save.
ROWS_PER_PARTITION = 50_000


def forest_pipeline(features: list[str], target: str, num_trees: int = FOREST_TREES,
                    max_depth: int = FOREST_DEPTH, seed: int = SEED, memory_mb: int = TREE_MEMORY_MB) -> Pipeline:
    """ML4: assembler (feature order = PRJ13) + random forest."""
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    # featureSubsetStrategy 'all': every split considers every feature, like
    # the reference's forest (MLlib's 'auto' would sample a third).
    rf = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=num_trees,
                               maxDepth=max_depth, seed=seed, featureSubsetStrategy="all",
                               maxMemoryInMB=memory_mb)
    return Pipeline(stages=[asm, rf])


def boosted_pipeline(features: list[str], target: str, max_iter: int = 50, max_depth: int = 5,
                     seed: int = SEED) -> Pipeline:
    """ML10 (re-aimed): gradient-boosted trees over the lag features."""
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=target, maxIter=max_iter,
                       maxDepth=max_depth, seed=seed, maxMemoryInMB=TREE_MEMORY_MB)
    return Pipeline(stages=[asm, gbt])


def linear_pipeline(features: list[str], target: str) -> Pipeline:
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[asm, LinearRegression(featuresCol="features", labelCol=target)])


def fit(pipeline: Pipeline, train: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> PipelineModel:
    """Fit with the training rows persisted (memory, spilling to disk): tree
    learners pass over the input several times and must not recompute the
    feature lineage each time.  Small partitions are put together
    (``rows_per_partition``); executors are sized by the user."""
    from pyspark import StorageLevel

    cached = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(cached.coalesce(max(1, -(-cached.count() // rows_per_partition))))
    finally:
        cached.unpersist()


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    """ML5: batch prediction; the assembler fixes the feature order."""
    pred = model.transform(df).drop("features")
    return pred.withColumnRenamed("prediction", out) if out != "prediction" else pred


def save_model(model: PipelineModel, path: str) -> None:
    """SNK4: MLlib persistence (the feature list lives in the assembler)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def add_noise(df: DataFrame, cols: list[str], std: float = NOISE_STD, seed: int = SEED,
              key=("site_id", "row_id")) -> DataFrame:
    """ML9: additive N(0, std) noise on every listed cell.  The number of a cell depends on
    the seed, its column and its row's key alone, so the same cells get the same noise on
    any number of partitions."""
    return df.select(*[(F.col(c) + counter_normal(seed, c, *key) * F.lit(std)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def model_frame(df: DataFrame, target: str, strict_leakage: bool = False,
                leakage_keywords=PR.LEAKAGE_KEYWORDS) -> tuple[DataFrame, list[str]]:
    """PRJ8 + PRJ9: drop leakage columns and pick the numeric features.

    ``strict_leakage`` also drops the target-derived ratios the reference
    keeps (pv_per_wm2, pv_efficiency, power_per_ws, turbulence_intensity)."""
    d = PR.drop_leakage(df, leakage_keywords)
    if strict_leakage:
        d = d.drop("pv_per_wm2", "pv_efficiency", "power_per_ws", "turbulence_intensity",
                   "solar_efficiency", "wind_power_per_speed", "wind_power_coefficient_cp")
    return d, PR.feature_columns(d, [target])


def cross_validate(df: DataFrame, features: list[str], target: str, make_pipeline,
                   n_splits: int = 5, spec=None, side_by_side: int = 5) -> DataFrame:
    """ML4 + ML7: time-series cross-validation -- expanding-window folds per
    series, one fit per fold on its training rows, metrics on its test rows; returns one
    row per fold (fold, n, r2, rmse, mae).

    The numbered rows are written once; a fold is a range of positions in them
    (``evaluate.fold_role``), so no row is copied.  ``side_by_side`` fits run at a time."""
    from functools import reduce

    from pyspark import inheritable_thread_target

    from gridlake.operators.evaluate import fold_role, regression_metrics, with_lengths
    from gridlake.plans.materialize import materialize

    rows = materialize(with_lengths(df, spec), "cv_rows")

    def one(k: int) -> DataFrame:
        role = fold_role(F.lit(k), n_splits)
        model = fit(make_pipeline(features, target), rows.where(role == "train"))
        pred = predict(model, rows.where(role == "test"))
        return materialize(regression_metrics(pred, target, "prediction", ())
                           .withColumn("fold", F.lit(k)), "cv_fold_metrics")

    with ThreadPoolExecutor(side_by_side) as pool:
        parts = list(pool.map(inheritable_thread_target(df.sparkSession)(one), range(n_splits)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def leaf_counts(path: str, spark) -> DataFrame:
    """``(tree, leaves)`` of the forest in a saved pipeline, read from its files."""
    nodes = spark.read.parquet(f"{path}/stages/1_*/data")
    return (nodes.select(F.col("treeID").alias("tree"), F.col("nodeData.leftChild").alias("left"))
                 .groupBy("tree").agg(F.count_if(F.col("left") < 0).alias("leaves")))
