"""Repeatable partition writes (SNK1).

``write_partitions`` replaces exactly the partitions that its rows belong to (dynamic
partition overwrite), so a second run over other sites leaves the first run's in place and
a repeated run changes nothing.  Every row carries the ``run_id`` that wrote it; after
the data, a commit manifest below ``<path>/_manifest`` records what the run left in each
partition: rows and an order-independent hash, read back from storage.

A run that dies between data and manifest leaves partitions whose ``run_id`` is not in the
manifest.  ``read_committed`` leaves those out, ``uncommitted`` lists them, and running the
same write again replaces them.

Defined results: a run without rows writes nothing; a NULL partition value is a partition of
its own; equal rows count each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlake.plans.materialize import broadcast_if_small

RUN = "run_id"


def _manifest_path(path: str) -> str:
    # Spark's file listing skips names that begin with an underscore
    return f"{path.rstrip('/')}/_manifest"


def _found(data: DataFrame, keys) -> DataFrame:
    """What storage holds: rows and a hash per partition and run."""
    values = sorted(c for c in data.columns if c not in (RUN, *keys))
    # 40 bits of a row's hash: a sum over 2^23 rows and more stays exact as a decimal
    row = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in values]), 24).cast("decimal(20,0)")
    return data.groupBy(*keys, RUN).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row).alias("rows_hash"))


def write_partitions(df: DataFrame, path: str, run_id: str, partition_by=("site_id",)) -> DataFrame:
    """Write ``df``, replacing its partitions only; returns the run's manifest rows
    ``(*partition_by, run_id, n_rows, rows_hash)``."""
    spark = df.sparkSession
    (df.withColumn(RUN, F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by).parquet(path))
    # the constant column's statistics let the scan skip what other runs wrote
    schema = df.withColumn(RUN, F.lit(run_id)).schema
    rows = _found(spark.read.schema(schema).parquet(path).where(F.col(RUN) == run_id), partition_by)
    rows.write.mode("append").parquet(_manifest_path(path))
    return rows


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """All commits, or None before the first."""
    try:
        return spark.read.parquet(_manifest_path(path))
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _states(spark: SparkSession, path: str, partition_by) -> DataFrame:
    """Per partition and run in storage, whether a commit describes exactly that."""
    found = _found(spark.read.parquet(path), partition_by)
    commits = manifest(spark, path)
    if commits is None:
        return found.withColumn("committed", F.lit(False))
    commits = commits.select(*found.columns).distinct().withColumn("committed", F.lit(True))
    same = reduce(lambda a, b: a & b, [found[c].eqNullSafe(commits[c]) for c in found.columns])
    return found.join(commits, same, "left").select(
        *[found[c] for c in found.columns], F.coalesce("committed", F.lit(False)).alias("committed"))


def uncommitted(spark: SparkSession, path: str, partition_by=("site_id",)) -> DataFrame:
    """The partitions that no commit vouches for."""
    return _states(spark, path, partition_by).where("not committed").drop("committed")


def read_committed(spark: SparkSession, path: str, partition_by=("site_id",)) -> DataFrame:
    """The rows of the committed partitions, each with its ``run_id``."""
    good = _states(spark, path, partition_by).where("committed").select(*partition_by, RUN)
    good = broadcast_if_small(good, name="committed")
    data = spark.read.parquet(path)
    same = reduce(lambda a, b: a & b, [data[c].eqNullSafe(good[c]) for c in (*partition_by, RUN)])
    return data.join(good, same, "left_semi")
