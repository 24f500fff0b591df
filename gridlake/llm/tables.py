"""Reading the given tables and cutting lineage on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlake.config import checkpoint_root
from gridlake.plans.materialize import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str, at_most: int | None = None, per_file: int = 100_000) -> DataFrame:
    """``df`` as a table in the shared folder of ``spark.checkpoint.dir``: a lost
    executor costs a re-read, not a recomputation.  With a bound on its rows
    (``at_most``) it is written in as few files as hold ``per_file`` rows each."""
    spark = df.sparkSession
    checkpoint_root(spark)
    if at_most is not None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(1, min(parts, -(-at_most // per_file))))
    return materialize(df, name)


def set_aside(df: DataFrame, outputs, used=()) -> tuple[DataFrame, list[str]]:
    """``df`` with every column that is named like one of ``outputs`` (names compare as
    Spark does, without case) renamed to ``<name>_in``, and the names that the columns
    ``used`` have now.  A name that is taken already gets ``_in`` again."""
    taken = {c.lower() for c in df.columns} | {c.lower() for c in outputs}
    named = {}
    for c in df.columns:
        if c.lower() in {o.lower() for o in outputs}:
            new = c
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            named[c] = new
    if named:
        df = df.withColumnsRenamed(named)
    at = {c.lower(): named.get(c, c) for c in [*named, *df.columns] if c in named or c not in named.values()}
    return df, [at.get(u.lower(), u) for u in used]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many ``_`` put before it as make it differ from every column
    of ``df`` (without case): for columns that an operator needs on the way."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now: it does so
    when the driver collects the objects that refer to them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
