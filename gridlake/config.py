"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every gridlake session wants.  AQE re-plans joins at run time
# (broadcast conversion, skew splits, partition coalescing); the session time
# zone is pinned so TIMESTAMP casts are reproducible.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "gridlake", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's."""
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "12g")
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised intermediates.

    Read ``spark.checkpoint.dir`` from the session; only when it is unset (a
    bare test session) choose a private folder and register it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster: "
                           "gridlake writes lineage cuts and statistics tables there")
    # a bare local session (tests): a private folder is fine on one machine
    path = tempfile.mkdtemp(prefix="gridlake-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_CREATED: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """Unique folder below the checkpoint root for one materialised table."""
    import uuid

    root = checkpoint_root(spark)
    path = f"{root}/gridlake/{name}-{uuid.uuid4().hex}"
    _CREATED.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders this process created (call once the
    results that read them have been consumed); returns how many.  Uses the
    Hadoop file system of the checkpoint folder, so it works on shared
    storage as well as locally."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _CREATED:
        p = jvm.org.apache.hadoop.fs.Path(_CREATED.pop())
        if p.getFileSystem(conf).delete(p, True):
            n += 1
    return n
