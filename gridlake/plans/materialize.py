"""Lineage cuts and size-checked broadcast joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlake.config import scratch_path

# A side table is broadcast only when its written size is at most this many
# bytes (measured on the files, never estimated).  Parquet is a few times
# smaller than rows in memory; the bound leaves room for that.
BROADCAST_MAX_BYTES = 16 * 1024 * 1024


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    This is the lineage cut: later stages restart from these files when an
    executor is lost instead of recomputing shuffles, and values computed
    from partition positions stay fixed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def written_bytes(df: DataFrame) -> int:
    """Size of the files behind a table read from storage."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def broadcast_if_small(small: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES,
                       name: str = "stats") -> DataFrame:
    """A side table ready to join, broadcast only behind a check of its bytes.

    It is written once below the checkpoint folder, so the aggregate over the big
    input runs once whatever its size; beyond ``max_bytes`` the caller's join is
    a shuffle join and AQE decides at run time."""
    small = materialize(small, name)
    return F.broadcast(small) if written_bytes(small) <= max_bytes else small


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left",
               max_bytes: int = BROADCAST_MAX_BYTES, name: str = "stats") -> DataFrame:
    """Join a statistics table (one row per key) onto ``big``, broadcasting
    it only when its size is proven small (see ``broadcast_if_small``)."""
    return big.join(broadcast_if_small(small, max_bytes, name), on, how)
