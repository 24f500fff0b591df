"""Generation tables derived from the driver's tables.

The reference's raw workbooks are not available, so the canonical solar,
wind and telemetry tables are derived from ``events`` (and the long-series
bench table from ``lineitem``).  Every event row lands in exactly one of the
two generation sources (even event ids are solar readings, odd ones wind
readings), so together they cover the whole table.

Canonical schemas::

    solar(row_id, site_id, ts, temp_c, humidity, ghi, upper_rad, pv_kw)
    wind (row_id, site_id, ts, air_density, wind_speed, wind_kw)
    telemetry(row_id, site_id, ts, frequency, soc, p_renewable, p_load,
              p_thermal, p_battery)
    yield_series(site_id, ts, row_id, pv_kw, wind_speed)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

N_SITES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.regexp_extract(F.col("props"), r"([0-9]+)", 1).cast("double")


def _power(missing: str = "error", negative: str = "signup") -> Column:
    return (F.when(F.col("event_type") == missing, F.lit(None).cast("double"))
             .when(F.col("event_type") == negative, -F.col("value"))
             .otherwise(F.col("value")))


def _site(shift: int = 0) -> Column:
    """Solar and wind readings of one event belong to different sites, so that each
    source has (site, hour) pairs the other lacks."""
    return ((F.col("user_id") + shift) % N_SITES).cast("int").alias("site_id")


def solar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = _k()
    return e.select(
        F.col("event_id").alias("row_id"),
        _site(),
        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts"),
        (k / F.lit(2.5)).alias("temp_c"),
        (F.lit(100.0) - k).alias("humidity"),
        (k * F.lit(10.0)).alias("ghi"),
        F.when(F.col("event_id") % 10 == 0, F.lit(0.0))
         .otherwise(k * F.lit(10.0) + F.lit(200.0)).alias("upper_rad"),
        _power().alias("pv_kw"),
    )


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = _k()
    return e.select(
        F.col("event_id").alias("row_id"),
        _site(2),
        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts"),
        (F.lit(1.0) + (F.col("event_id") % 30).cast("double") / F.lit(100.0)).alias("air_density"),
        (k / F.lit(5.0)).alias("wind_speed"),
        _power("signup", "error").alias("wind_kw"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = _k()
    return e.select(
        F.col("event_id").alias("row_id"),
        _site(),
        F.col("ts"),
        (F.lit(49.4) + k / F.lit(80.0)).alias("frequency"),
        (F.lit(0.1) + k / F.lit(125.0)).alias("soc"),
        (F.col("value") * F.lit(10.0)).alias("p_renewable"),
        (F.col("value") * F.lit(17.0)).alias("p_load"),
        (F.col("value") * F.lit(4.0)).alias("p_thermal"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value")).alias("p_battery"),
    )


def yield_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series per supplier, ordered by ``YIELD_ORDER`` (ship date,
    then order key, line number, part key and price, which together are
    unique) so ties on the ship date are ordered reproducibly."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("int").alias("site_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
        F.col("l_extendedprice").alias("pv_kw"),
        F.col("l_quantity").alias("wind_speed"),
    )


YIELD_ORDER = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "pv_kw")
