"""Combining sources: de-duplication, overlap window, joins, complementarity.

Operators: WIN8 (de-duplicate by timestamp, keep first), FLT3 (common time range), JN1/JN2 (inner
equi-join with suffixes), JN4 (positional zip), JN5 (keyed addition), JN6 +
SC6 + SC7 (per-site statistics joined back: complementarity, total power,
capacity factor).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridlake.functions import exprs as X
from gridlake.plans.materialize import join_small
from gridlake.plans.sequence import DEFAULT_SPEC, SeriesSpec, number_rows


def dedup_first(df: DataFrame, key=("site_id", "ts"), order: str = "row_id") -> DataFrame:
    """Keep the first row (lowest ``order``) of every ``key``.

    Written as an aggregate -- ``min(struct(order, ...))`` -- rather than a
    ``row_number`` window, so duplicates are combined map-side and a hot key
    never lands whole in one task.  NULL keys form one group (pandas keeps
    one NaT row).
    """
    rest = [c for c in df.columns if c not in key and c != order]
    first = F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_first")
    return (df.groupBy(*key).agg(first)
              .select(*key, F.col(f"_first.{order}").alias(order),
                      *[F.col(f"_first.{c}").alias(c) for c in rest])
              .select(*df.columns))


def time_range(df: DataFrame, key=("site_id",), ts: str = "ts") -> DataFrame:
    return df.groupBy(*key).agg(F.min(ts).alias("_start"), F.max(ts).alias("_end"))


def common_range(frames: list[DataFrame], key=("site_id",), ts: str = "ts") -> DataFrame:
    """Per key: latest start and earliest end over all frames (inner on key)."""
    ranges = [time_range(f, key, ts).withColumnRenamed("_start", f"_s{i}")
              .withColumnRenamed("_end", f"_e{i}") for i, f in enumerate(frames)]
    joined = reduce(lambda a, b: a.join(b, list(key), "inner"), ranges)
    n = len(frames)
    starts = [F.col(f"_s{i}") for i in range(n)]
    ends = [F.col(f"_e{i}") for i in range(n)]
    return joined.select(*key,
                         (F.greatest(*starts) if n > 1 else starts[0]).alias("common_start"),
                         (F.least(*ends) if n > 1 else ends[0]).alias("common_end"))


def overlap_filter(df: DataFrame, rng: DataFrame, key=("site_id",), ts: str = "ts") -> DataFrame:
    """Keep rows with ``common_start <= ts <= common_end`` of their key."""
    j = join_small(df, rng, list(key), "inner", name="range")
    return (j.where((F.col(ts) >= F.col("common_start")) & (F.col(ts) <= F.col("common_end")))
             .drop("common_start", "common_end"))


def join_sources(left: DataFrame, right: DataFrame, on=("site_id", "ts"),
                 suffixes=("_solar", "_wind"), null_safe: bool = False) -> DataFrame:
    """Inner equi-join; columns present on both sides get the suffixes.

    ``null_safe`` makes NULL keys match each other (pandas merge on NaT).
    """
    clash = [c for c in left.columns if c in right.columns and c not in on]
    lsel = [F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in left.columns]
    rsel = [F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in right.columns]
    l2 = left.select(*lsel)
    r2 = right.select(*rsel)
    if not null_safe:
        return l2.join(r2, list(on), "inner")
    r3 = r2.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in r2.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return l2.join(r3, cond, "inner").drop(*[f"_r_{c}" for c in on])


def generation_bounds(df: DataFrame, solar_col: str, wind_col: str, key=("site_id",)) -> DataFrame:
    return df.groupBy(*key).agg(
        F.min(solar_col).alias("_s_lo"), F.max(solar_col).alias("_s_hi"),
        F.min(wind_col).alias("_w_lo"), F.max(wind_col).alias("_w_hi"))


def complementarity(df: DataFrame, solar_col: str = "pv_kw", wind_col: str = "wind_kw",
                    key=("site_id",)) -> DataFrame:
    """SC6 + SC7: min-max normalise each source per site, then
    ``1 - |norm(s) - norm(w)|``, total power and capacity factor."""
    j = join_small(df, generation_bounds(df, solar_col, wind_col, key), list(key), "left",
                   name="bounds")
    return (j.withColumn("complementarity_index",
                         X.complementarity(solar_col, "_s_lo", "_s_hi", wind_col, "_w_lo", "_w_hi"))
             .withColumn("total_renewable_power", F.col(solar_col) + F.col(wind_col))
             .withColumn("renewable_capacity_factor",
                         (F.col(solar_col) + F.col(wind_col))
                         / (F.col("_s_hi") + F.col("_w_hi") + F.lit(X.EPS)))
             .drop("_s_lo", "_s_hi", "_w_lo", "_w_hi"))


def unified_timeline(solar: DataFrame, wind: DataFrame, key=("site_id",),
                     restrict: bool = False) -> DataFrame:
    """Lineage A merge: de-duplicate both sources, inner join on
    (site_id, ts), add complementarity features.

    The reference first cuts both sides to the common time range (FLT3).
    Before an inner join on the timestamp that cut cannot change the result
    (a matched timestamp lies in both ranges), so it is skipped unless
    ``restrict`` asks for it; it costs a pass over both inputs."""
    s = dedup_first(solar, (*key, "ts"))
    w = dedup_first(wind, (*key, "ts"))
    if restrict:
        rng = common_range([s, w], key)
        s = overlap_filter(s, rng, key)
        w = overlap_filter(w, rng, key)
    merged = join_sources(s, w, (*key, "ts"))
    return complementarity(merged, "pv_kw", "wind_kw", key)


def row_zip(left: DataFrame, right: DataFrame, spec: SeriesSpec = DEFAULT_SPEC,
            suffixes=("_solar", "_wind")) -> DataFrame:
    """JN4: pair the i-th row of each side (per key), truncated to the
    shorter side -- the positional merge, with positions made explicit."""
    key = list(spec.key)
    l = number_rows(left, spec)
    r = number_rows(right, spec)
    lsel = [F.col(c).alias(c + suffixes[0]) if c not in key + ["rn"] else F.col(c) for c in l.columns]
    rsel = [F.col(c).alias(c + suffixes[1]) if c not in key + ["rn"] else F.col(c) for c in r.columns]
    return l.select(*lsel).join(r.select(*rsel), key + ["rn"], "inner")


def keyed_sum(left: DataFrame, right: DataFrame, lcol: str, rcol: str, out: str,
              on=("site_id", "ts")) -> DataFrame:
    """JN5: element-wise addition of two sources, matched on keys not
    positions."""
    return (left.select(*on, F.col(lcol).alias("_l"))
                .join(right.select(*on, F.col(rcol).alias("_r")), list(on), "inner")
                .select(*on, (F.col("_l") + F.col("_r")).alias(out)))
