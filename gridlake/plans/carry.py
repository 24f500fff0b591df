"""Nearest valid neighbours across chunk borders.

Fills need the previous and the next non-NULL value of a column, however far
away.  Inside a chunk a window with an unbounded frame finds them; across
chunks a summary per (key, chunk) -- its first and last valid (rn, value) --
is scanned with a window over the small summary table and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridlake.plans.materialize import join_small
from gridlake.plans.sequence import (DEFAULT_SPEC, SeriesSpec, known_largest, largest_key,
                                     number_rows, rn_column, series_window)


def _valid(c: str):
    return F.when(F.col(c).isNotNull(), F.struct(F.col("rn").alias("rn"), F.col(c).alias("v")))


def neighbours(df: DataFrame, cols: list[str], spec: SeriesSpec = DEFAULT_SPEC) -> DataFrame:
    """For each column ``c`` add structs ``c__prev`` and ``c__next`` holding
    ``(rn, v)`` of the last valid row at or before, and the first valid row at
    or after, the current row within its key (NULL when none)."""
    largest = known_largest(df, spec)
    if largest is None:
        largest = largest_key(df, spec)
    if largest <= spec.chunk_rows:
        # every series is one bounded chunk: no carries between chunks
        d = df.drop("rn").withColumn(
            "rn", rn_column(F.row_number().over(series_window(spec)) - 1, largest, spec))
        upto = (Window.partitionBy(*spec.key).orderBy("rn")
                      .rowsBetween(Window.unboundedPreceding, 0))
        ahead = (Window.partitionBy(*spec.key).orderBy(F.desc("rn"))
                       .rowsBetween(Window.unboundedPreceding, 0))
        return d.select(
            "*",
            *[F.last(_valid(c), ignorenulls=True).over(upto).alias(f"{c}__prev") for c in cols],
            *[F.last(_valid(c), ignorenulls=True).over(ahead).alias(f"{c}__next") for c in cols])
    numbered = number_rows(df.drop("rn"), spec, largest=largest)
    chunk = F.floor(F.col("rn") / F.lit(spec.chunk_rows)).cast("bigint")
    data = numbered.withColumn("_chunk", chunk)

    # Both look-ups are running frames (unbounded preceding .. current row):
    # a frame reaching to unbounded *following* is re-aggregated for every
    # row by Spark (quadratic per partition), so the look-ahead runs over the
    # descending order instead.
    upto = (Window.partitionBy(*spec.key, "_chunk").orderBy("rn")
                  .rowsBetween(Window.unboundedPreceding, 0))
    ahead = (Window.partitionBy(*spec.key, "_chunk").orderBy(F.desc("rn"))
                   .rowsBetween(Window.unboundedPreceding, 0))
    local = data.select(
        "*",
        *[F.last(_valid(c), ignorenulls=True).over(upto).alias(f"_{c}__lp") for c in cols],
        *[F.last(_valid(c), ignorenulls=True).over(ahead).alias(f"_{c}__ln") for c in cols],
    )

    # One row per chunk: its first / last valid entries (partial aggregates).
    summary = data.groupBy(*spec.key, "_chunk").agg(
        *[F.max(_valid(c)).alias(f"_{c}__cl") for c in cols],
        *[F.min(_valid(c)).alias(f"_{c}__cf") for c in cols],
    )
    earlier = (Window.partitionBy(*spec.key).orderBy("_chunk")
                     .rowsBetween(Window.unboundedPreceding, -1))
    later = (Window.partitionBy(*spec.key).orderBy(F.desc("_chunk"))
                   .rowsBetween(Window.unboundedPreceding, -1))
    carries = summary.select(
        *spec.key, "_chunk",
        *[F.last(f"_{c}__cl", ignorenulls=True).over(earlier).alias(f"_{c}__in") for c in cols],
        *[F.last(f"_{c}__cf", ignorenulls=True).over(later).alias(f"_{c}__out") for c in cols],
    )
    joined = join_small(local, carries, [*spec.key, "_chunk"], "left", name="carries")
    out = joined.select(
        *[c for c in numbered.columns],
        *[F.coalesce(f"_{c}__lp", f"_{c}__in").alias(f"{c}__prev") for c in cols],
        *[F.coalesce(f"_{c}__ln", f"_{c}__out").alias(f"{c}__next") for c in cols],
    )
    return out
