"""Skew-safe ordering of keyed time series.

A window ``partitionBy('site_id')`` puts a whole site into one task; when one
site holds a third of all rows that task is the job.  Instead:

1. ``number_rows``: range-partition on (key, order) so a hot key is spread
   over many partitions, sort inside partitions, tag each row with its
   partition position, and add the row counts of earlier partitions (a table
   of at most partitions + keys rows) to get ``rn``, the exact 0-based
   position of the row inside its key.
2. ``with_halo``: cut each key into chunks of ``chunk_rows`` rows by ``rn``
   and copy the last ``halo`` rows of a chunk into the next one, so a window
   that looks back at most ``halo`` rows can run over (key, chunk).
3. ``windowed``: evaluate row-frame window expressions over (key, chunk) and
   drop the halo copies.

Unbounded look-back (fills) uses per-chunk summaries instead; see ``carry``.

One aggregate first measures the largest key.  When no key exceeds
``chunk_rows`` a plain per-key window is bounded by construction and is
used instead of steps 1-3; the bound is recorded as metadata on ``rn`` so
chained operators on the same series do not measure it again.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from gridlake.plans.materialize import join_small, materialize

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position


@dataclass(frozen=True)
class SeriesSpec:
    """How rows of a table form ordered series."""

    key: tuple[str, ...] = ("site_id",)
    order: tuple[str, ...] = ("ts", "row_id")
    # rows per chunk; GRIDLAKE_CHUNK_ROWS overrides the default (cluster
    # tuning, or small values to force the chunked plans in checks)
    chunk_rows: int = field(default_factory=lambda: int(os.environ.get("GRIDLAKE_CHUNK_ROWS",
                                                                       1_000_000)))
    range_partitions: int | None = None

    def with_chunk(self, rows: int) -> "SeriesSpec":
        return replace(self, chunk_rows=rows)


DEFAULT_SPEC = SeriesSpec()


def spec_of(df: DataFrame, spec: SeriesSpec | None = None) -> SeriesSpec:
    """``spec``, or the default one with those of its order columns that the table has (a
    merged table has no row number and is ordered by time alone)."""
    if spec is not None:
        return spec
    return replace(DEFAULT_SPEC, order=tuple(c for c in DEFAULT_SPEC.order if c in df.columns))


def largest_key(df: DataFrame, spec: SeriesSpec = DEFAULT_SPEC) -> int:
    """Rows of the largest key (one aggregate with map-side combining; a
    single number reaches the driver)."""
    r = (df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("_n"))
           .agg(F.max("_n").alias("_m")).first())
    return int(r["_m"] or 0)


META_KEY = "gridlake_max_key_rows"


META_SERIES = "gridlake_series_key"


def known_largest(df: DataFrame, spec: SeriesSpec = DEFAULT_SPEC) -> int | None:
    """The largest-key row count recorded on ``rn`` when it was numbered for
    the same key: a hint that saves measuring it again.

    It stays an upper bound through projections, joins on the key and filters.
    Results never depend on it: every operator numbers its rows itself, and the
    hint only chooses between two plans with equal results."""
    if "rn" not in df.columns:
        return None
    meta = df.schema["rn"].metadata or {}
    v = meta.get(META_KEY)
    if v is None or meta.get(META_SERIES) != ",".join(spec.key):
        return None
    return int(v)


def rn_column(expr: Column, largest: int | None, spec: SeriesSpec = DEFAULT_SPEC,
              name: str = "rn") -> Column:
    meta = ({META_KEY: int(largest), META_SERIES: ",".join(spec.key)}
            if largest is not None else {})
    return expr.cast("bigint").alias(name, metadata=meta)


def series_window(spec: SeriesSpec = DEFAULT_SPEC) -> WindowSpec:
    return Window.partitionBy(*spec.key).orderBy(*spec.order)


def number_rows(df: DataFrame, spec: SeriesSpec = DEFAULT_SPEC, rn: str = "rn",
                largest: int | None = None) -> DataFrame:
    """Add ``rn``: 0-based position of each row within its key, ordered by
    ``spec.order``.  The order columns must make the order total.

    When every key fits in one chunk (``largest``, the rows of the largest
    key, is measured unless given) this is a ``row_number`` window per key;
    otherwise the range-partitioned path below, which never puts more than a
    partition's share of a key in one task.  The bound is recorded on
    ``rn`` so later steps need not measure it again."""
    if largest is None:
        largest = known_largest(df, spec)
    df = df.drop(rn)
    if largest is None:
        largest = largest_key(df, spec)
    if largest <= spec.chunk_rows:
        return df.withColumn(rn, rn_column(F.row_number().over(series_window(spec)) - 1, largest,
                                           spec, rn))
    parts = spec.range_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*spec.key, *spec.order]
    # Explicit partition count: AQE must not coalesce this exchange, since the
    # partition index is part of the row position.
    tagged = (df.repartitionByRange(parts, *cols)
                .sortWithinPartitions(*cols)
                .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = materialize(tagged, "numbered")
    tagged = (tagged.withColumn("_pid", F.shiftright("_mid", _POS_BITS))
                    .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
                    .drop("_mid"))
    before = Window.partitionBy(*spec.key).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    bounds = (tagged.groupBy("_pid", *spec.key)
                    .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
                    .withColumn("_shift",
                                F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
                    .select(F.col("_pid").alias("_bpid"),
                            *[F.col(k).alias(f"_b_{k}") for k in spec.key], "_shift"))
    small = bounds
    on = F.col("_pid") == F.col("_bpid")
    for k in spec.key:
        on = on & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    joined = join_small(tagged, small, on, "inner", name="bounds")
    return (joined.withColumn(rn, rn_column(F.col("_pos") + F.col("_shift"), largest, spec, rn))
                  .drop("_pid", "_pos", "_bpid", "_shift", *[f"_b_{k}" for k in spec.key]))


def with_halo(numbered: DataFrame, spec: SeriesSpec, halo: int, rn: str = "rn") -> DataFrame:
    """Assign ``_chunk = rn div chunk_rows``; the last ``halo`` rows of every
    chunk are also emitted into the next chunk with ``_halo = true``."""
    n = spec.chunk_rows
    if halo > n:
        raise ValueError(f"halo {halo} larger than chunk_rows {n}")
    chunk = F.floor(F.col(rn) / F.lit(n)).cast("bigint")
    if halo == 0:
        return numbered.withColumn("_chunk", chunk).withColumn("_halo", F.lit(False))
    tail = F.pmod(F.col(rn), F.lit(n)) >= F.lit(n - halo)
    own = F.struct(chunk.alias("_chunk"), F.lit(False).alias("_halo"))
    nxt = F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_halo"))
    copies = F.when(tail, F.array(own, nxt)).otherwise(F.array(own))
    return (numbered.withColumn("_copies", F.explode(copies))
                    .withColumn("_chunk", F.col("_copies._chunk"))
                    .withColumn("_halo", F.col("_copies._halo"))
                    .drop("_copies"))


def chunk_window(spec: SeriesSpec, rn: str = "rn") -> WindowSpec:
    return Window.partitionBy(*spec.key, "_chunk").orderBy(rn)


def windowed(df: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], halo: int,
             spec: SeriesSpec = DEFAULT_SPEC, keep_rn: bool = True) -> DataFrame:
    """Evaluate window expressions that look back at most ``halo`` rows.

    ``columns(w)`` receives the window -- per (key, chunk) ordered by ``rn``,
    or per key when every key fits one chunk -- and returns
    ``{name: expression}``; row frames must stay within
    ``rowsBetween(-halo, 0)`` (lag up to ``halo``).
    """
    # a number that came with the rows may have gaps (a filter) or repeats (a
    # union): rows are always numbered here, by the order columns
    largest = known_largest(df, spec)
    base = df.drop("rn")
    if largest is None:
        largest = largest_key(base, spec)
    if largest <= spec.chunk_rows:
        # every series is one bounded chunk: one window per key, no halo
        w = series_window(spec)
        rn_col = rn_column(F.row_number().over(w) - 1, largest, spec)
        out = base.select("*", rn_col, *[e.alias(name) for name, e in columns(w).items()])
        return out if keep_rn else out.drop("rn")
    numbered = number_rows(base, spec, largest=largest)
    chunked = with_halo(numbered, spec, halo)
    exprs = columns(chunk_window(spec))
    out = (chunked.select("*", *[e.alias(name) for name, e in exprs.items()])
                  .where(~F.col("_halo"))
                  .drop("_chunk", "_halo"))
    return out if keep_rn else out.drop("rn")


def series_counts(numbered: DataFrame, spec: SeriesSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows per key (a partial aggregate, so hot keys are combined map-side)."""
    return numbered.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("n_rows"))
