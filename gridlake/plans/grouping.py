"""Per-group statistics whose state stays bounded under skew.

* ``modal_values`` -- most frequent value per key (lowest on ties) as two
  aggregates: counts per (key, value), then ``min(struct(-count, value))``
  per key, which holds one struct per group instead of a value->count map.
* ``top_k_per_key`` -- top-k rows per key in two rounds: ranked inside
  (key, salt) buckets first, so a key with millions of candidate rows is
  cut to ``k * salt_buckets`` rows before the per-key ranking.
* ``exact_quantiles`` -- exact percentiles at every size: small keys in one
  aggregate, large ones by selection between sketched brackets, where only the
  values near a wanted rank are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlake.plans.materialize import join_small, materialize
from gridlake.plans.sequence import SeriesSpec, known_largest, largest_key

SALT_BUCKETS = 64


def modal_values(df: DataFrame, key, cols: list[str], default=None,
                 all_keys: bool = True) -> DataFrame:
    """One row per key with the modal value of each column (NULLs ignored,
    lowest value on ties; ``default`` when a column has no value).  With
    ``all_keys=False`` keys without any value are left out (for callers
    that join the result onto a table of all keys anyway)."""
    key = list(key)
    out = None
    for c in cols:
        counts = (df.where(F.col(c).isNotNull()).groupBy(*key, c)
                    .agg(F.count(F.lit(1)).alias("_n")))
        best = counts.groupBy(*key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v")))
                                        .alias("_b"))
        best = best.select(*key, F.col("_b.v").alias(c))
        out = best if out is None else out.join(best, key, "full")
    if not all_keys and out is not None:
        return out
    keys = df.select(*key).distinct()
    res = keys.join(out, key, "left") if out is not None else keys
    if default is not None:
        res = res.fillna({c: default for c in cols})
    return res


def top_k_per_key(df: DataFrame, key, order: list[Column], k: int, salt_of: Column,
                  salt_buckets: int = SALT_BUCKETS, rank: str = "rank") -> DataFrame:
    """Top ``k`` rows per key by ``order`` (a total order), ranked 1..k."""
    key = list(key)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*key, "_salt").orderBy(*order)
    pre = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*key).orderBy(*order)
    return (pre.withColumn(rank, F.row_number().over(w2)).where(F.col(rank) <= k)
               .drop("_salt", "_r1"))


#: Cells of one key (rows x columns) up to which its values may be held in one task.
HELD_CELLS = 1_000_000
#: Half the share of a column's values between the brackets of a wanted rank, and the
#: accuracy of the sketch that sets them (its error is the reciprocal, well inside).
BRACKET, SKETCH = 0.004, 1_000

Wanted = dict[str, tuple[Column, list[float]]]


def exact_quantiles(df: DataFrame, key, wanted: Wanted, held_cells: int = HELD_CELLS) -> DataFrame:
    """One row per key with an array column per name: the percentiles of the
    column (linear interpolation between the neighbouring ranks, as pandas
    does; NULLs ignored).  Keys without any value are absent.

    Keys of up to ``held_cells`` cells (measured) are one exact aggregate.  Larger ones are
    selected: a sketch brackets every wanted rank, one pass counts what lies below the
    brackets, and only the values between them -- one in a hundred per rank, equal ones
    counted before the shuffle -- are sorted.  Should a bracket miss its rank, all values
    are."""
    key = list(key)
    largest = known_largest(df, SeriesSpec(tuple(key)))
    if largest is None:
        largest = largest_key(df, SeriesSpec(tuple(key)))
    if largest * len(wanted) <= held_cells:
        some = F.lit(False)
        for c, _ in wanted.values():
            some = some | c.isNotNull()
        return df.where(some).groupBy(*key).agg(*[
            F.percentile(c.cast("double"), [float(x) for x in q]).alias(n) for n, (c, q) in wanted.items()])
    cells = materialize(df.select(*key, *[c.cast("double").alias(n) for n, (c, _) in wanted.items()]), "cells")
    wanted = {n: (F.col(f"`{n}`"), q) for n, (_, q) in wanted.items()}
    out = _selected_quantiles(cells, key, wanted)
    return _sorted_quantiles(cells, key, wanted) if out is None else out


def _ranked(counts: DataFrame, series: list[str]) -> DataFrame:
    """``counts(series, _v, _n)`` in order: the ranks ``_first`` to ``_last`` of each value
    in its series, and the series' ``_total``.

    Values are range-sorted over all tasks, and prefix sums over the partitions' totals
    place them: no series lives in one task."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [*series, "_v"]
    tagged = materialize(counts.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
                               .withColumn("_p", F.shiftright(F.monotonically_increasing_id(), 33)), "quantiles")
    pieces = tagged.groupBy("_p", *series).agg(F.sum("_n").alias("_m"))
    ordered = Window.partitionBy(*series).orderBy("_p")
    pieces = pieces.select("_p", *series,
                           F.coalesce(F.sum("_m").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                           F.sum("_m").over(Window.partitionBy(*series)).alias("_total"))
    # partitions + keys x columns rows at most
    inside = Window.partitionBy("_p", *series).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = join_small(tagged.withColumn("_cum", F.sum("_n").over(inside)), pieces, ["_p", *series], "inner",
                        name="quantile_pieces")
    last = F.col("_before") + F.col("_cum") - 1
    return ranked.withColumn("_last", last).withColumn("_first", last - F.col("_n") + 1)


def _picked(asked: DataFrame, key: list[str], wanted: Wanted) -> DataFrame:
    """The values at the places ``_at`` of ``asked(key, _c, _i, _v, _first, _last, _at)``,
    interpolated, an array per name ``_c``."""
    low, high = F.floor("_at"), F.ceil("_at")
    hit = lambda at: F.when((at >= F.col("_first")) & (at <= F.col("_last")), F.col("_v"))
    picked = (asked.select(*key, "_c", "_i", "_at", hit(low).alias("_a"), hit(high).alias("_b"))
                   .where(F.col("_a").isNotNull() | F.col("_b").isNotNull())
                   .groupBy(*key, "_c", "_i").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.first("_at").alias("_at")))
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at")))
    picked = picked.withColumn("_y", value)
    return picked.groupBy(*key).agg(*[
        F.array(*[F.max(F.when((F.col("_c") == n) & (F.col("_i") == i), F.col("_y"))) for i in range(len(q))]).alias(n)
        for n, (_, q) in wanted.items()])


def _selected_quantiles(cells: DataFrame, key: list[str], wanted: Wanted) -> DataFrame | None:
    """By brackets; ``None`` if one does not hold its rank."""
    asks = [(n, i, float(q)) for n, (_, qs) in wanted.items() for i, q in enumerate(qs)]
    ends = {n: [x for q in qs for x in (max(q - BRACKET, 0.0), min(q + BRACKET, 1.0))] for n, (_, qs) in wanted.items()}
    sketch = cells.groupBy(*key).agg(
        *[F.count(c).alias(f"_n_{n}") for n, (c, _) in wanted.items()],
        *[F.percentile_approx(c, ends[n], SKETCH).alias(f"_e_{n}") for n, (c, _) in wanted.items()])
    sketch = materialize(sketch, "quantile-brackets")

    def bracket(n, i, q):
        low, high = F.col(f"_e_{n}")[2 * i], F.col(f"_e_{n}")[2 * i + 1]
        return (F.lit(float("-inf")) if q <= BRACKET else low, F.lit(float("inf")) if q >= 1 - BRACKET else high)

    both = join_small(cells, sketch, key, "inner", name="quantile-brackets")
    below, inside, kept = [], [], []
    for k, (n, i, q) in enumerate(asks):
        low, high = bracket(n, i, q)
        value = wanted[n][0]
        between = value.between(low, high)
        below.append(F.count_if(value < low).alias(f"_below_{k}"))
        inside.append(F.count_if(between).alias(f"_inside_{k}"))
        kept.append(F.when(between, F.struct(F.lit(n).alias("_c"), F.lit(i).alias("_i"), value.alias("_v"))))
    counted = both.groupBy(*key, *[f"_n_{n}" for n in wanted]).agg(*below, *inside)
    places = F.array(*[F.struct(F.lit(n).alias("_c"), F.lit(i).alias("_i"),
                                (F.lit(q) * (F.col(f"_n_{n}") - 1) - F.col(f"_below_{k}")).alias("_at"),
                                F.col(f"_inside_{k}").alias("_held"), F.col(f"_n_{n}").alias("_all"))
                       for k, (n, i, q) in enumerate(asks)])
    places = materialize(counted.select(*key, F.explode(places).alias("_x")).select(*key, "_x.*").where("_all > 0"),
                         "quantile-places")
    if places.where("floor(_at) < 0 or ceil(_at) >= _held").limit(1).count():
        return None
    cells_kept = both.select(*key, F.explode(F.filter(F.array(*kept), lambda x: x.isNotNull())).alias("_x")).select(*key, "_x.*")
    series = [*key, "_c", "_i"]
    counts = cells_kept.groupBy(*series, "_v").agg(F.count(F.lit(1)).alias("_n"))
    asked = join_small(_ranked(counts, series), places.drop("_held", "_all"), series, "inner", name="quantile-places")
    return _picked(asked, key, wanted)


def _sorted_quantiles(cells: DataFrame, key: list[str], wanted: Wanted) -> DataFrame:
    """By sorting the counts of all values."""
    series = [*key, "_c"]
    each = F.array(*[F.struct(F.lit(n).alias("_c"), c.alias("_v")) for n, (c, _) in wanted.items()])
    counts = (cells.select(*key, F.explode(each).alias("_x")).select(*key, "_x._c", "_x._v")
                   .where(F.col("_v").isNotNull()).groupBy(*series, "_v").agg(F.count(F.lit(1)).alias("_n")))
    shares = F.create_map(*[x for n, (_, q) in wanted.items() for x in (F.lit(n), F.array(*[F.lit(float(v)) for v in q]))])
    asked = (_ranked(counts, series)
             .select(*series, "_v", "_first", "_last", "_total", F.posexplode(shares[F.col("_c")]).alias("_i", "_q"))
             .withColumn("_at", F.col("_q") * (F.col("_total") - 1)))
    return _picked(asked, key, wanted)


def approximate_quantiles(df: DataFrame, key, wanted: dict[str, tuple[Column, list[float]]],
                          accuracy: int = 100_000) -> DataFrame:
    """The same shape from ``percentile_approx``, for callers that ask for it."""
    return df.groupBy(*list(key)).agg(*[F.percentile_approx(c, q, accuracy).alias(n) for n, (c, q) in wanted.items()])


def quantiles(df: DataFrame, key, wanted, exact: bool = True) -> DataFrame:
    return (exact_quantiles if exact else approximate_quantiles)(df, key, wanted)
