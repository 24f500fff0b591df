"""Sensor cleaning: range rules, IQR outliers, bounded gap filling.

Operators: PRJ5 (cast, bad values to NULL), FLT1 (negatives: solar night to
0, other to NULL; wind to 0), FLT2 (IQR outlier bounds with multiplier 3;
solar bounds from daylight rows only and applied to daylight only), WIN4
(forward fill limited to 3 rows), WIN5 (linear interpolation by position,
limit 10), WIN6 (unlimited forward then backward fill).

The order is fixed: cast -> negatives -> bounds on what is left -> outliers
to NULL -> forward fill -> interpolate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlake.functions import exprs as X
from gridlake.plans.carry import neighbours
from gridlake.plans.grouping import quantiles
from gridlake.plans.materialize import join_small
from gridlake.plans.sequence import DEFAULT_SPEC, SeriesSpec

# Fixed values of the reference's cleaning: IQR multiplier 3.0, forward-fill
# limit 3 rows, interpolation limit 10 rows.
IQR_MULTIPLIER = 3.0
FFILL_LIMIT = 3
INTERP_LIMIT = 10


def to_double(df: DataFrame, cols) -> DataFrame:
    """PRJ5: ``try_cast`` to DOUBLE (unparsable values become NULL)."""
    return df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def quartiles(df: DataFrame, cols: list[str], where=None, key=("site_id",),
              exact: bool = True) -> DataFrame:
    """Q1 / Q3 per key and column (``{c}__q1``, ``{c}__q3``), exact at every
    size unless ``exact=False`` asks for ``percentile_approx``."""
    wanted = {f"_{c}__q": (F.col(c) if where is None else F.when(where, F.col(c)), [0.25, 0.75]) for c in cols}
    g = quantiles(df, key, wanted, exact)
    return g.select(*key, *[e for c in cols for e in (
        F.col(f"_{c}__q")[0].alias(f"{c}__q1"), F.col(f"_{c}__q")[1].alias(f"{c}__q3"))])


def outlier_flag(c: str, multiplier: float = IQR_MULTIPLIER):
    q1, q3 = F.col(f"{c}__q1"), F.col(f"{c}__q3")
    iqr = q3 - q1
    return (F.col(c) < q1 - F.lit(multiplier) * iqr) | (F.col(c) > q3 + F.lit(multiplier) * iqr)


def null_outliers(df: DataFrame, cols: list[str], scope=None, key=("site_id",),
                  exact: bool = True, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """FLT2: values outside [Q1 - m IQR, Q3 + m IQR] become NULL.  Bounds are
    computed over non-NULL rows where ``scope`` holds and applied there only.
    NULL is never an outlier."""
    bounds = quartiles(df, cols, scope, key, exact)
    j = join_small(df, bounds, list(key), "left", name="quartiles")
    out = j
    for c in cols:
        hit = outlier_flag(c, multiplier)
        if scope is not None:
            hit = scope & hit
        out = out.withColumn(c, F.when(hit, F.lit(None).cast("double")).otherwise(F.col(c)))
    return out.drop(*[f"{c}__q{i}" for c in cols for i in (1, 3)])


def fill_expr(c: str, ffill_limit: int, interp_limit: int | None):
    """Closed form of ``ffill(limit=L)`` then ``interpolate(limit=I)`` from
    the previous valid (rn0, v0) and next valid (rn1, v1) row.

    In a gap after v0, position k = rn - rn0: k <= L -> v0; L < k <= L + I ->
    linear between (rn0 + L, v0) and (rn1, v1), or v0 when no v1 follows;
    beyond -> NULL.  Without v0 the gap stays NULL.
    """
    rn0, v0 = F.col(f"{c}__prev.rn"), F.col(f"{c}__prev.v")
    rn1, v1 = F.col(f"{c}__next.rn"), F.col(f"{c}__next.v")
    k = F.col("rn") - rn0
    lim = F.lit(ffill_limit)
    slope = (v1 - v0) / (rn1 - rn0 - lim).cast("double")
    interp = slope * (k - lim).cast("double") + v0
    out = (F.when(F.col(c).isNotNull(), F.col(c))
            .when(v0.isNull(), F.lit(None).cast("double"))
            .when(k <= lim, v0))
    if interp_limit is None:
        out = out.when(v1.isNull(), v0).otherwise(interp)
    else:
        out = (out.when(k - lim > F.lit(interp_limit), F.lit(None).cast("double"))
                  .when(v1.isNull(), v0)
                  .otherwise(interp))
    return out


def fill_gaps(df: DataFrame, rules: dict[str, tuple[int, int | None]],
              spec: SeriesSpec = DEFAULT_SPEC) -> DataFrame:
    """WIN4 + WIN5 for several columns: ``rules = {col: (ffill_limit,
    interp_limit)}``.  Neighbours are found across chunk borders, so a gap
    spanning chunks is filled exactly as in one pass."""
    cols = list(rules)
    nb = neighbours(df, cols, spec)
    out = nb
    for c, (lf, li) in rules.items():
        out = out.withColumn(c, fill_expr(c, lf, li))
    return out.drop(*[f"{c}__prev" for c in cols], *[f"{c}__next" for c in cols])


def ffill_bfill(df: DataFrame, cols: list[str], spec: SeriesSpec = DEFAULT_SPEC) -> DataFrame:
    """WIN6: unlimited forward fill, then backward fill for a leading gap."""
    nb = neighbours(df, cols, spec)
    out = nb
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"{c}__prev.v"), F.col(f"{c}__next.v")))
    return out.drop(*[f"{c}__prev" for c in cols], *[f"{c}__next" for c in cols])


def clean_solar(df: DataFrame, power_cols=("pv_kw",), spec: SeriesSpec = DEFAULT_SPEC,
                exact: bool = True, ts: str = "ts") -> DataFrame:
    """Physics-aware PV cleaning (lineage A ``clean_solar_data``)."""
    cols = list(power_cols)
    d = to_double(df, cols).withColumn("hour", F.hour(ts))
    night = ~X.is_daylight("hour")
    for c in cols:
        d = d.withColumn(c, F.when((F.col(c) < 0) & night, F.lit(0.0))
                            .when(F.col(c) < 0, F.lit(None).cast("double"))
                            .otherwise(F.col(c)))
    d = null_outliers(d, cols, X.is_daylight("hour"), spec.key, exact)
    return fill_gaps(d, {c: (FFILL_LIMIT, INTERP_LIMIT) for c in cols}, spec)


def clean_wind(df: DataFrame, power_cols=("wind_kw",), speed_cols=("wind_speed",),
               spec: SeriesSpec = DEFAULT_SPEC, exact: bool = True) -> DataFrame:
    """Wind cleaning: negatives to 0, IQR outliers over all rows to NULL;
    power gets ffill(3) + interpolate(10), speed interpolate(10) only."""
    cols = list(power_cols) + list(speed_cols)
    d = to_double(df, cols)
    for c in cols:
        d = d.withColumn(c, F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)))
    d = null_outliers(d, cols, None, spec.key, exact)
    rules = {c: (FFILL_LIMIT, INTERP_LIMIT) for c in power_cols}
    rules.update({c: (0, INTERP_LIMIT) for c in speed_cols})
    return fill_gaps(d, rules, spec)


def outlier_bounds(df: DataFrame, cols: list[str], scope=None, key=("site_id",),
                   exact: bool = True, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """FLT2 report: per key and column Q1, Q3, bounds and number of outliers."""
    from gridlake.plans.materialize import broadcast_if_small

    bounds = broadcast_if_small(quartiles(df, cols, scope, key, exact), name="quartiles")
    j = df.join(bounds, list(key), "inner")
    hits = []
    for c in cols:
        hit = outlier_flag(c, multiplier)
        if scope is not None:
            hit = scope & hit
        hits.append(F.count_if(F.coalesce(hit, F.lit(False))).alias(f"{c}__n"))
    wide = j.groupBy(*key).agg(*hits).join(bounds, list(key), "inner")
    m = F.lit(multiplier)
    structs = []
    for c in cols:
        q1, q3 = F.col(f"{c}__q1"), F.col(f"{c}__q3")
        structs.append(F.struct(q1.alias("q1"), q3.alias("q3"), (q1 - m * (q3 - q1)).alias("lower"),
                                (q3 + m * (q3 - q1)).alias("upper"),
                                F.col(f"{c}__n").alias("n_outliers")).alias(c))
    from gridlake.operators.profile import struct_rows

    return struct_rows(wide.select(*key, *structs), list(key), cols)
