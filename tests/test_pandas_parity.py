"""Operators against pandas itself (the reference's engine) on random series.

Series have NULL runs of every length (leading, trailing, 1-20 long), so the
closed forms of the fills and the NULL handling of windows and statistics
are compared with the library behaviour they re-express."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlake.operators import clean as C
from gridlake.operators import profile as P
from gridlake.plans.sequence import SeriesSpec, windowed

T0 = dt.datetime(2024, 1, 1)
N_SITES, N_ROWS = 24, 80


def _series(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for site in range(N_SITES):
        vals = rng.normal(50, 20, N_ROWS)
        mask = np.zeros(N_ROWS, bool)
        i = int(rng.integers(0, 3))          # sometimes a leading gap
        mask[:i] = True
        while i < N_ROWS:
            i += int(rng.integers(1, 8))
            run = int(rng.integers(1, 21))
            mask[i:i + run] = True
            i += run
        if site % 3 == 0:
            mask[-int(rng.integers(1, 16)):] = True  # trailing gap
        for j in range(N_ROWS):
            v = None if mask[j] else float(vals[j])
            w = None if mask[(j + 5) % N_ROWS] else float(vals[j] / 3)
            rows.append((site, site * 1000 + j, T0 + dt.timedelta(hours=j), v, w))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = _series(7)
    df = spark.createDataFrame(rows, "site_id int, row_id long, ts timestamp_ntz, v double, w double")
    pdf = pd.DataFrame(rows, columns=["site_id", "row_id", "ts", "v", "w"]).astype({"v": float, "w": float})
    return df, pdf


def _eq(a, b, tol=1e-9):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    if b is None or (isinstance(b, float) and math.isnan(b)):
        return False
    return abs(a - b) <= tol * max(1.0, abs(a))


def _by_row(df, cols):
    return {r.row_id: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("spec", [SeriesSpec(), SeriesSpec(chunk_rows=9, range_partitions=6)])
def test_fill_matches_pandas(spark, data, spec):
    df, pdf = data
    got = _by_row(C.fill_gaps(df, {"v": (3, 10), "w": (0, 10)}, spec), ["v", "w"])
    for _, g in pdf.groupby("site_id"):
        v = g["v"].ffill(limit=3).interpolate(method="linear", limit=10)
        w = g["w"].interpolate(method="linear", limit=10)
        for rid, a, b in zip(g["row_id"], v, w):
            assert _eq(got[rid][0], a), (rid, got[rid][0], a)
            assert _eq(got[rid][1], b), (rid, got[rid][1], b)


@pytest.mark.parametrize("spec", [SeriesSpec(), SeriesSpec(chunk_rows=9, range_partitions=6)])
def test_windows_match_pandas(spark, data, spec):
    df, pdf = data

    def cols(w):
        f6 = w.rowsBetween(-5, 0)
        return {"lag3": F.lag("v", 3).over(w), "diff": F.col("v") - F.lag("v", 1).over(w),
                "m6": F.avg("v").over(f6), "s6": F.stddev_samp("v").over(f6)}
    got = _by_row(windowed(df, cols, halo=6, spec=spec), ["lag3", "diff", "m6", "s6"])
    for _, g in pdf.groupby("site_id"):
        s = g["v"]
        ref = zip(g["row_id"], s.shift(3), s.diff(), s.rolling(6, min_periods=1).mean(),
                  s.rolling(6, min_periods=1).std())
        for rid, *vals in ref:
            for a, b in zip(got[rid], vals):
                assert _eq(a, b, 1e-7), (rid, got[rid], vals)


def test_statistics_match_pandas(spark, data):
    df, pdf = data
    q = {r.site_id: (r.v__q1, r.v__q3) for r in C.quartiles(df, ["v"]).collect()}
    stats = {(r.site_id, r.column): r for r in P.column_stats(df, ["v", "w"]).collect()}
    corr = {(r.site_id, r.feature): r.abs_corr for r in P.correlation_top(df, ["w"], "v", 6).collect()}
    for site, g in pdf.groupby("site_id"):
        assert _eq(q[site][0], g["v"].quantile(0.25)) and _eq(q[site][1], g["v"].quantile(0.75))
        st = stats[(site, "v")]
        assert _eq(st.median, g["v"].median()) and _eq(st.std, g["v"].std())
        assert st.n_missing == int(g["v"].isna().sum())
        assert _eq(corr[(site, "w")], abs(g[["v", "w"]].corr().loc["v", "w"]), 1e-7)
