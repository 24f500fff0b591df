"""Chunked (skew-safe) evaluation equals single-chunk evaluation.

With ``chunk_rows`` far below the series length every window, fill and fold
crosses many chunk borders; the results must not change."""

import math

from pyspark.sql import functions as F

from gridlake.operators import clean as C
from gridlake.operators import features as FE
from gridlake.operators import merge as M
from gridlake.operators import stateful as ST
from gridlake.operators import telemetry as T
from gridlake.plans.sequence import SeriesSpec, number_rows
from gridlake.sources import fixtures as FX

BIG = SeriesSpec()
SMALL = SeriesSpec(chunk_rows=7, range_partitions=5)


def rows(df, key=("site_id", "row_id")):
    out = {}
    for r in df.collect():
        d = r.asDict()
        out[tuple(d[k] for k in key)] = d
    return out


def same(a, b, tol=1e-9):
    assert a.keys() == b.keys()
    for k in a:
        for c, v in a[k].items():
            w = b[k][c]
            if isinstance(v, float) or isinstance(w, float):
                if v is None or w is None:
                    assert v is None and w is None, (k, c, v, w)
                elif math.isnan(v):
                    assert math.isnan(w)
                else:
                    assert abs(v - w) <= tol * max(1.0, abs(v)), (k, c, v, w)
            else:
                assert v == w, (k, c, v, w)


def test_number_rows_is_dense_and_ordered(spark, sf_small):
    s = FX.solar(spark, sf_small)
    n = number_rows(s, SMALL).select("site_id", "row_id", "ts", "rn").collect()
    by_site = {}
    for r in n:
        by_site.setdefault(r.site_id, []).append(r)
    for site, rs in by_site.items():
        rs.sort(key=lambda r: r.rn)
        assert [r.rn for r in rs] == list(range(len(rs)))
        keys = [(r.ts, r.row_id) for r in rs]
        assert keys == sorted(keys)


def test_windows_chunked_equal(spark, sf_small):
    d = M.dedup_first(FX.solar(spark, sf_small))
    a = rows(FE.pv_features_b(d, spec=BIG))
    b = rows(FE.pv_features_b(d, spec=SMALL))
    same(a, b)


def test_fills_chunked_equal(spark, sf_small):
    s = FX.solar(spark, sf_small)
    same(rows(C.clean_solar(s, spec=BIG)), rows(C.clean_solar(s, spec=SMALL)))
    w = FX.wind(spark, sf_small)
    same(rows(C.clean_wind(w, spec=BIG)), rows(C.clean_wind(w, spec=SMALL)))


def test_folds_chunked_equal(spark, sf_small):
    t = FX.telemetry(spark, sf_small)
    same(rows(ST.soc_balance(t, spec=BIG)), rows(ST.soc_balance(t, spec=SMALL)), 1e-9)
    same(rows(ST.low_pass(t, "frequency", spec=BIG)), rows(ST.low_pass(t, "frequency", spec=SMALL)))
    terms_big = T.control_terms(t, spec=BIG)
    terms_small = T.control_terms(t, spec=SMALL)
    same(rows(ST.agc_integral(terms_big, spec=BIG)), rows(ST.agc_integral(terms_small, spec=SMALL)))


def test_soc_stays_in_bounds(spark, sf_small):
    t = FX.telemetry(spark, sf_small).withColumn("p_battery", F.col("p_battery") * 400)
    out = ST.soc_balance(t, spec=SMALL).agg(F.min("energy_kwh"), F.max("energy_kwh")).first()
    assert out[0] >= 1000.0 - 1e-9 and out[1] <= 9000.0 + 1e-9


def test_long_single_series_chunked_equal(spark):
    """The whole lineitem table of sf0.01 (60k rows) as one series: 12
    chunks of 5000 rows over 16 range partitions equal the plain window."""
    from gridlake.plans.series_queries import YIELD_SPEC, yield_rolling_df

    one = FX.yield_series(spark, "/root/testdata/sf0.01").withColumn("site_id", F.lit(0))
    key = ("l_orderkey", "l_linenumber", "l_partkey", "ts", "pv_kw")
    plain = YIELD_SPEC.__class__(order=YIELD_SPEC.order)
    chunked = YIELD_SPEC.__class__(order=YIELD_SPEC.order, chunk_rows=5000, range_partitions=16)
    same(rows(yield_rolling_df(one, plain), key), rows(yield_rolling_df(one, chunked), key))


def _ramp_reference(targets, cap=5000.0, ramp=100.0):
    y, out = 0.0, []
    for t in targets:
        if t is not None:
            t = min(max(t, 0.0), cap)
            y = y + min(max(t - y, -ramp), ramp)
        out.append(y)
    return out


def test_ramp_follow_monotone_scan_rounds(spark):
    """Targets flipping between 0 and 5000 every step: the trajectories from
    both ends never meet inside a chunk, so chunk starts are resolved in
    rounds; a calm tail lets them meet.  Equal to the sequential loop."""
    import datetime as dt

    targets = [0.0 if i % 2 else 5000.0 for i in range(40)] + [1234.0] * 20 + [None, 4000.0] * 5
    rows = [(s, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), t)
            for s in (0, 1) for i, t in enumerate(targets)]
    df = spark.createDataFrame(rows, "site_id int, row_id long, ts timestamp_ntz, thermal_setpoint double")
    want = _ramp_reference(targets)
    for spec in (BIG, SMALL):
        got = ST.ramp_follow(df, spec=spec).orderBy("site_id", "rn").collect()
        for s in (0, 1):
            vals = [r.p_thermal_dispatch for r in got if r.site_id == s]
            assert vals == want


def _hours(spark, n, values):
    import datetime as dt

    rows = [(0, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), values(i)) for i in range(n)]
    return spark.createDataFrame(rows, "site_id int, row_id long, ts timestamp_ntz, v double")


def test_filtered_series_does_not_depend_on_chunk_rows(spark):
    """Rows numbered before a filter carry gaps in ``rn``; operators number them anew."""
    from gridlake.plans.sequence import number_rows, windowed

    plain = SeriesSpec()
    holes = number_rows(_hours(spark, 24, float), plain).where("row_id % 2 = 0")
    want = [None] + [float(i) for i in range(0, 22, 2)]
    for spec in (plain, plain.with_chunk(4)):
        out = windowed(holes, lambda w: {"p": F.lag("v", 1).over(w)}, halo=1, spec=spec)
        assert [r.p for r in out.orderBy("row_id").collect()] == want


def test_many_unmet_chunks_and_holds(spark):
    """Chunks of flipping targets (never met, one round each) after 30 chunks of NULL
    targets, which pass their start on and need no round."""
    targets = [None] * 240 + [0.0 if i % 2 else 5000.0 for i in range(80)]
    df = _hours(spark, len(targets), lambda i: targets[i]).withColumnRenamed("v", "thermal_setpoint")
    got = ST.ramp_follow(df, spec=SeriesSpec(chunk_rows=8)).orderBy("row_id").collect()
    assert [r.p_thermal_dispatch for r in got] == _ramp_reference(targets)


def _streams_its_rows(spark, df):
    """Rows go through Python batch by batch, with no group of rows held whole."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    return df


def _in_batches_of(spark, n, run):
    """``run()`` with at most ``n`` rows in an Arrow batch."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(conf)
    spark.conf.set(conf, str(n))
    try:
        return run()
    finally:
        spark.conf.set(conf, old)


def test_ramp_follow_streams_batches(spark):
    """States are carried over Arrow batches of 3 rows, in chunks of 7 and in whole series."""
    targets = ([0.0 if i % 2 else 5000.0 for i in range(20)] + [None] * 9 + [70.0 * i for i in range(30)]
               + [None, 4000.0] * 5)
    df = _hours(spark, len(targets), lambda i: targets[i]).withColumnRenamed("v", "thermal_setpoint")
    for spec in (BIG, SMALL):
        got = _in_batches_of(spark, 3, lambda: _streams_its_rows(spark, ST.ramp_follow(df, spec=spec)).collect())
        assert [r.p_thermal_dispatch for r in sorted(got, key=lambda r: r.rn)] == _ramp_reference(targets)


def test_low_pass_streams_batches(spark):
    df = _hours(spark, 60, lambda i: None if i % 11 == 4 else float(i * 37 % 50))
    want, s = [], None
    for i in range(60):
        v = None if i % 11 == 4 else float(i * 37 % 50)
        s = v if s is None else s if v is None else 0.25 * v + 0.75 * s
        want.append(s)
    for spec in (BIG, SMALL):
        got = _in_batches_of(spark, 3, lambda: _streams_its_rows(spark, ST.low_pass(df, "v", spec=spec)).collect())
        got.sort(key=lambda r: r.rn)
        assert all(abs(r.v_smooth - w) < 1e-9 for r, w in zip(got, want, strict=True))


def _terms(spark, n):
    """Rows of two series with the columns of the control terms that the integral reads."""
    d = _hours(spark, n, lambda i: None if i % 13 == 5 else 50.0 + (-1) ** (i // 9) * (i % 7))
    d = d.select("row_id", "ts", F.col("v").alias("frequency"), (F.col("row_id") % 5 * 60000.0).alias("p_actual"),
                 (F.col("row_id") % 3 * 100000.0).alias("p_command"))
    return d.withColumn("site_id", (F.col("row_id") % 2).cast("int"))


def _integral_reference(rows):
    x, out = 0.0, {}
    for r in sorted(rows, key=lambda r: r.row_id):
        if r.frequency is not None:
            x += (5.0 * (50.0 - r.frequency) + 0.5 * (r.p_actual - r.p_command)) / 30.0
        x = min(max(x, -5000.0), 5000.0)
        out[r.row_id] = x
    return out


def test_agc_integral_streams_batches(spark):
    df = _terms(spark, 80)
    want = {}
    for s in (0, 1):
        want |= _integral_reference(df.where(F.col("site_id") == s).collect())
    for spec in (BIG, SMALL):
        got = _in_batches_of(spark, 3, lambda: _streams_its_rows(spark, ST.agc_integral(df, spec=spec)).collect())
        assert len(got) == len(want) and all(abs(r.p_agc - want[r.row_id]) < 1e-6 for r in got)
        assert {type(r.row_id) for r in got} == {int} and "_first" not in got[0].asDict()


def test_kpi_gate_streams_batches(spark, sf_small):
    t = FX.telemetry(spark, sf_small)

    def gate(spec):
        terms = ST.agc_integral(T.control_terms(t, spec=spec), spec=spec)
        return _streams_its_rows(spark, T.kpi_gate(T.telemetry_kpis(terms)))

    want = rows(gate(BIG), ("site_id",))
    same(want, _in_batches_of(spark, 5, lambda: rows(gate(BIG.with_chunk(30)), ("site_id",))))
