"""Hand-made unit tables (FIXTURES.md section 4) with literal expectations."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridlake.functions import exprs as X
from gridlake.operators import clean as C
from gridlake.operators import evaluate as E
from gridlake.operators import features as FE
from gridlake.operators import merge as M
from gridlake.operators import profile as P
from gridlake.operators import stateful as ST
from gridlake.operators import validate as V
from gridlake.plans.sequence import SeriesSpec, windowed
from gridlake.sources import files as FS

T0 = dt.datetime(2024, 1, 1)
SPECS = [SeriesSpec(), SeriesSpec(chunk_rows=4, range_partitions=3)]


def series(spark, values, col="v", step_h=1):
    rows = [(0, i, T0 + dt.timedelta(hours=step_h * i), None if v is None else float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"site_id int, row_id long, ts timestamp_ntz, {col} double")


def ordered(df, col):
    return [r[col] for r in df.orderBy("ts", "row_id").collect()]


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) < 1e-8


@pytest.mark.parametrize("spec", SPECS)
def test_gap18(spark, spec):
    vals = [None, 1] + [None] * 18 + [21] + [None] * 15
    out = ordered(C.fill_gaps(series(spark, vals), {"v": (3, 10)}, spec), "v")
    want = ([None, 1, 1, 1, 1, 2.25, 3.5, 4.75, 6, 7.25, 8.5, 9.75, 11, 12.25, 13.5]
            + [None] * 5 + [21] + [21] * 13 + [None] * 2)
    assert len(out) == len(want)
    assert all(close(a, b) for a, b in zip(out, want)), out


def test_ties_mode(spark):
    hours = [0, 1, 3, 4, 6]
    rows = [(0, i, T0 + dt.timedelta(hours=h), 1.0) for i, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "site_id int, row_id long, ts timestamp_ntz, pv_kw double")
    rep = P.quality_report(df, ["pv_kw"], ["pv_kw"]).first()
    assert rep.modal_step_s == 3600.0
    assert rep.n_gaps == 2


def test_grid(spark):
    r = spark.createDataFrame([(0, T0.replace(minute=7), T0.replace(minute=50))],
                              "site_id int, common_start timestamp_ntz, common_end timestamp_ntz")
    got = sorted(x.ts for x in V.time_grid(r, 15).collect())
    assert got == [T0.replace(minute=7), T0.replace(minute=22), T0.replace(minute=37)]


def test_grid_long_range_rows(spark):
    end = T0 + dt.timedelta(days=30)
    r = spark.createDataFrame([(0, T0, end)], "site_id int, common_start timestamp_ntz, common_end timestamp_ntz")
    assert V.time_grid(r, 15).count() == 30 * 96 + 1


def test_nullclip(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-1.0,), (0.5,)], "x double")
    got = [r.c for r in df.select(X.clip("x", 0.0, 1.0).alias("c")).collect()]
    assert got == [None, 1.0, 0.0, 0.5]


@pytest.mark.parametrize("spec", SPECS)
def test_roll3(spark, spec):
    df = series(spark, [1, None, 3, 7])

    def cols(w):
        f = w.rowsBetween(-2, 0)
        return {"m": F.avg("v").over(f), "s": F.stddev_samp("v").over(f)}
    out = windowed(df, cols, halo=2, spec=spec).orderBy("ts").collect()
    assert [r.m for r in out] == [1.0, 1.0, 2.0, 5.0]
    assert out[0].s is None and out[1].s is None
    assert math.isclose(out[2].s, 1.41421356, rel_tol=1e-7)
    assert math.isclose(out[3].s, 2.82842712, rel_tol=1e-7)


def test_nat_join(spark):
    l = spark.createDataFrame([(0, None, 1.0), (0, T0, 2.0)], "site_id int, ts timestamp_ntz, a double")
    r = spark.createDataFrame([(0, None, 3.0)], "site_id int, ts timestamp_ntz, b double")
    assert M.join_sources(l, r, null_safe=True).count() == 1
    assert M.join_sources(l, r).count() == 0


def test_h18(spark):
    df = spark.createDataFrame([(18, 5.0)], "hour int, ghi double")
    row = df.select(X.clearness_index("ghi", "hour").alias("p"),
                    X.clearness_index("ghi", "hour", strict=True).alias("s")).first()
    assert row.p == 1.0 and row.s == 0.0


def test_zero_div(spark):
    df = spark.createDataFrame([(0, 1, T0, 20.0, 50.0, 10.0, 0.0, 5.0)],
                               "site_id int, row_id long, ts timestamp_ntz, temp_c double, "
                               "humidity double, ghi double, upper_rad double, pv_kw double")
    out = FE.pv_features_b(df).first()
    assert out.radiation_ratio is None and out.pv_per_wm2 == 0.5


def test_soc_bounds(spark):
    charge = spark.createDataFrame([(0, i, T0 + dt.timedelta(hours=i), -7000.0) for i in range(40)],
                                   "site_id int, row_id long, ts timestamp_ntz, p_battery double")
    out = ST.soc_balance(charge).orderBy("rn").collect()
    assert max(r.energy_kwh for r in out) == 9000.0
    assert out[-1].p_moved == 0.0
    discharge = charge.withColumn("p_battery", F.lit(7000.0))
    out = ST.soc_balance(discharge).orderBy("rn").collect()
    assert min(r.energy_kwh for r in out) == 1000.0
    assert out[-1].p_moved == 0.0
    # the step that hits the bound moves only what was available
    hit = [r for r in out if r.energy_kwh == 1000.0][0]
    assert 0.0 < hit.p_moved < 7000.0


def test_folds(spark):
    df = series(spark, list(range(13)))
    f = E.cv_folds(df).collect()
    test0 = sorted(r.rn for r in f if r.fold == 0 and r.role == "test")
    train0 = sorted(r.rn for r in f if r.fold == 0 and r.role == "train")
    assert test0 == [3, 4] and train0 == [0, 1, 2]
    for k in range(5):
        tr = [r.rn for r in f if r.fold == k and r.role == "train"]
        te = [r.rn for r in f if r.fold == k and r.role == "test"]
        assert max(tr) < min(te) and len(te) == 2


def test_drift(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "x", 1.0, 2.0)],
                               "`Date - Time ` string, `Time` string, `Air Density` double, `Wind Speed ` double")
    table, drift = FS.normalize_headers(df, FS.WIND_COLUMNS, FS.WIND_CANONICAL, "w1.xlsx")
    assert table.columns == ["ts", "time_text", "air_density", "wind_speed", "wind_kw"]
    status = {r.expected: r.status for r in drift.collect()}
    assert status["Power Generation"] == "missing"
    assert status["Date-Time"] == "renamed"
    assert table.first().wind_kw is None


def test_timestamp_resolution(spark):
    df = spark.createDataFrame([("2024-01-01 05:00:00", "7", "bad")],
                               "`Date-Time` string, `Unnamed: 0` string, `PV Generation (KW)` string")
    out = FS.resolve_timestamp(FS.drop_unnamed(df))
    assert out.columns == ["PV Generation (KW)", "timestamp"]
    casted = C.to_double(out, ["PV Generation (KW)"]).first()
    assert casted["PV Generation (KW)"] is None
    assert FS.find_column(df, ("pv", "generation")) == "PV Generation (KW)"


def test_sinks(spark, sf_small):
    import json
    import os
    import tempfile

    from gridlake.operators import telemetry as TM
    from gridlake.sources import fixtures as FX

    kpis = TM.telemetry_kpis(TM.control_terms(FX.telemetry(spark, sf_small)))
    out = tempfile.mkdtemp(prefix="gridlake-sink-")
    FS.write_metrics_json(kpis, f"{out}/metrics")
    lines = [json.loads(x) for f in os.listdir(f"{out}/metrics") if f.endswith(".json")
             for x in open(f"{out}/metrics/{f}")]
    assert len(lines) == kpis.count() and "stability_rate" in lines[0]
    kv = FS.key_value_rows(kpis)
    assert kv.count() == kpis.count() * (len(kpis.columns) - 1)
    FS.write_summary(kpis, f"{out}/summary")
    back = spark.read.option("header", True).csv(f"{out}/summary")
    assert back.columns == ["site_id", "name", "value"]
    FS.write_table(FX.solar(spark, sf_small), f"{out}/solar")
    assert sorted(os.listdir(f"{out}/solar"))[0].startswith("_SUCCESS") or any(
        d.startswith("site_id=") for d in os.listdir(f"{out}/solar"))


def test_find_column_first_and_last(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)],
                               "`Ground Radiation A` double, `Ground Radiation B` double, `Wind Speed` double")
    assert FS.find_column(df, ("ground", "radiation"), last=False) == "Ground Radiation A"
    assert FS.find_column(df, ("ground", "radiation")) == "Ground Radiation B"
    assert FS.find_column(df, ("speed",), ("wind",)) == "Wind Speed"


def test_bounded_group_statistics(spark):
    from pyspark.sql import Window

    from gridlake.plans.grouping import exact_quantiles, modal_values, top_k_per_key

    rows = [(0, "b"), (0, "a"), (0, "b"), (0, "a"), (0, None), (1, None), (2, "z")]
    df = spark.createDataFrame(rows, "site_id int, s string")
    got = {r.site_id: r.s for r in modal_values(df, ["site_id"], ["s"], default="").collect()}
    assert got == {0: "a", 1: "", 2: "z"}

    nums = spark.range(0, 5000).selectExpr("cast(id % 3 as int) as site_id",
                                           "cast((id * 7919) % 997 as double) as v")
    top = top_k_per_key(nums, ["site_id"], [F.desc("v"), F.asc("v")], 5, F.col("v"), 8)
    w = Window.partitionBy("site_id").orderBy(F.desc("v"))
    plain = nums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5)
    assert sorted((r.site_id, r.v) for r in top.collect()) == sorted((r.site_id, r.v) for r in plain.collect())

    import numpy as np
    pdf = nums.toPandas()
    for r in exact_quantiles(nums, ["site_id"], {"q": (F.col("v"), [0.0, 0.25, 0.6, 1.0])}).collect():
        assert np.allclose(r.q, np.quantile(pdf.v[pdf.site_id == r.site_id], [0.0, 0.25, 0.6, 1.0]))
    exact = C.quartiles(nums, ["v"], exact=True).orderBy("site_id").collect()
    approx = C.quartiles(nums, ["v"], exact=False).orderBy("site_id").collect()
    for a, b in zip(exact, approx):
        assert abs(a.v__q1 - b.v__q1) <= 2.0 and abs(a.v__q3 - b.v__q3) <= 2.0


def test_small_inventory_operators(spark):
    """PRJ6 parse report, AGG10 text modes, AGG8 infinite counts, PRJ11
    coercion, JN5 keyed sum and the linear re-aim of ML10."""
    from gridlake.operators import merge as MG
    from gridlake.operators import models as MD
    from gridlake.operators import prep as PR

    raw = spark.createDataFrame([(0, "2024-01-01 00:00:00", "a"), (0, "junk", "b"), (0, None, "b"),
                                 (1, "2024-01-02 00:00:00", None)],
                                "site_id int, raw string, label string")
    parsed = FS.parse_timestamp(raw.withColumn("raw_copy", F.col("raw")), "raw_copy", "ts")
    rep = {r.site_id: (r.n_invalid, r.n_missing) for r in V.parse_report(parsed, "raw", "ts").collect()}
    assert rep[0] == (1, 2) and rep[1] == (0, 0)
    modes = {r.site_id: r.label for r in P.text_modes(raw, ["label"]).collect()}
    assert modes == {0: "b", 1: ""}

    nums = spark.createDataFrame([(0, float("inf"), "1.5"), (0, 2.0, "x"), (1, float("-inf"), "3")],
                                 "site_id int, a double, t string")
    assert {r.site_id: r.n_infinite for r in PR.infinite_counts(nums).collect()} == {0: 1, 1: 1}
    co = PR.coerce_numeric(nums, ["t"]).orderBy("site_id", "a").collect()
    assert [r.t for r in co] == [None, 1.5, 3.0]  # ordered by a: 2.0, inf, -inf (site 1)

    left = spark.createDataFrame([(0, T0, 1.0), (0, T0.replace(hour=1), 2.0)], "site_id int, ts timestamp_ntz, a double")
    right = spark.createDataFrame([(0, T0, 10.0)], "site_id int, ts timestamp_ntz, b double")
    assert [r.total for r in MG.keyed_sum(left, right, "a", "b", "total").collect()] == [11.0]

    train = spark.range(0, 50).selectExpr("cast(id as double) as x", "2.0 * id + 1.0 as y")
    model = MD.fit(MD.linear_pipeline(["x"], "y"), train)
    pred = MD.predict(model, train).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert pred < 1e-6


def test_cross_validate_folds(spark, sf_small):
    from gridlake.operators import models as MD
    from gridlake.plans.model_prep_queries import pv_imputed

    d, feats = MD.model_frame(pv_imputed(spark, sf_small).drop("rn"), "pv_kw")
    d = d.na.drop(subset=feats + ["pv_kw"])
    out = MD.cross_validate(d, feats, "pv_kw", lambda f, t: MD.forest_pipeline(f, t, 5, 3)).collect()
    assert sorted(r.fold for r in out) == [0, 1, 2, 3, 4]
    assert all(r.n > 0 and r.rmse >= 0 for r in out)


def test_splits_number_rows_themselves(spark):
    """Half of the numbered rows, chosen by a filter: numbers that came along have gaps."""
    from gridlake.operators import evaluate as E
    from gridlake.operators import telemetry as T
    from gridlake.plans.sequence import number_rows

    rows = [(1, f"2024-01-01 {i:02d}:00:00", i, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "site_id int, ts string, row_id bigint, p_renewable double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    half = number_rows(df).where("rn % 2 = 1")
    split = E.chrono_split(half).collect()
    assert sorted(r.rn for r in split) == list(range(10))
    assert [r.holdout_role for r in sorted(split, key=lambda r: r.rn)] == ["train"] * 8 + ["test"] * 2
    folds = E.cv_folds(half).where("role = 'test'").groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in folds} == {k: 1 for k in range(5)}
    hours = [r.hours for r in T.load_profile(half).orderBy("row_id").collect()]
    assert hours == [pytest.approx(i / 30) for i in range(10)]


def test_merged_tables_are_ordered_by_time(spark):
    from gridlake.operators import evaluate as E
    from gridlake.operators import prep as PR

    rows = [(1, f"2024-01-01 {i:02d}:00:00", 7 - i, 10 + i, None if i in (0, 3) else float(i), None if i == 2 else float(i * i))
            for i in range(6)]
    df = spark.createDataFrame(rows, "site_id int, ts string, row_id_solar bigint, row_id_wind bigint, solar_lag_1 double, "
                                     "wind_kw double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = PR.impute(df, PR.MERGED_POLICY).orderBy("ts").collect()
    assert [r.solar_lag_1 for r in got] == [1.0, 1.0, 2.0, 2.0, 4.0, 5.0]
    assert got[2].wind_kw == 9.0 and got[0].row_id_solar == 7
    assert [r.holdout_role for r in E.chrono_split(df).orderBy("ts").collect()] == ["train"] * 4 + ["test"] * 2


def _numpy_quantiles(rows, qs):
    import numpy as np

    by = {}
    for k, v, w in rows:
        for name, x in (("v", v), ("w", w)):
            if x is not None:
                by.setdefault((k, name), []).append(x)
    return {kn: [float(np.quantile(x, q)) for q in qs[kn[1]]] for kn, x in by.items()}


@pytest.mark.parametrize("held", [10**9, 0])
def test_quantiles_held_and_selected(spark, held):
    """Continuous, discrete, constant, missing and skewed columns, a large and tiny keys."""
    import random

    from gridlake.plans.grouping import exact_quantiles

    rnd = random.Random(2)
    rows = [(1, rnd.gauss(0, 5), float(rnd.choice([1, 1, 1, 2, 9]))) for _ in range(30_000)]
    rows += [(2, rnd.expovariate(1) ** 3 if rnd.random() < .8 else None, 7.0) for _ in range(4_000)]
    rows += [(3, None, 1.0), (3, None, 2.0), (4, 5.0, None), (5, None, None)] + [(6, float(i), -float(i)) for i in range(11)]
    df = spark.createDataFrame(rows, "k int, v double, w double").repartition(5)
    qs = {"v": [0.25, 0.5, 0.75, 0.9], "w": [0.0, 0.5, 1.0]}
    got = {r.k: r for r in exact_quantiles(df, ["k"], {n: (F.col(n), q) for n, q in qs.items()}, held_cells=held).collect()}
    want = _numpy_quantiles(rows, qs)
    assert set(got) == {k for k, _ in want} == {1, 2, 3, 4, 6}
    for (k, name), values in want.items():
        assert got[k][name] == pytest.approx(values, abs=1e-12)


def test_selection_shuffles_a_small_share(spark):
    """Values between the brackets: about one in a hundred per wanted rank."""
    from gridlake.plans import grouping as G

    df = spark.range(200_000).select(F.lit(1).alias("k"), F.rand(3).alias("v"))
    seen = []
    ranked = G._ranked
    try:
        G._ranked = lambda counts, series: (seen.append(counts.count()), ranked(counts, series))[1]
        out = G.exact_quantiles(df, ["k"], {"q": (F.col("v"), [0.25, 0.5, 0.75])}, held_cells=0).first()
    finally:
        G._ranked = ranked
    assert seen and seen[0] < 0.05 * 200_000
    assert out.q == pytest.approx([0.25, 0.5, 0.75], abs=0.01)


def test_a_missed_bracket_falls_back_to_sorting(spark, monkeypatch):
    from gridlake.plans import grouping as G

    monkeypatch.setattr(G, "_selected_quantiles", lambda *a: None)
    df = spark.range(101).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    assert G.exact_quantiles(df, ["k"], {"q": (F.col("v"), [0.1, 0.505])}, held_cells=0).first().q == [10.0, 50.5]


def test_counter_normal_is_normal_and_fixed(spark):
    df = spark.range(20_000).withColumnRenamed("id", "row_id")
    n = df.select("row_id", X.counter_normal(42, "ghi", "row_id").alias("a"), X.counter_normal(42, "pv", "row_id").alias("b"))
    m = n.agg(F.avg("a").alias("m"), F.stddev("a").alias("s"), F.corr("a", "b").alias("c"), F.kurtosis("a").alias("k")).first()
    assert abs(m.m) < 0.03 and abs(m.s - 1) < 0.03 and abs(m.c) < 0.03 and abs(m.k) < 0.15
    other = df.repartition(7).select("row_id", X.counter_normal(42, "ghi", "row_id").alias("a"))
    assert n.select("row_id", "a").exceptAll(other).count() == 0


def test_ridge_equals_numpy_and_carries_on(spark):
    import numpy as np

    from gridlake.operators import ridge as RG

    rnd = np.random.default_rng(5)
    x = rnd.normal(3, 2, (300, 3))
    y = x @ [1.5, -2.0, 0.3] + 4 + rnd.normal(0, 0.1, 300)
    rows = [(i % 2, float(a), float(b), float(c), float(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))] + [(0, None, 1.0, 1.0, 1e9)]
    df = spark.createDataFrame(rows, "site_id int, a double, b double, c double, t double")
    model = {r.site_id: r for r in RG.fit(df, ["a", "b", "c"], "t", 0.5).collect()}
    for k in (0, 1):
        xs, ys = x[k::2], y[k::2]
        c = np.cov(xs.T, bias=True) + 0.5 * np.eye(3)
        w = np.linalg.solve(c, ((xs - xs.mean(0)).T @ (ys - ys.mean())) / len(xs))
        assert model[k].weights == pytest.approx(w.tolist()) and model[k].intercept == pytest.approx(ys.mean() - w @ xs.mean(0))
    # a series that follows its lags exactly is carried on by the same rule
    series = [1.0, 2.0, 0.5, 1.0]
    for _ in range(40):
        series.append(0.3 + 0.5 * series[-1] - 0.2 * series[-2] + 0.1 * series[-4])
    s = spark.createDataFrame([(1, T0 + dt.timedelta(hours=i), i, v) for i, v in enumerate(series[:30])] + [(2, T0, 0, 1.0)],
                              "site_id int, ts timestamp_ntz, row_id bigint, v double")
    known = spark.createDataFrame([(1, 0.3, [0.5, -0.2, 0.1]), (2, 0.0, [1.0, 0.0, 0.0])], "site_id int, intercept double, weights array<double>")
    got = {(r.site_id, r.step): r.prediction for r in RG.forecast(known, s, "v", 5).collect()}
    assert got == {(1, k): pytest.approx(series[29 + k]) for k in range(1, 6)}  # site 2 is shorter than its longest lag
