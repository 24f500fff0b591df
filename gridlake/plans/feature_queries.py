"""Registered queries: features (SC1-SC16, WIN1-WIN3, AGG1, JN2)."""

from __future__ import annotations

from gridlake.operators import features as FE
from gridlake.operators import merge as M
from gridlake.operators import profile as P
from gridlake.plans.merge_queries import MERGED_DOUBLES, merged_table
from gridlake.plans.registry import register
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX

D = "AS DOUBLE"
W = "OVER (PARTITION BY site_id ORDER BY ts, row_id"


def c(x) -> str:
    return f"CAST({x} {D})"


def clip_sql(x: str, lo, hi) -> str:
    return (f"CASE WHEN ({x}) IS NULL THEN CAST(NULL {D}) WHEN ({x}) < {c(lo)} THEN {c(lo)} "
            f"WHEN ({x}) > {c(hi)} THEN {c(hi)} ELSE ({x}) END")


def guarded(num: str, den: str, cond: str) -> str:
    return f"CASE WHEN {cond} THEN {num} / ({den} + {c('1e-6')}) ELSE {c(0)} END"


def sdiv(num: str, den: str) -> str:
    """Division with a zero divisor giving NULL (pandas: inf/NaN -> NaN)."""
    return f"CASE WHEN {den} = 0 THEN CAST(NULL {D}) ELSE {num} / {den} END"


def cyc(x: str, period) -> tuple[str, str]:
    a = f"2 * pi() * CAST({x} {D}) / {c(period)}"
    return f"sin({a})", f"cos({a})"


EXT = (f"{c(1367)} * greatest({c(0)}, sin(pi() * (coalesce(CAST(hour {D}), {c(12)}) - {c(6)}) "
       f"/ {c(12)}))")
THEO = (f"{c(0.5)} * air_density * {c(100)} * (wind_speed * wind_speed * wind_speed) "
        f"/ {c(1000)}")


def _cal_a_sql() -> str:
    hs, hc = cyc("hour", 24)
    ds, dc = cyc("day_of_year", 365)
    return f"""cal AS (
  SELECT *, {hs} AS hour_sin, {hc} AS hour_cos, {ds} AS day_sin, {dc} AS day_cos FROM (
    SELECT *, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
           CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(month(ts) AS INTEGER) AS month,
           CAST(weekofyear(ts) AS INTEGER) AS week_of_year
    FROM phys))"""


PHYS_SQL = f"""phys AS (
  SELECT *, {clip_sql(guarded('ghi', 'ext', 'ext > ' + c(0)), 0, 1)} AS clearness_index_kt,
         {clip_sql(guarded('wind_kw', 'theo', 'theo > ' + c(0.1)), 0, 0.593)} AS wind_power_coefficient_cp,
         {clip_sql(guarded('pv_kw', 'ghi', 'ghi > ' + c(10)), 0, 1)} AS solar_efficiency,
         {guarded('wind_kw', 'wind_speed', 'wind_speed > ' + c(0.5))} AS wind_power_per_speed
  FROM (SELECT *, {EXT} AS ext, {THEO} AS theo FROM (
          SELECT *, CAST(hour(ts) AS INTEGER) AS hour FROM merged)))"""

PHYS_COLS = ["clearness_index_kt", "wind_power_coefficient_cp", "solar_efficiency",
             "wind_power_per_speed"]
CAL_A_COLS = ["day_of_week", "day_of_year", "month", "week_of_year"]
CAL_A_DOUBLES = ["hour_sin", "hour_cos", "day_sin", "day_cos"]


def _temporal_a_sql() -> tuple[str, list[str]]:
    w = "OVER (PARTITION BY site_id ORDER BY ts"
    parts, doubles = [], []
    for name, col in (("solar", "pv_kw"), ("wind", "wind_kw")):
        for k in FE.LAGS_A:
            parts.append(f"lag({col}, {k}) {w}) AS {name}_lag_{k}")
            doubles.append(f"{name}_lag_{k}")
    for name, col in (("solar", "pv_kw"), ("wind", "wind_kw")):
        parts.append(f"avg({col}) {w} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS {name}_rolling_mean_6h")
        parts.append(f"stddev_samp({col}) {w} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) "
                     f"AS {name}_rolling_std_6h")
        doubles += [f"{name}_rolling_mean_6h", f"{name}_rolling_std_6h"]
    for name, col in (("solar", "pv_kw"), ("wind", "wind_kw"), ("total", "total_renewable_power")):
        parts.append(f"{col} - lag({col}, 1) {w}) AS {name}_rate_of_change")
        parts.append(f"abs({col} - lag({col}, 1) {w})) AS {name}_volatility")
        doubles += [f"{name}_rate_of_change", f"{name}_volatility"]
    return ",\n  ".join(parts), doubles


TEMPORAL_A, TEMPORAL_A_DOUBLES = _temporal_a_sql()

# Lineage A feature table as CTEs: ``fe`` is the full engineered table.
ENGINEERED_CTES = [S.SOLAR, S.WIND, S.SOLAR_DEDUP, S.WIND_DEDUP, S.MERGED, PHYS_SQL, _cal_a_sql(),
                   f"""fe AS (
  SELECT * EXCLUDE (ext, theo),
    CAST(row_number() OVER (PARTITION BY site_id ORDER BY ts) - 1 AS BIGINT) AS rn,
    {TEMPORAL_A}
  FROM cal)"""]
ENGINEERED_SQL = S.with_ctes(*ENGINEERED_CTES) + "SELECT * FROM fe"


@register("engineered_features", sql=ENGINEERED_SQL,
          doubles=MERGED_DOUBLES + PHYS_COLS + CAL_A_DOUBLES + TEMPORAL_A_DOUBLES,
          operators=("SC1", "SC3", "SC4", "SC5", "SC8", "SC9", "WIN1", "WIN2", "WIN3",
                     "SC6", "SC7"))
def engineered_features(spark, sf_dir):
    return FE.engineered_a(merged_table(spark, sf_dir))


PHYSICS_SQL = S.with_ctes(S.SOLAR, S.WIND, S.SOLAR_DEDUP, S.WIND_DEDUP, S.MERGED, PHYS_SQL) + \
    "SELECT * EXCLUDE (ext, theo) FROM phys"


@register("physics_features", sql=PHYSICS_SQL, doubles=MERGED_DOUBLES + PHYS_COLS,
          operators=("SC4", "SC5", "SC8", "SC9"))
def physics_features(spark, sf_dir):
    return FE.physics_a(merged_table(spark, sf_dir))


STRICT_SQL = PHYSICS_SQL.replace("ext > CAST(0 AS DOUBLE)", "ext > CAST(1e-3 AS DOUBLE)")


@register("clearness_strict", sql=STRICT_SQL, doubles=MERGED_DOUBLES + PHYS_COLS,
          operators=("SC4",))
def clearness_strict(spark, sf_dir):
    return FE.physics_a(merged_table(spark, sf_dir), strict=True)


def _cal_b_sql(src: str) -> str:
    hs, hc = cyc("hour", 24)
    return f"""SELECT *, {hs} AS sin_hour, {hc} AS cos_hour FROM (
    SELECT *, CAST(hour(ts) AS INTEGER) AS hour, CAST(day(ts) AS INTEGER) AS day,
           CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
           CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend
    FROM {src})"""


CAL_B_DOUBLES = ["sin_hour", "cos_hour"]

def pv_b_body(src: str) -> str:
    """Lineage B PV features over ``src`` (de-duplicated rows with calendar B)."""
    return f"""SELECT *, {clip_sql('pv_per_wm2', 0, 0.3)} AS pv_efficiency FROM (
SELECT *,
  {sdiv('ghi', 'upper_rad')} AS radiation_ratio,
  temp_c * temp_c AS temp_squared,
  CASE WHEN temp_c - {c(25)} IS NULL THEN NULL
       WHEN temp_c - {c(25)} < {c(0)} THEN {c(0)} ELSE temp_c - {c(25)} END AS temp_derating,
  {sdiv('pv_kw', 'ghi')} AS pv_per_wm2,
  CAST(row_number() {W}) - 1 AS BIGINT) AS rn,
  ghi - lag(ghi, 1) {W}) AS radiation_change,
  lag(pv_kw, 1) {W}) AS pv_lag_1,
  lag(pv_kw, 3) {W}) AS pv_lag_3,
  avg(pv_kw) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS pv_roll_mean_3,
  stddev_samp(pv_kw) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS pv_roll_std_3,
  pv_kw - lag(pv_kw, 1) {W}) AS pv_ramp_rate
FROM {src})"""


# ``pf`` is the PV feature table of lineage B.
PV_B_CTES = [S.SOLAR, S.SOLAR_DEDUP, f"pb AS ({_cal_b_sql('solar_d')})", f"pf AS ({pv_b_body('pb')})"]
PV_B_SQL = S.with_ctes(*PV_B_CTES) + "SELECT * FROM pf"

PV_B_DOUBLES = ["temp_c", "humidity", "ghi", "upper_rad", "pv_kw", "radiation_ratio", "temp_squared",
                "temp_derating", "pv_per_wm2", "pv_efficiency", "radiation_change", "pv_lag_1",
                "pv_lag_3", "pv_roll_mean_3", "pv_roll_std_3", "pv_ramp_rate"] + CAL_B_DOUBLES


@register("pv_features_b", sql=PV_B_SQL, doubles=PV_B_DOUBLES,
          operators=("SC2", "SC3", "SC10", "SC11", "SC12", "SC15", "WIN1", "WIN2", "WIN3", "WIN8"))
def pv_features_b(spark, sf_dir):
    return FE.pv_features_b(M.dedup_first(FX.solar(spark, sf_dir)))


def wind_b_body(src: str) -> str:
    """Lineage B wind features over ``src``."""
    return f"""SELECT *, {sdiv('wind_roll_std_3', 'wind_roll_mean_3')} AS turbulence_intensity FROM (
SELECT *,
  wind_speed * wind_speed * wind_speed AS wind_speed_cubed,
  {c(0.5)} * air_density * (wind_speed * wind_speed * wind_speed) AS wind_power_density,
  {sdiv('wind_kw', 'wind_speed')} AS power_per_ws,
  CAST(row_number() {W}) - 1 AS BIGINT) AS rn,
  lag(wind_kw, 1) {W}) AS wind_lag_1,
  avg(wind_kw) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS wind_roll_mean_3,
  stddev_samp(wind_kw) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS wind_roll_std_3,
  wind_kw - lag(wind_kw, 1) {W}) AS wind_ramp
FROM {src})"""


# ``wf`` is the wind feature table of lineage B.
WIND_B_CTES = [S.WIND, S.WIND_DEDUP, f"wb AS ({_cal_b_sql('wind_d')})", f"wf AS ({wind_b_body('wb')})"]
WIND_B_SQL = S.with_ctes(*WIND_B_CTES) + "SELECT * FROM wf"

WIND_B_DOUBLES = ["air_density", "wind_speed", "wind_kw", "wind_speed_cubed", "wind_power_density",
                  "power_per_ws", "wind_lag_1", "wind_roll_mean_3", "wind_roll_std_3", "wind_ramp",
                  "turbulence_intensity"] + CAL_B_DOUBLES


@register("wind_features_b", sql=WIND_B_SQL, doubles=WIND_B_DOUBLES,
          operators=("SC2", "SC3", "SC10", "SC13", "SC14", "WIN1", "WIN2", "WIN3", "WIN8"))
def wind_features_b(spark, sf_dir):
    return FE.wind_features_b(M.dedup_first(FX.wind(spark, sf_dir)))


_PV_B_SEL = ["site_id", "ts", "row_id", "pv_kw", "ghi", "hour", "is_weekend", "pv_lag_1",
             "pv_roll_mean_3", "pv_efficiency"]
_WIND_B_SEL = ["site_id", "ts", "row_id", "wind_kw", "wind_speed", "hour", "is_weekend",
               "wind_lag_1", "wind_roll_mean_3", "turbulence_intensity"]


def _merged_b_sql() -> str:
    pvs = ", ".join(f"p.{x} AS {x}_pv" if x in ("row_id", "hour", "is_weekend") else f"p.{x}"
                    for x in _PV_B_SEL)
    wns = ", ".join(f"w.{x} AS {x}_wind" if x in ("row_id", "hour", "is_weekend") else f"w.{x}"
                    for x in _WIND_B_SEL if x not in ("site_id", "ts"))
    return S.with_ctes(*PV_B_CTES, *WIND_B_CTES) + f"""
SELECT {pvs}, {wns}
FROM pf p JOIN wf w ON p.site_id = w.site_id AND p.ts = w.ts"""


@register("merged_features_b", sql=_merged_b_sql(),
          doubles=["pv_kw", "ghi", "pv_lag_1", "pv_roll_mean_3", "pv_efficiency", "wind_kw",
                   "wind_speed", "wind_lag_1", "wind_roll_mean_3", "turbulence_intensity"],
          operators=("JN2", "PRJ7"))
def merged_features_b(spark, sf_dir):
    pv = FE.pv_features_b(M.dedup_first(FX.solar(spark, sf_dir))).select(*_PV_B_SEL)
    wd = FE.wind_features_b(M.dedup_first(FX.wind(spark, sf_dir))).select(*_WIND_B_SEL)
    return M.join_sources(pv, wd, ("site_id", "ts"), ("_pv", "_wind"))


SIGNATURE_SQL = S.with_ctes(S.SOLAR) + """
SELECT site_id,
       CASE GROUPING(site_id, hour, day_of_year) WHEN 1 THEN 'hourly' WHEN 2 THEN 'daily'
            ELSE 'overall' END AS level,
       hour, day_of_year, avg(pv_kw) AS mean, stddev_samp(pv_kw) AS std,
       CASE WHEN GROUPING(site_id, hour, day_of_year) = 1 THEN max(pv_kw) END AS max
FROM (SELECT site_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofyear(ts) AS INTEGER) AS day_of_year,
             pv_kw FROM solar)
GROUP BY GROUPING SETS ((site_id, hour), (site_id, day_of_year), (site_id))"""


@register("signature_sets", sql=SIGNATURE_SQL, doubles=["mean", "std", "max"],
          operators=("AGG1",))
def signature_sets(spark, sf_dir):
    return P.signature_sets(FX.solar(spark, sf_dir), "pv_kw")


CALENDAR_SQL = S.with_ctes(S.SOLAR) + f"""
SELECT site_id, row_id, ts, hour, day, month, weekday, is_weekend, sin_hour, cos_hour,
       weekday AS day_of_week, day_of_year, week_of_year, hour_sin, hour_cos, day_sin, day_cos
FROM (SELECT *, sin_hour AS hour_sin, cos_hour AS hour_cos,
             {cyc('day_of_year', 365)[0]} AS day_sin, {cyc('day_of_year', 365)[1]} AS day_cos
      FROM (SELECT *, CAST(dayofyear(ts) AS INTEGER) AS day_of_year,
                   CAST(weekofyear(ts) AS INTEGER) AS week_of_year
            FROM ({_cal_b_sql('(SELECT site_id, row_id, ts FROM solar)')})))"""


@register("calendar_features", sql=CALENDAR_SQL,
          doubles=["sin_hour", "cos_hour", "hour_sin", "hour_cos", "day_sin", "day_cos"],
          operators=("SC1", "SC2", "SC3"))
def calendar_features(spark, sf_dir):
    s = FX.solar(spark, sf_dir).select("site_id", "row_id", "ts")
    b = FE.calendar_b(s)
    a = FE.calendar_a(b)
    return a.select("site_id", "row_id", "ts", "hour", "day", "month", "weekday", "is_weekend",
                    "sin_hour", "cos_hour", "day_of_week", "day_of_year", "week_of_year",
                    "hour_sin", "hour_cos", "day_sin", "day_cos")

