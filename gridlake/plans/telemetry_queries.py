"""Registered queries: telemetry and stateful operators
(SC17-SC21, WIN9, WIN10, AGG17-AGG19, ST1-ST4, DOC5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import stateful as ST
from gridlake.operators import telemetry as T
from gridlake.plans.registry import register
from gridlake.sources import fixture_sql as S
from gridlake.sources import fixtures as FX

P = T.PARAMS
D = "AS DOUBLE"


def c(x) -> str:
    return f"CAST({x} {D})"


DT = f"({c(1)} / {c(30)})"
TEL_COLS = ["frequency", "soc", "p_renewable", "p_load", "p_thermal", "p_battery"]

RN_CTE = """tr AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY ts, row_id) - 1 AS BIGINT) AS rn
  FROM telemetry)"""


def _load_sql(noise: str) -> str:
    return S.with_ctes(S.TELEMETRY, RN_CTE) + f"""
SELECT * EXCLUDE (m),
       greatest({c(1.7)} * m * ({c(1)} + {c(0.25)} * sin(2 * pi() * (hours - {c(6)}) / {c(24)})){noise},
                {c(800)}) AS p_load_profile
FROM (SELECT *, (CAST(rn AS DOUBLE) * {DT}) % {c(24)} AS hours
      FROM (SELECT *, avg(p_renewable) OVER (PARTITION BY site_id) AS m FROM tr))"""


@register("load_profile", sql=_load_sql(""),
          doubles=TEL_COLS + ["hours", "p_load_profile"], operators=("SC17",))
def load_profile(spark, sf_dir):
    return T.load_profile(FX.telemetry(spark, sf_dir))


@register("load_profile_noise", sql=_load_sql(f" + {S.normal_sql(42, 'load', 'site_id', 'rn')} * {c(40)}"),
          doubles=TEL_COLS + ["hours", "p_load_profile"], operators=("SC17",))
def load_profile_noise(spark, sf_dir):
    """The profile with its noise of 40 kW."""
    return T.load_profile(FX.telemetry(spark, sf_dir), noise_seed=42)


@register("battery_sizing", sql=S.with_ctes(S.TELEMETRY) + f"""
SELECT site_id, imbalance_std_kw, {c(2)} * imbalance_std_kw AS required_kw, {c(7000)} AS rated_kw,
       {c(7000)} >= {c(2)} * imbalance_std_kw AS adequate,
       greatest({c(2)} * imbalance_std_kw - {c(7000)}, {c(0)}) AS shortfall_kw
FROM (SELECT site_id, stddev_pop(p_renewable - p_load) AS imbalance_std_kw FROM telemetry GROUP BY site_id)""",
          doubles=["imbalance_std_kw", "required_kw", "rated_kw", "shortfall_kw"],
          operators=("AGG19",))
def battery_sizing(spark, sf_dir):
    return T.battery_sizing(FX.telemetry(spark, sf_dir))


W = "OVER (PARTITION BY site_id ORDER BY ts, row_id"

DISPATCH_CTE = f"""dsp AS (
  SELECT *, greatest({c(0)}, p_load - renewable_ma) AS thermal_setpoint FROM (
    SELECT *, CAST(row_number() {W}) - 1 AS BIGINT) AS rn,
           avg(p_renewable) {W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS renewable_ma
    FROM telemetry))"""


@register("dispatch_setpoint", sql=S.with_ctes(S.TELEMETRY, DISPATCH_CTE) + "SELECT * FROM dsp",
          doubles=TEL_COLS + ["renewable_ma", "thermal_setpoint"], operators=("WIN9", "ST4"))
def dispatch_setpoint(spark, sf_dir):
    return T.dispatch_setpoint(FX.telemetry(spark, sf_dir))


TERMS_CTE = f"""terms AS (
  SELECT *, CASE WHEN p_command > 0 THEN least(p_command, avail_discharge_kw)
                 ELSE greatest(p_command, -avail_charge_kw) END AS p_actual
  FROM (
    SELECT *, p_vsm + p_soc AS p_command FROM (
      SELECT *, p_inertia + p_droop AS p_vsm FROM (
        SELECT *, {c(-4000)} * rocof AS p_inertia,
               {c(-6000)} * (frequency - {c(50)}) AS p_droop,
               {c(20)} * (frequency - {c(50)}) AS ace,
               {c(1000)} * (soc - {c(0.5)}) AS p_soc,
               CASE WHEN soc > {c(0.1)} THEN {c(7000)} ELSE {c(0)} END AS avail_discharge_kw,
               CASE WHEN soc < {c(0.9)} THEN {c(7000)} ELSE {c(0)} END AS avail_charge_kw,
               frequency BETWEEN {c(49.5)} AND {c(50.5)} AS is_stable,
               p_renewable + p_thermal + p_battery AS p_total_gen,
               (p_renewable + p_thermal + p_battery - p_load) / {c(2000)} AS imbalance_pu,
               {c(5000)} - p_thermal AS thermal_ramp_margin
        FROM (
          SELECT *, CASE WHEN {c(120)} > 0
                         THEN (frequency - lag(frequency, 1, {c(50)}) {W})) / {c(120)}
                         ELSE {c(0)} END AS rocof,
                 CAST(row_number() {W}) - 1 AS BIGINT) AS rn
          FROM telemetry)))))"""

TERMS_DOUBLES = TEL_COLS + ["rocof", "p_inertia", "p_droop", "p_vsm", "ace", "p_soc",
                            "avail_discharge_kw", "avail_charge_kw", "p_command", "p_actual",
                            "p_total_gen", "imbalance_pu", "thermal_ramp_margin"]


@register("control_terms", sql=S.with_ctes(S.TELEMETRY, TERMS_CTE) + "SELECT * FROM terms",
          doubles=TERMS_DOUBLES,
          operators=("WIN10", "SC18", "SC19", "SC20", "SC21"))
def control_terms(spark, sf_dir):
    return T.control_terms(FX.telemetry(spark, sf_dir))


KPI_SEL = f"""avg(frequency) AS frequency_mean_hz, stddev_samp(frequency) AS frequency_std_hz,
  min(frequency) AS frequency_min_hz, max(frequency) AS frequency_max_hz,
  avg(CAST(is_stable AS DOUBLE)) AS stability_rate,
  avg(soc) AS battery_soc_mean, stddev_samp(soc) AS battery_soc_std,
  avg(abs(p_battery)) AS battery_power_mean, max(abs(p_battery)) AS battery_power_max,
  avg(p_thermal) AS thermal_power_mean, avg(p_thermal) / {c(5000)} AS thermal_utilization,
  avg(abs(ace)) AS ace_mean_kw, max(abs(ace)) AS ace_max_kw,
  avg(abs(rocof)) AS rocof_mean, max(abs(rocof)) AS rocof_max,
  avg(abs(p_vsm)) AS p_vsm_mean, avg(abs(p_soc)) AS p_soc_mean, avg(abs(p_agc)) AS p_agc_mean"""
KPI_DOUBLES = ["frequency_mean_hz", "frequency_std_hz", "frequency_min_hz", "frequency_max_hz",
               "stability_rate", "battery_soc_mean", "battery_soc_std", "battery_power_mean",
               "battery_power_max", "thermal_power_mean", "thermal_utilization", "ace_mean_kw",
               "ace_max_kw", "rocof_mean", "rocof_max", "p_vsm_mean", "p_soc_mean", "p_agc_mean"]


def _clamp_rec(base: str, x0: float, lo: float, hi: float) -> str:
    """Recursive CTE ``rec(site_id, rn, before, after)`` over ``base(site_id, rn, a)``."""
    return f"""rec AS (
  SELECT site_id, rn, {c(x0)} AS before, least(greatest({c(x0)} + a, {c(lo)}), {c(hi)}) AS after
  FROM {base} WHERE rn = 0
  UNION ALL
  SELECT b.site_id, b.rn, rec.after, least(greatest(rec.after + b.a, {c(lo)}), {c(hi)})
  FROM rec JOIN {base} b ON b.site_id = rec.site_id AND b.rn = rec.rn + 1)"""


#: The control terms with the AGC integral: ``agc``.
AGC_CTES = "WITH RECURSIVE " + ",\n".join([S.TELEMETRY, TERMS_CTE, f"""ab AS (
  SELECT *, ({c(5)} * ({c(50)} - frequency) + {c(0.5)} * (p_actual - p_command)) * {DT} AS a
  FROM terms)""", _clamp_rec("ab", 0.0, -5000.0, 5000.0), """agc AS (
  SELECT ab.* EXCLUDE (a), rec.after AS p_agc
  FROM ab JOIN rec ON ab.site_id = rec.site_id AND ab.rn = rec.rn)"""]) + "\n"


def agc_terms(spark, sf_dir):
    return ST.agc_integral(T.control_terms(FX.telemetry(spark, sf_dir)))


@register("telemetry_kpis", sql=AGC_CTES + f"SELECT site_id, {KPI_SEL} FROM agc GROUP BY site_id",
          doubles=KPI_DOUBLES, operators=("AGG17",))
def telemetry_kpis(spark, sf_dir):
    """The 18 values, the mean absolute AGC term among them."""
    return T.telemetry_kpis(agc_terms(spark, sf_dir))


@register("kpi_gate", sql=AGC_CTES + f"""
SELECT *, targets_met >= 3 AS operational FROM (
  SELECT *, CAST(frequency_mean_hz BETWEEN {c(49.5)} AND {c(50.5)} AS INTEGER)
            + CAST(stability_rate > 0.95 AS INTEGER)
            + CAST(battery_soc_mean * 100 BETWEEN 45 AND 55 AS INTEGER)
            + CAST(ace_mean_kw < 300 AS INTEGER) AS targets_met
  FROM (SELECT site_id, {KPI_SEL} FROM agc GROUP BY site_id))""",
          doubles=KPI_DOUBLES, operators=("AGG18",))
def kpi_gate(spark, sf_dir):
    return T.kpi_gate(T.telemetry_kpis(agc_terms(spark, sf_dir)))


SOC_BASE = f"""sb AS (
  SELECT *, CASE WHEN p_battery > 0
                 THEN -(least(p_battery, {c(7000)}) * {DT} / {c(0.95)})
                 ELSE least(-p_battery, {c(7000)}) * {DT} * {c(0.95)} END AS a
  FROM tr)"""

SOC_SQL = "WITH RECURSIVE " + ",\n".join([S.TELEMETRY, RN_CTE, SOC_BASE,
                                          _clamp_rec("sb", 5000.0, 1000.0, 9000.0)]) + f"""
SELECT sb.* EXCLUDE (a), rec.after AS energy_kwh, rec.after / {c(10000)} AS soc_after,
  CASE WHEN p_battery > 0
       THEN CASE WHEN rec.before + a < {c(1000)} THEN (rec.before - rec.after) * {c(0.95)} / {DT}
                 ELSE least(p_battery, {c(7000)}) END
       ELSE -(CASE WHEN rec.before + a > {c(9000)} THEN (rec.after - rec.before) / ({DT} * {c(0.95)})
                   ELSE least(-p_battery, {c(7000)}) END) END AS p_moved
FROM sb JOIN rec ON sb.site_id = rec.site_id AND sb.rn = rec.rn"""


@register("soc_balance", sql=SOC_SQL, doubles=TEL_COLS + ["energy_kwh", "soc_after", "p_moved"],
          operators=("ST2",))
def soc_balance(spark, sf_dir):
    return ST.soc_balance(FX.telemetry(spark, sf_dir))


@register("agc_integral", sql=AGC_CTES + "SELECT * FROM agc", doubles=TERMS_DOUBLES + ["p_agc"], operators=("ST3",))
def agc_integral(spark, sf_dir):
    return agc_terms(spark, sf_dir)


RAMP_SQL = "WITH RECURSIVE " + ",\n".join([S.TELEMETRY, DISPATCH_CTE, f"""rec AS (
  SELECT site_id, rn,
         {c(0)} + least(greatest(least(greatest(thermal_setpoint, {c(0)}), {c(5000)}) - {c(0)},
                                 {c(-100)}), {c(100)}) AS y
  FROM dsp WHERE rn = 0
  UNION ALL
  SELECT d.site_id, d.rn,
         rec.y + least(greatest(least(greatest(d.thermal_setpoint, {c(0)}), {c(5000)}) - rec.y,
                                {c(-100)}), {c(100)})
  FROM rec JOIN dsp d ON d.site_id = rec.site_id AND d.rn = rec.rn + 1)"""]) + """
SELECT dsp.*, rec.y AS p_thermal_dispatch
FROM dsp JOIN rec ON dsp.site_id = rec.site_id AND dsp.rn = rec.rn"""


@register("ramp_follow", sql=RAMP_SQL,
          doubles=TEL_COLS + ["renewable_ma", "thermal_setpoint", "p_thermal_dispatch"],
          operators=("ST1", "WIN9"))
def ramp_follow(spark, sf_dir):
    return ST.ramp_follow(T.dispatch_setpoint(FX.telemetry(spark, sf_dir)))


LOWPASS_SQL = "WITH RECURSIVE " + ",\n".join([S.TELEMETRY, RN_CTE, f"""rec AS (
  SELECT site_id, rn, {c(0.25)} * frequency + {c(0.75)} * frequency AS s
  FROM tr WHERE rn = 0
  UNION ALL
  SELECT t.site_id, t.rn, {c(0.75)} * rec.s + {c(0.25)} * t.frequency
  FROM rec JOIN tr t ON t.site_id = rec.site_id AND t.rn = rec.rn + 1)"""]) + """
SELECT tr.*, rec.s AS frequency_smooth
FROM tr JOIN rec ON tr.site_id = rec.site_id AND tr.rn = rec.rn"""


@register("low_pass", sql=LOWPASS_SQL, doubles=TEL_COLS + ["frequency_smooth"], operators=("DOC5",))
def low_pass(spark, sf_dir):
    return ST.low_pass(FX.telemetry(spark, sf_dir), "frequency", 0.25)
