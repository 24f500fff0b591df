"""The same derived tables as ANSI SQL common table expressions.

Used by ``oracle_sql()``: DuckDB runs these over the driver's views, Spark
runs ``fixtures.py``.  Constants are cast to DOUBLE so both engines use the
same arithmetic.
"""

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"
POWER = ("CASE WHEN event_type = 'error' THEN CAST(NULL AS DOUBLE) "
         "WHEN event_type = 'signup' THEN -value ELSE value END")

WIND_POWER = ("CASE WHEN event_type = 'signup' THEN CAST(NULL AS DOUBLE) "
              "WHEN event_type = 'error' THEN -value ELSE value END")

SOLAR = f"""solar AS (
  SELECT event_id AS row_id,
         CAST(user_id % 5 AS INTEGER) AS site_id,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
         {K} / CAST(2.5 AS DOUBLE) AS temp_c,
         CAST(100 AS DOUBLE) - {K} AS humidity,
         {K} * CAST(10 AS DOUBLE) AS ghi,
         CASE WHEN event_id % 10 = 0 THEN CAST(0 AS DOUBLE)
              ELSE {K} * CAST(10 AS DOUBLE) + CAST(200 AS DOUBLE) END AS upper_rad,
         {POWER} AS pv_kw
  FROM events)"""

WIND = f"""wind AS (
  SELECT event_id AS row_id,
         CAST((user_id + 2) % 5 AS INTEGER) AS site_id,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
         CAST(1 AS DOUBLE) + CAST(event_id % 30 AS DOUBLE) / CAST(100 AS DOUBLE) AS air_density,
         {K} / CAST(5 AS DOUBLE) AS wind_speed,
         {WIND_POWER} AS wind_kw
  FROM events)"""

TELEMETRY = f"""telemetry AS (
  SELECT event_id AS row_id,
         CAST(user_id % 5 AS INTEGER) AS site_id,
         ts,
         CAST(49.4 AS DOUBLE) + {K} / CAST(80 AS DOUBLE) AS frequency,
         CAST(0.1 AS DOUBLE) + {K} / CAST(125 AS DOUBLE) AS soc,
         value * CAST(10 AS DOUBLE) AS p_renewable,
         value * CAST(17 AS DOUBLE) AS p_load,
         value * CAST(4 AS DOUBLE) AS p_thermal,
         CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS p_battery
  FROM events)"""

YIELD = """yield_series AS (
  SELECT CAST(l_suppkey AS INTEGER) AS site_id, l_shipdate AS ts,
         l_orderkey, l_linenumber, l_partkey,
         l_extendedprice AS pv_kw, l_quantity AS wind_speed
  FROM lineitem)"""

# Deduplicated sources: first row (lowest row_id) per (site_id, ts).
SOLAR_DEDUP = """solar_d AS (
  SELECT * EXCLUDE (_r) FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, ts ORDER BY row_id) AS _r FROM solar)
  WHERE _r = 1)"""

WIND_DEDUP = """wind_d AS (
  SELECT * EXCLUDE (_r) FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, ts ORDER BY row_id) AS _r FROM wind)
  WHERE _r = 1)"""

# Merged (lineage A) table: solar x wind inner join on (site_id, ts) with
# per-site min/max normalisation.
MERGED = """merged AS (
  SELECT j.*,
         CAST(1 AS DOUBLE) - abs(
             (j.pv_kw - st.s_lo) / (st.s_hi - st.s_lo + CAST(1e-6 AS DOUBLE))
           - (j.wind_kw - st.w_lo) / (st.w_hi - st.w_lo + CAST(1e-6 AS DOUBLE))) AS complementarity_index,
         j.pv_kw + j.wind_kw AS total_renewable_power,
         (j.pv_kw + j.wind_kw) / (st.s_hi + st.w_hi + CAST(1e-6 AS DOUBLE)) AS renewable_capacity_factor
  FROM (SELECT s.site_id, s.ts, s.row_id AS row_id_solar, s.temp_c, s.humidity, s.ghi, s.upper_rad,
               s.pv_kw, w.row_id AS row_id_wind, w.air_density, w.wind_speed, w.wind_kw
        FROM solar_d s JOIN wind_d w ON s.site_id = w.site_id AND s.ts = w.ts) j
  JOIN (SELECT s.site_id, min(s.pv_kw) AS s_lo, max(s.pv_kw) AS s_hi,
               min(w.wind_kw) AS w_lo, max(w.wind_kw) AS w_hi
        FROM solar_d s JOIN wind_d w ON s.site_id = w.site_id AND s.ts = w.ts
        GROUP BY s.site_id) st ON j.site_id = st.site_id)"""


def normal_sql(seed: int, name: str, *keys: str) -> str:
    """``exprs.counter_normal`` as SQL."""
    text = " || '|' || ".join([f"'{seed}|{name}'"] + [f"coalesce(CAST({k} AS VARCHAR), '-')" for k in keys])
    first, second = (f"CAST(CAST('0x' || substr(md5({text}), {at}, 13) AS BIGINT) AS DOUBLE)" for at in (1, 14))
    return (f"(sqrt(CAST(-2 AS DOUBLE) * ln(({first} + 1) / CAST(4503599627370496 AS DOUBLE)))"
            f" * cos(2 * pi() * ({second} / CAST(4503599627370496 AS DOUBLE))))")


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


#: Rounding limit of the comparison.  Means of two-decimal values often end in an
#: exact 5, where the engines' summation orders would decide; a limit just beside
#: the half has no such values.
HALF = 0.50001


def rounded(body: str, double_cols: list[str], digits: int = 6) -> str:
    """Wrap a query so DOUBLE columns are rounded like the Spark side
    (``+ 0.0`` turns -0.0 into 0.0)."""
    if not double_cols:
        return body
    scale = f"CAST(1e{digits} AS DOUBLE)"
    repl = ", ".join(
        f"sign({c}) * CAST(floor(abs({c}) * {scale} + CAST({HALF} AS DOUBLE)) AS DOUBLE) / {scale}"
        f" + CAST(0 AS DOUBLE) AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) q"
