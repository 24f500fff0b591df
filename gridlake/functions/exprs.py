"""Scalar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference's for the same results:
# solar constant 1367 W/m^2; assumed rotor swept area 100 m^2; Betz limit
# 0.593; epsilon 1e-6 added to every normalising denominator; daylight hours
# 6..20 inclusive; cyclic day divisor 365; nominal grid frequency 50 Hz.
SOLAR_CONSTANT = 1367.0
ROTOR_AREA_M2 = 100.0
BETZ_LIMIT = 0.593
EPS = 1e-6
DAY_START_HOUR = 6
DAY_END_HOUR = 20
DAYS_PER_YEAR = 365.0
NOMINAL_HZ = 50.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    """``clip`` that keeps NULL (Spark's ``greatest(NULL, 0)`` is 0)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.when(out < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(hi), F.lit(hi)).otherwise(out)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out.cast("double"))


def floor_at(c, lo: float) -> Column:
    """``np.maximum(lo, x)`` keeping NULL."""
    return clip(c, lo=lo)


def ratio(num, den) -> Column:
    """``num / den`` with division by zero giving NULL (pandas: inf -> NaN)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def guarded_ratio(num, den, cond: Column, eps: float = EPS) -> Column:
    """``np.where(cond, num / (den + eps), 0)``; NULL in ``cond`` gives 0."""
    return F.when(cond, col(num) / (col(den) + F.lit(eps))).otherwise(F.lit(0.0))


# --- time ------------------------------------------------------------------

def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros_between(start, end) -> Column:
    """Microseconds from ``start`` to ``end`` (TIMESTAMP_NTZ, no time zone
    involved -- casting to TIMESTAMP would apply the session zone and DST)."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def to_event_time(ts) -> Column:
    """Wall-clock TIMESTAMP_NTZ -> TIMESTAMP instant with the same UTC
    reading, independent of the session time zone (streams need TIMESTAMP
    for watermarks; windows then align to wall-clock hours)."""
    return F.timestamp_micros(micros_between(_epoch_ntz(), ts))


def from_event_time(ts) -> Column:
    """Inverse of ``to_event_time``."""
    secs = (F.unix_micros(col(ts)).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return _epoch_ntz() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


# --- noise ------------------------------------------------------------------

def counter_normal(seed: int, name: str, *keys) -> Column:
    """A standard normal number that depends on nothing but the seed, a name and the keys
    of the row (Box-Muller over two 52-bit parts of an MD5): the same for any partitioning,
    and on any engine that has MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name),
                               *[F.coalesce(col(k).cast("string"), F.lit("-")) for k in keys]))

    def part(start):
        return F.conv(F.substring(digest, start, 13), 16, 10).cast("bigint").cast("double")

    scale = F.lit(2.0 ** 52)
    first, second = (part(1) + F.lit(1.0)) / scale, part(14) / scale
    return F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(2.0 * math.pi) * second)


# --- calendar --------------------------------------------------------------

def hour(ts="ts") -> Column:
    return F.hour(col(ts))


def weekday(ts="ts") -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(ts))


def is_weekend(ts="ts") -> Column:
    return F.when(weekday(ts).isin(5, 6), F.lit(1)).otherwise(F.lit(0))


def cyclic(x, period: float):
    angle = F.lit(2.0 * math.pi) * col(x).cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def is_daylight(h) -> Column:
    return (col(h) >= DAY_START_HOUR) & (col(h) <= DAY_END_HOUR)


# --- physics ---------------------------------------------------------------

def extraterrestrial(h) -> Column:
    """``1367 * max(0, sin(pi (h - 6) / 12))``, hour NULL read as 12."""
    hh = F.coalesce(col(h).cast("double"), F.lit(12.0))
    elev = F.sin(F.lit(math.pi) * (hh - F.lit(6.0)) / F.lit(12.0))
    return F.lit(SOLAR_CONSTANT) * F.greatest(F.lit(0.0), elev)


def clearness_index(ghi, h, strict: bool = False) -> Column:
    """Kt clipped to [0, 1].  ``strict`` treats ext < 1e-3 as night (the
    parity form keeps the sin(pi) > 0 artefact at hour 18)."""
    ext = extraterrestrial(h)
    day = ext > F.lit(1e-3) if strict else ext > F.lit(0.0)
    return clip(guarded_ratio(ghi, ext, day), 0.0, 1.0)


def cube(x) -> Column:
    return col(x) * col(x) * col(x)


def square(x) -> Column:
    return col(x) * col(x)


def theoretical_wind_kw(rho, v) -> Column:
    return F.lit(0.5) * col(rho) * F.lit(ROTOR_AREA_M2) * cube(v) / F.lit(1000.0)


def power_coefficient(power, rho, v) -> Column:
    p = theoretical_wind_kw(rho, v)
    return clip(guarded_ratio(power, p, p > F.lit(0.1)), 0.0, BETZ_LIMIT)


def solar_efficiency(pv, ghi) -> Column:
    return clip(guarded_ratio(pv, ghi, col(ghi) > F.lit(10.0)), 0.0, 1.0)


def wind_power_per_speed(power, v) -> Column:
    return guarded_ratio(power, v, col(v) > F.lit(0.5))


def minmax_norm(x, lo, hi) -> Column:
    return (col(x) - col(lo)) / (col(hi) - col(lo) + F.lit(EPS))


def complementarity(s, s_lo, s_hi, w, w_lo, w_hi) -> Column:
    return F.lit(1.0) - F.abs(minmax_norm(s, s_lo, s_hi) - minmax_norm(w, w_lo, w_hi))


def wind_power_density(rho, v) -> Column:
    return F.lit(0.5) * col(rho) * cube(v)
