"""Registry of named queries: a Spark builder plus an equivalent SQL text.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's tables.  DOUBLE outputs are rounded to 6 decimals on both sides so
the two engines' summation orders do not decide equality.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from gridlake.sources.fixture_sql import HALF, rounded

DIGITS = 6


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: list[str] = field(default_factory=list)
    operators: tuple[str, ...] = ()

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(self.build(spark, sf_dir))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return rounded(self.sql, self.doubles, DIGITS)


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: list[str] | None = None,
             operators: tuple[str, ...] = ()):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, list(doubles or []), operators)
        return fn
    return deco


def round_half_away(c, digits: int = DIGITS):
    """``sign(x) * floor(|x| * 10^d + HALF) / 10^d`` -- spelled out so Spark and
    the SQL text perform the same IEEE operations (built-in ``round`` breaks
    ties such as 0.0630625 differently per engine); ``+ 0.0`` clears -0.0."""
    scale = float(10 ** digits)
    x = F.col(c) if isinstance(c, str) else c
    rounded = (F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(HALF)).cast("double")
               / F.lit(scale) + F.lit(0.0))
    # Spark's floor is a BIGINT: doubles this large have no decimals to round
    return F.when(F.abs(x) < F.lit(2.0 ** 52 / scale), rounded).otherwise(x)


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(round_half_away(f.name, digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
