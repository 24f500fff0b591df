"""Driver contract and SQL-oracle agreement at sf0.001."""

import importlib

import pytest

from gridlake.plans.catalog import REGISTRY
from gridlake.plans.registry import double_columns
from tools.oracle_check import compare, connect

entry_mod = importlib.import_module("__spark_entry__")
QUERIES = entry_mod.queries()
ORACLE = entry_mod.oracle_sql()
CORE = sorted(n for n in ORACLE if n in REGISTRY)  # the optional operators have tests of their own


def test_entry_returns_rows(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "complementarity_index" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 40


@pytest.fixture(scope="module")
def duck(sf_small):
    return connect(sf_small)


@pytest.mark.parametrize("name", CORE)
def test_oracle_agrees(spark, duck, sf_small, name):
    ok, msg = compare(spark, duck, name, sf_small)
    assert ok, msg


@pytest.mark.parametrize("name", CORE)
def test_declared_doubles_match_schema(spark, sf_small, name):
    q = REGISTRY[name]
    assert sorted(double_columns(q.build(spark, sf_small))) == sorted(set(q.doubles))


@pytest.mark.parametrize("name", ["stream_totals", "align_grid", "quality_report", "raw_file_roundtrip"])
def test_oracle_agrees_in_other_time_zone(spark, duck, sf_small, name):
    """Time arithmetic must not depend on the session time zone."""
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        ok, msg = compare(spark, duck, name, sf_small)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert ok, msg
