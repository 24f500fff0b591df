"""Queries that SQL can express, against DuckDB over the whole small tables."""

import importlib
import os

import duckdb
import pytest

from gridlake.llm.catalog import ORACLE_SQL, QUERIES


def rows_of(table):
    names = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in names]
    return names, sorted(zip(*data), key=lambda r: tuple((x is None, str(x)) for x in r))


def connect(folder):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_small, name):
    assert rows_of(QUERIES[name](spark, sf_small).toArrow()) == rows_of(connect(sf_small).sql(ORACLE_SQL[name]).to_arrow_table())


def test_odd_rows(spark, odd_rows, docs_of, write_tables):
    """Nulls, empty and long texts, ties and repeated rows, also in the pages and the benchmark."""
    docs = docs_of(odd_rows)
    html = [t or "" for _, t in odd_rows] + ["p" * 1500] * 4 + [None]
    urls = ["http://A.example.com/en/1#x", "https://a.example.com/en/1.html", None, "no scheme", "http://", "://x/y",
            "http://net/es/", "http://X.NET/fr/a?utm_source=1", "http://x.net/fr", "http://www.example.com/en/q"]
    pages = spark.createDataFrame([(None if i == 3 else i, urls[i % len(urls)], h) for i, h in enumerate(html)],
                                  "page_id bigint, url string, html string")
    bench = spark.createDataFrame([(1, "word"), (1, "word"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "!!")],
                                  "item_id bigint, text string")
    folder = write_tables(documents=docs, pages=pages, benchmark=bench)
    con = connect(folder)
    for name, sql in ORACLE_SQL.items():
        got, want = QUERIES[name](spark, folder).toArrow(), con.sql(sql).to_arrow_table()
        assert rows_of(got) == rows_of(want), name


def test_empty_tables(spark, docs_of, write_tables):
    folder = write_tables(documents=docs_of([(0, "x")]).limit(0),
                          pages=spark.createDataFrame([], "page_id bigint, url string, html string"),
                          benchmark=spark.createDataFrame([], "item_id bigint, text string"),
                          labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    for name, query in QUERIES.items():
        assert query(spark, folder).count() == 0, name
    assert importlib.import_module("corpus_pipeline").run(spark, folder).count() == 0


def test_odd_rows_keep_their_number(spark, odd_rows, docs_of, write_tables):
    folder = write_tables(documents=docs_of(odd_rows), labels=spark.createDataFrame([(6, 1, 1), (6, 1, 0), (None, 1, 1), (4, 0, None)],
                                                                                     "doc_id bigint, quality int, toxic int"))
    for name in ("op1_suffix_dedup", "op2_language", "op3_toxicity", "op5_near_dup", "op6_hash_ring", "op7_bpe", "op10_quality_rules"):
        assert QUERIES[name](spark, folder).count() == len(odd_rows), name
