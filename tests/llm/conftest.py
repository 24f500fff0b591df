import sys

import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) tuples."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)
    return make


@pytest.fixture(scope="session")
def write_tables(spark, tmp_path_factory):
    """Write DataFrames as the tables of a data folder and return the folder."""
    def write(**tables):
        path = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)
    return write


ODD_TEXTS = [None, "", " ", "\n\n", "a", "é", "word", "x" * 30_000, "be " * 5_000, "a b\tc\nd\x0be\x0cf\rg",
             "😀 日本語 ß", "!!!"]


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and very long texts, ties and repeated rows, a null id."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    return rows + [(6, "word"), (6, "word"), (40, "word"), (None, "word"), (None, None)]
