"""Compare every registered query with its SQL text run by DuckDB.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, ".")

from gridlake.config import build_session  # noqa: E402
from gridlake.plans.catalog import REGISTRY  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(tbl):
    cols = sorted(tbl.column_names)
    data = {c: tbl.column(c).to_pylist() for c in cols}
    out = [tuple(_norm(data[c][i]) for c in cols) for i in range(tbl.num_rows)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, name: str, sf: str) -> tuple[bool, str]:
    """Run one registered query on both engines; (ok, message)."""
    q = REGISTRY[name]
    sdf = q.spark(spark, sf).toArrow()
    sql = q.oracle()
    if sql is None:
        return True, f"{sdf.num_rows} rows (no oracle)"
    odf = con.sql(sql).to_arrow_table()
    sc, sr = _rows(sdf)
    oc, orr = _rows(odf)
    if sc != oc:
        return False, f"columns differ: spark {sc} sql {oc}"
    if len(sr) != len(orr):
        return False, f"rows spark={len(sr)} sql={len(orr)}"
    diff = [(a, b) for a, b in zip(sr, orr) if a != b]
    if diff:
        return False, f"{len(diff)} rows differ; first spark {diff[0][0]} sql {diff[0][1]}"
    return True, f"{len(sr)} rows"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    if os.environ.get("GRIDLAKE_BARE_SESSION"):
        # the driver's view: a default session with none of our settings
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = build_session(os.environ.get("ORACLE_MASTER", "local[8]"))
    con = connect(sf)
    bad = 0
    for name in names:
        q = REGISTRY[name]
        t0 = time.time()
        try:
            sdf = q.spark(spark, sf).toArrow()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(exc)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = q.oracle()
        if sql is None:
            print(f"ROWS {name}: {sdf.num_rows} rows (no oracle) {ts:.1f}s")
            continue
        try:
            odf = con.sql(sql).to_arrow_table()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:600]}")
            bad += 1
            continue
        sc, sr = _rows(sdf)
        oc, orr = _rows(odf)
        if sc != oc:
            print(f"FAIL {name}: columns differ\n  spark {sc}\n  sql   {oc}")
            bad += 1
            continue
        if len(sr) != len(orr):
            print(f"FAIL {name}: rows spark={len(sr)} sql={len(orr)}")
            bad += 1
            continue
        diff = [(a, b) for a, b in zip(sr, orr) if a != b]
        if diff:
            print(f"FAIL {name}: {len(diff)} rows differ; first:\n  spark {diff[0][0]}\n  sql   {diff[0][1]}")
            bad += 1
            continue
        print(f"OK   {name}: {len(sr)} rows {ts:.1f}s")
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
