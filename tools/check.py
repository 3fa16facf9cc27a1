"""Runs catalogue queries on a data folder and compares them with their oracle SQL in an in-process DuckDB.

usage: python tools/check.py FOLDER [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlake.plans import oracle, queries  # noqa: E402
from ledgerlake.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows in column-name order as text, floats to nine significant digits, sorted."""
    def cell(v):
        if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NaT or v is pd.NA:
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v)).lower()
        try:
            return f"{float(v):.9g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)
    names = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[names].itertuples(index=False, name=None))


def main() -> None:
    folder, wanted = sys.argv[1], sys.argv[2:] or list(queries.CATALOGUE)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            got = queries.CATALOGUE[name](spark, folder).toPandas()
        except Exception as exc:  # noqa: BLE001 - reported per query
            print(f"ERROR {name}: {str(exc)[:600]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in oracle.SQL:
            print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
            continue
        try:
            want = db.execute(oracle.SQL[name]).df()
        except Exception as exc:  # noqa: BLE001
            print(f"SQLERR {name}: {str(exc)[:600]}", flush=True)
            bad += 1
            continue
        if sorted(got.columns) != sorted(want.columns):
            print(f"COLUMNS {name} {sorted(got.columns)} {sorted(want.columns)}", flush=True)
            bad += 1
            continue
        a, b = canonical(got), canonical(want)
        if a == b:
            print(f"ok    {name} {len(a)} {took:.1f}s sql {time.time() - start - took:.1f}s", flush=True)
        else:
            bad += 1
            only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
            print(f"DIFF  {name} spark {len(a)} sql {len(b)} only spark {len(only_a)} only sql {len(only_b)} {took:.1f}s")
            print("   spark", [str(x)[:300] for x in only_a[:2]], "\n   sql  ", [str(x)[:300] for x in only_b[:2]], flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
