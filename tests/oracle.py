"""Runs registered queries next to their DuckDB oracles and compares the full results.

``python tests/oracle.py [sf] [name ...]`` checks the named queries (all by default).
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def compare(df, con, sql: str) -> str | None:
    """None when both results are the same bag of rows, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = Counter(
        tuple(_plain(row[names.index(c)]) for c in order) for row in cur.fetchall()
    )
    got = Counter(tuple(_plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in order]).collect())
    if got == want:
        return None
    extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
    return f"rows {sum(got.values())} against {sum(want.values())}; extra {extra}; missing {missing}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(queries())
    spark, con, failed = make_session(), connect(folder), 0
    for name in names:
        begin = time.time()
        try:
            df = queries()[name](spark, folder)
            sql = oracle_sql().get(name)
            problem = compare(df, con, sql) if sql else f"rows only: {df.count()}"
            ok = problem is None or not sql
        except Exception as exc:  # noqa: BLE001 - every query gets its line
            problem, ok = f"{type(exc).__name__}: {str(exc)[:700]}", False
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
