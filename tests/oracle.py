"""Compare registered queries with their oracle SQL: ``python tests/oracle.py [sf] [name part ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b


def compare(spark_rows, sql_rows) -> str | None:
    (c1, r1), (c2, r2) = spark_rows, sql_rows
    if c1 != c2:
        return f"columns {c1} <> {c2}"
    if len(r1) != len(r2):
        return f"{len(r1)} rows <> {len(r2)}"
    for a, b in zip(r1, r2):
        if not all(close(x, y) for x, y in zip(a, b)):
            return f"{a} <> {b}"
    return None


def check(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[str | None, int]:
    df = fn(spark, sf_dir)
    found = rows_of(df.columns, df.collect())
    if sql is None:
        return None, len(found[1])
    cur = con.execute(sql)
    expected = rows_of([c[0] for c in cur.description], cur.fetchall())
    return compare(found, expected), len(found[1])


def main() -> None:
    from conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    parts = sys.argv[2:]
    spark, con, bad = make_session(), connect(sf_dir), 0
    for name, fn in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        at = time.time()
        try:
            problem, n = check(spark, con, sf_dir, name, fn, oracle_sql().get(name))
        except Exception as e:
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':5}{name:36}{n:>8} rows {time.time() - at:6.1f}s  {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
