"""Compares registered queries with their SQL. Usage: python tests/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(spark, con, name, build, sql, sf_dir):
    """Returns a message on disagreement, else None."""
    df = build(spark, sf_dir)
    left_names, left = rows_of(df.columns, df.collect())
    if sql is None:
        return None if left_names else "no columns"
    cursor = con.execute(sql)
    right_names, right = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if left_names != right_names:
        return f"columns {left_names} vs {right_names}"
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:2]
        missing = [r for r in right if r not in set(left)][:2]
        return f"{len(left)} rows vs {len(right)}; extra {extra} missing {missing}"
    if not left:
        return None
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"row {a} vs {b} ({left_names})"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from martloom.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sql = oracle_sql()
    failed = 0
    for name, build in queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, build, sql.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on to the next query
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
