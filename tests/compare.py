"""Run registered queries in Spark and DuckDB on one folder and compare the results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.6g}") if abs(value) < 1e15 else value
    if hasattr(value, "item"):
        return cell(value.item())
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(cell(row[i]) for i in order) for row in rows), key=lambda r: tuple((x is not None, str(x)) for x in r)
    )


def check(spark, con, folder, name, query, sql):
    began = time.time()
    df = query(spark, folder)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - began
    if sql is None:
        return f"rows {len(got):>7} {spent:6.2f}s", bool(got)
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"COLUMNS {got_columns} <> {want_columns}", False
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"VALUES {len(got)} rows, want {len(want)}; extra {extra} missing {missing}", False
    return f"match {len(got):>6} {spent:6.2f}s", bool(got)


def main(argv):
    import __spark_entry__ as entry
    from spanloom.session import local_session

    folder = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        folder = argv.pop(0)
    spark, con = local_session("8"), connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, query in queries.items():
        if argv and not any(a in name for a in argv):
            continue
        try:
            message, ok = check(spark, con, folder, name, query, oracle.get(name))
        except Exception as exc:  # noqa: BLE001 - reported, the next query still runs
            message, ok = f"{type(exc).__name__}: {str(exc)[:1500]}", False
        print(f"{'ok  ' if ok else 'FAIL'} {name:<34} {message}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
