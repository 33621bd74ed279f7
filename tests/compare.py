"""Run registered queries on Spark and DuckDB and compare the rows.

Usage: python -m tests.compare [-d folder] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
import traceback

import duckdb

from pagewatch.catalog import CASES, query
from pagewatch.catalog.sources import BASE_TABLES
from pagewatch.session import build_session


def norm(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, norm(v)) for k, v in sorted(value.items()))
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(folder: str):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def check(spark, con, folder: str, name: str) -> tuple[bool, str]:
    t0 = time.time()
    df = query(name)(spark, folder)
    got_cols, got = rows(df.columns, df.collect())
    took = time.time() - t0
    oracle = CASES[name].oracle
    if oracle is None:
        return True, f"{name}: {len(got)} rows, no oracle, {took:.1f}s"
    cursor = con.execute(oracle)
    want_cols, want = rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return False, f"{name}: columns {got_cols} != {want_cols}"
    if got != want:
        a, b = set(got), set(want)
        return False, (
            f"{name}: rows {len(got)} vs {len(want)} cols {got_cols}\n   spark only {str(sorted(a - b, key=repr)[:3])[:900]}"
            f"\n   duck only  {str(sorted(b - a, key=repr)[:3])[:900]}"
        )
    return True, f"{name}: {len(got)} rows ok, {took:.1f}s"


def main(args: list[str]) -> int:
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        folder, args = args[1], args[2:]
    names = args or list(CASES)
    if len(args) == 1 and args[0].endswith("*"):
        names = [n for n in CASES if CASES[n].run.__module__.endswith(args[0][:-1])]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                              "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in names:
        try:
            ok, message = check(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += not ok
        print(("PASS " if ok else "FAIL ") + message, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
