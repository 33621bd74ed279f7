"""Run a registered query on Spark and, where there is check SQL, on DuckDB."""

from __future__ import annotations

import sys
import time

from pagewatch.llm.queries import ORACLE_SQL, QUERIES
from pagewatch.session import build_session
from tests.compare import duck, rows


def compared(spark, folder: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, folder)
    columns, got = rows(df.columns, df.collect())
    took = f"{len(got)} rows, {time.time() - start:.1f} s"
    if name not in ORACLE_SQL:
        return True, f"{name}: {took}, no SQL; {columns}; {got[:2]}"
    cursor = duck(folder).execute(ORACLE_SQL[name])
    wanted_columns, wanted = rows([d[0] for d in cursor.description], cursor.fetchall())
    if columns != wanted_columns:
        return False, f"{name}: columns {columns} and {wanted_columns}"
    a, b = set(got), set(wanted)
    odd = f"{sorted(a - b, key=repr)[:3]} and {sorted(b - a, key=repr)[:3]}"
    return got == wanted, f"{name}: {took}" if got == wanted else f"{name}: {took}, {len(wanted)} wanted, {odd}"


if __name__ == "__main__":
    session = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    for query in sys.argv[2:]:
        print(*compared(session, sys.argv[1], query), flush=True)
