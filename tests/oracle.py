"""Run queries on Spark and their SQL on DuckDB, and compare the rows.

    python -m tests.oracle [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value):
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return f"not finite: {value}"
        return repr(value + 0.0)
    return repr(value)


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def compare(df, con, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    names = sorted(df.columns)
    rows = Counter(tuple(cell(r[c]) for c in names) for r in df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    order = [columns.index(c) for c in names]
    expected = Counter(tuple(cell(r[i]) for i in order) for r in result.fetchall())
    if rows != expected:
        extra, missing = rows - expected, expected - rows
        return (
            f"{sum(rows.values())} against {sum(expected.values())} rows, "
            f"{sum(extra.values())} differ, such as {list(extra)[:2]} / {list(missing)[:2]} {names}"
        )
    return None


def main() -> int:
    from rostrum import bindings
    from rostrum.session import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, sql = duck(folder), 0, bindings.oracle_sql()
    for name, query in bindings.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            said = compare(df, con, sql[name]) if name in sql else f"ok, {len(df.collect())} rows, no SQL"
        except Exception as problem:
            said = f"{type(problem).__name__}: {str(problem)[:1500]}"
        bad += said is not None and not said.startswith("ok")
        print(f"{name:24s} {time.time() - start:6.2f}s {said or 'same'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
