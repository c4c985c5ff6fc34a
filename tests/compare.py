"""Run registered queries and their check SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    wide = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    types = {d[0]: wide.get(str(d[1]), str(d[1])) for d in cursor.description}
    differing = {c: (t, types[c]) for c, t in df.dtypes if types[c] != t}
    got, want = rows_of(df.columns, df.collect()), rows_of(names, expected)
    if got != want:
        extra, lost = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"{sum(got.values())} rows against {sum(want.values())}; only here {extra}; only there {lost}"[:1500]
    return f"types {differing}" if differing else None


def main(folder: str, only: list[str]) -> None:
    from textprep.plans.catalogue import CHECKS, QUERIES
    from textprep.session import local_session

    spark, con, bad = local_session("8"), connect(folder), 0
    for name, build in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            result = compare(df, con, CHECKS[name]) if name in CHECKS else f"rows only: {df.collect()[:2]}"[:200]
        except Exception as error:  # noqa: BLE001 - report and go on
            result = f"ERROR {type(error).__name__}: {str(error)[:900]}"
        bad += result is not None and not result.startswith("rows only")
        print(f"{name:34s} {time.time() - start:6.2f}s {result or 'equal'}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
