"""Spark results against DuckDB on the same tables.

Run as a script to compare registered queries: ``python tests/compare.py <folder> [query ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


STRICT = bool(os.environ.get("STRICT"))
"""Ask for equal doubles, bit by bit."""


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(value):
    if value is None:
        return ("", "")
    if isinstance(value, float):
        return ("n", f"{value:.9g}")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, int):
        return ("n", f"{value:.9g}")
    return ("s", str(value))


def _same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or (not STRICT and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))
    return str(a) == str(b)


def differences(names_a, rows_a, names_b, rows_b) -> list[str]:
    """What differs between two results, regardless of row and column order."""
    if sorted(names_a) != sorted(names_b):
        return [f"columns {sorted(set(names_a) ^ set(names_b))}"]
    if len(rows_a) != len(rows_b):
        return [f"rows {len(rows_a)} and {len(rows_b)}"]
    order = sorted(names_a)
    a = sorted(([row[names_a.index(c)] for c in order] for row in rows_a), key=lambda r: [_key(v) for v in r])
    b = sorted(([row[names_b.index(c)] for c in order] for row in rows_b), key=lambda r: [_key(v) for v in r])
    found = []
    for left, right in zip(a, b, strict=True):
        bad = [f"{c}: {x!r} / {y!r}" for c, x, y in zip(order, left, right, strict=True) if not _same(x, y)]
        if bad:
            found.append("; ".join(bad))
    return found


def check(spark, folder: str, con, query, sql: str) -> list[str]:
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    con.execute(sql)
    names = [c[0] for c in con.description]
    wide = [f"{c[0]} {c[1]}" for c in con.description if str(c[1]).startswith(("HUGEINT", "DECIMAL"))]
    return [f"type {w}" for w in wide] + differences(df.columns, rows, names, con.fetchall())


def main(folder: str, wanted: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tillgrain.session import build_session

    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            found = check(spark, folder, con, query, oracles[name]) if name in oracles else ["no SQL"]
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:300]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s", *found[:4], sep="\n      " if found else " ", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
