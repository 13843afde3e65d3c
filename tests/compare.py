"""Run registered queries next to their SQL and report differences.

Usage: python tests/compare.py [folder] [key-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "item"):
        return repr(value.item())
    return repr(value)


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, key: str, build, sql: str | None) -> str | None:
    """None when equal, else a short description of the difference."""
    frame = build(spark, folder)
    ours = bag(frame.columns, [tuple(row) for row in frame.collect()])
    if sql is None:
        return None
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    theirs = bag(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if ours == theirs:
        return None if sum(ours.values()) else "no rows"
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; {sum(only_ours.values())} and {sum(only_theirs.values())} differ"
        f"\n   ours   {[str(r)[:1500] for r in list(only_ours)[:2]]}\n   theirs {[str(r)[:1500] for r in list(only_theirs)[:2]]}"
    )


def main(arguments: list[str]) -> int:
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    prefixes = tuple(arguments[1:]) or ("",)
    import __spark_entry__ as entry
    from quireflow.session import build_session

    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    failures = 0
    for key, build in entry.queries().items():
        if not key.startswith(prefixes):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, folder, key, build, oracles.get(key))
        except Exception as error:  # noqa: BLE001 - report every query
            problem = f"{type(error).__name__}: {str(error)[:1800]}"
        failures += problem is not None
        state = "FAIL " + problem if problem else ("ok" if key in oracles else "ok (rows only)")
        print(f"{key:32s} {time.time() - started:6.2f}s {state}", flush=True)
    print(f"{failures} failed")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
