"""Run the named queries and their DuckDB SQL on the same data and compare them.

    python tools/compare.py <sf_dir> [query ...]
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def normalised(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted((tuple(_plain(row[n]) for n in order) for row in rows), key=repr)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Row count and a description of what differs (nothing, if all is well)."""
    rows = [tuple(row) for row in spark_df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return len(rows), [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    ours, theirs = normalised(spark_df.columns, rows), normalised(names, expected)
    if ours == theirs and repr(ours) == repr(theirs):
        return len(rows), []
    found = [f"{len(ours)} rows against {len(theirs)}"]
    labels = sorted(names)
    for a, b in zip(ours, theirs):
        if repr(a) != repr(b):
            found += [f"  {n}: {x!r:.150} != {y!r:.150}" for n, x, y in zip(labels, a, b) if repr(x) != repr(y)]
            break
    return len(rows), found


def main() -> int:
    from tracewarden.catalog import QUERIES
    from tracewarden.oracle import STATEMENTS
    from tracewarden.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare",
        master=f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    failures = 0
    for name in wanted:
        start = time.time()
        try:
            count, found = differences(QUERIES[name](spark, sf_dir), con, STATEMENTS[name])
        except Exception as error:  # report and go on with the next query
            count, found = -1, [f"{type(error).__name__}: {str(error)[:600]}"]
        failures += bool(found)
        verdict = "FAIL" if found else "ok  "
        print(f"{verdict} {name:32} {count:7} rows {time.time() - start:6.2f}s", *found, sep="\n", flush=True)
    print(f"{len(wanted) - failures} of {len(wanted)} agree")
    return failures


if __name__ == "__main__":
    sys.exit(main())
