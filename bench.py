"""Time the named queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default all).
"""

from __future__ import annotations

import json
import os
import re
import time

from tracewarden.catalog import INDEXES, QUERIES
from tracewarden.session import build_session


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> None:
        # The noop sink computes every row and column and keeps nothing.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    # Start the JVM's compilers before timing.
    for name in ("feedback_rates", "top_accessed_tables", "evaluation_by_agent"):
        run(name)
    # Searches and reports of stored days find these stored; each build is an entry of its own.
    searched = any(name.startswith("search_") or name.endswith("_stored") for name in names)
    seconds = {name: timed(lambda: build(spark, sf_dir)) for name, build in INDEXES.items() if searched}
    seconds |= {name: timed(lambda: run(name)) for name in names}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
