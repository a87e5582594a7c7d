"""Properties that hold for any input."""

from __future__ import annotations

import random
import statistics
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewarden import schemas
from tracewarden.functions.columns import active_hours, exact_avg
from tracewarden.functions.median import exact_medians, part_of
from tracewarden.operators import lineage as LN
from tracewarden.plans import metric_model as M

relaxed = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
names = st.one_of(st.none(), st.sampled_from(["T.A", "T.B", "T.C"]))
objects = st.one_of(st.none(), st.lists(names, max_size=4))


@relaxed
@given(rows=st.lists(st.tuples(objects, objects, st.one_of(st.none(), st.integers(0, 100))), min_size=1, max_size=8))
def test_weighted_accesses_equal_the_multiplied_lineage(spark, as_of, rows):
    at = datetime(2024, 1, 30)
    blank = dict.fromkeys(schemas.QUERY_LOG.names)
    same = {**blank, "execution_status": "SUCCESS", "start_time": at}
    queries = [
        {**same, "query_id": f"Q{n}", "user_name": f"U{n % 2}", "rows_produced": r, "bytes_scanned": n}
        for n, (_, _, r) in enumerate(rows)
    ]
    query_log = spark.createDataFrame([tuple(q[c] for c in schemas.QUERY_LOG.names) for q in queries], schemas.QUERY_LOG)

    def array(items):
        return None if items is None else [(i, "TABLE", None) for i in items]

    access_log = spark.createDataFrame(
        [(f"Q{n}", array(base), array(direct)) for n, (base, direct, _) in enumerate(rows)], schemas.ACCESS_LOG
    )
    lineage = LN.data_access_lineage(query_log, access_log, as_of)
    expected = lineage.groupBy("source_table").agg(
        F.count(F.lit(1)).alias("access_count"),
        F.count_distinct("user_name").alias("unique_users"),
        F.sum("rows_produced").alias("total_rows_returned"),
        F.sum("bytes_scanned").alias("total_bytes_scanned"),
    )
    measured = M.metrics(
        LN.source_accesses(query_log, access_log, as_of),
        M.DATA_ACCESS,
        ["access_count", "unique_users", "total_rows_returned", "total_bytes_scanned"],
        ["source_table"],
    )
    assert sorted(measured.collect(), key=repr) == sorted(expected.collect(), key=repr)


@relaxed
@given(cents=st.lists(st.one_of(st.none(), st.integers(0, 10_000)), min_size=1, max_size=30), parts=st.integers(1, 5))
def test_exact_average_does_not_depend_on_the_order(spark, cents, parts):
    rows = spark.createDataFrame([(None if c is None else c / 100,) for c in cents], "v double")
    known = [c for c in cents if c is not None]
    expected = sum(known) / (len(known) * 100) if known else None
    for shuffled in (rows, rows.repartition(parts), rows.orderBy(F.desc("v"))):
        assert shuffled.agg(exact_avg(F.col("v"), 2)).head()[0] == expected


@relaxed
@given(hours=st.lists(st.integers(0, 23), max_size=40))
def test_active_hours_is_a_distinct_count(spark, hours):
    rows = spark.createDataFrame([(h,) for h in hours], "h int")
    assert rows.agg(active_hours(F.col("h"))).head()[0] == len(set(hours))


@relaxed
@given(
    rows=st.lists(
        st.tuples(
            st.one_of(st.none(), st.sampled_from("ab")),
            st.one_of(st.none(), st.integers(-30, 30), st.integers(-(10**15), 10**15), st.integers(0, 50).map(lambda n: 1 << n)),
        ),
        min_size=1,
        max_size=40,
    ),
    parts=st.sampled_from([(1, 1), (2, 3), (16, 2), (4096, 65_536)]),
)
def test_medians_agree_with_sorting(spark, rows, parts):
    source = spark.createDataFrame(rows, "k string, v bigint")
    histogram = source.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    found = {r.k: r.median for r in exact_medians(histogram, ["k"], "v", "n", *parts).collect()}
    values = {k: [v for key, v in rows if key == k and v is not None] for k, _ in rows}
    assert found == {k: statistics.median(v) for k, v in values.items() if v}


@pytest.mark.parametrize("parts", [1, 8, 4096])
def test_parts_keep_the_order_of_values(spark, parts):
    edge = (1 << 63) - 1
    values = sorted({*range(-40, 40), *[s * (1 << n) + d for n in range(3, 62) for d in (-1, 0, 1) for s in (-1, 1)], edge, -edge, -edge - 1})
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v bigint").coalesce(1).select(part_of(F.col("v"), parts)).collect()]
    assert found == sorted(found) and max(found) <= 64 * parts
    assert all(a == b for a, b in zip(found, values) if abs(b) <= parts)


def test_median_of_values_spread_over_fifteen_digits(spark):
    """A window sees parts, of which there are few, and never all values of a group."""
    rng = random.Random(3)
    rows = [("a", int(10 ** rng.uniform(0, 15))) for _ in range(4000)] + [("b", rng.randrange(10**15)) for _ in range(3001)]
    source = spark.createDataFrame(rows, "k string, v bigint").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    found = {r.k: r.median for r in exact_medians(source, ["k"], "v", "n", parts=8, smaller_parts=16).collect()}
    assert found == {k: statistics.median(v for key, v in rows if key == k) for k in "ab"}
    assert source.select(part_of(F.col("v"), 8)).distinct().count() <= 8 * 50


def test_tasks_of_a_spread_table_do_not_grow_with_it(spark, monkeypatch):
    from tracewarden.sources import sample_logs

    monkeypatch.setattr(sample_logs, "ROWS_OF_A_TASK", 10)
    assert sample_logs._spread(spark.range(995), "id").rdd.getNumPartitions() == 100
    assert sample_logs._spread(spark.range(5), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_tasks_that_gather_accesses_do_not_grow_with_them(spark, monkeypatch):
    from tracewarden.sources import sample_logs

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    monkeypatch.setattr(sample_logs, "ROWS_OF_A_TASK", 100)
    assert sample_logs.access_log(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-lines // 100)


def test_tasks_of_events_with_usage_have_few_dates(spark):
    from tracewarden.sources import sample_logs

    rows = sample_logs.raw_events_with_usage(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("task"), F.to_date("timestamp").alias("date"))
    assert rows.distinct().count() < rows.select("date").distinct().count() + rows.select("task").distinct().count()
