from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewarden import catalog as C
from tracewarden.plans import activity
from tracewarden.plans import metric_model as M

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return C._events(spark, SF_DIR).cache()


def test_surface():
    assert {t: (len(m.dimensions), len(m.time_dimensions), len(m.measures)) for t, m in M.TABLES.items()} == {
        "agent_events": (8, 1, 9),
        "failed_queries": (6, 0, 3),
        "user_activity": (2, 0, 8),
        "data_access": (4, 1, 5),
    }


@pytest.mark.parametrize(
    "table, base",
    [
        ("agent_events", C._events),
        ("failed_queries", C._failures),
        ("user_activity", C._activity),
        ("data_access", C._accesses),
    ],
)
def test_every_dimension_with_every_measure(spark, table, base):
    model, rows = M.TABLES[table], base(spark, SF_DIR)
    for dimension in [*model.dimensions, *model.time_dimensions]:
        result = M.metrics(rows, model, list(model.measures), [dimension])
        assert result.columns == [dimension, *model.measures]
    assert M.metrics(rows, model, list(model.measures)).count() == 1


def test_unknown_names(events):
    with pytest.raises(KeyError, match="no measure"):
        M.metrics(events, M.AGENT_EVENTS, ["nonsense"])
    with pytest.raises(KeyError, match="no dimension"):
        M.metrics(events, M.AGENT_EVENTS, ["total_events"], ["nonsense"])


def test_nothing_counts_as_zero(spark):
    row = M.metrics(C._accesses(spark, SF_DIR).where("false"), M.DATA_ACCESS, ["access_count", "total_rows_returned"]).head()
    assert (row.access_count, row.total_rows_returned) == (0, None)


def test_where_having_order_and_limit(events):
    rows = M.metrics(
        events,
        M.AGENT_EVENTS,
        ["total_events"],
        ["user_name"],
        where="event_date >= '2024-01-15'",
        having="total_events > 1",
        order_by=[F.col("total_events").desc(), "user_name"],
        limit=3,
    ).collect()
    counts = [r.total_events for r in rows]
    assert len(rows) == 3 and counts == sorted(counts, reverse=True) and min(counts) > 1


def test_questions_from_the_analysts(spark, events):
    """Kinds of question the model has to express."""
    trend = M.metrics(
        C._failures(spark, SF_DIR), M.FAILED_QUERIES, ["failure_count"], ["failure_date", "error_category"]
    )
    assert trend.count() > 0
    lowest = M.metrics(
        events,
        M.AGENT_EVENTS,
        ["positive_feedback_rate"],
        ["agent_name"],
        order_by=["positive_feedback_rate"],
        limit=1,
    )
    assert lowest.count() == 1
    speed = M.metrics(events, M.AGENT_EVENTS, ["avg_response_time_ms"], ["agent_name"])
    assert speed.count() == 4
    busiest = M.metrics(events, M.AGENT_EVENTS, ["total_events"], ["user_name"], where=F.col("agent_name") == C.AGENT)
    assert busiest.count() > 0


def test_shares_and_totals_are_consistent(spark, events):
    shares = activity.tool_usage_distribution(events, C.AS_OF).groupBy("agent_name").agg(F.sum("pct_of_agent").alias("s"))
    assert all(abs(r.s - 100) < 0.1 for r in shares.collect())
    model = M.metrics(events, M.AGENT_EVENTS, ["positive_feedback_count"], ["agent_name"]).collect()
    report = activity.feedback_rates(events, C.AS_OF).collect()
    assert {(r.agent_name, r.positive) for r in report} == {(r.agent_name, r.positive_feedback_count) for r in model}


def test_sums_beyond_64_bits(spark, as_of):
    accesses = spark.range(3).selectExpr(
        "'u' AS user_name", "'r' AS role_name", "'t' AS source_table", "'TABLE' AS source_type",
        "TIMESTAMP_NTZ '2024-01-30 00:00:00' AS access_time", "4000000000000000000 AS rows_produced",
        "4000000000000000000 AS bytes_scanned", "2L AS fanout",
    )
    row = M.metrics(accesses, M.DATA_ACCESS, list(M.DATA_ACCESS.measures)).head()
    assert int(row.total_bytes_scanned) == int(row.total_rows_returned) == 24 * 10**18
    days = spark.range(3).selectExpr(
        "'u' AS user_name", "date_add(DATE '2024-01-28', CAST(id AS INT)) AS activity_date", "1L AS total_queries",
        "1L AS successful_queries", "0L AS failed_queries", "0.0D AS failure_rate_pct",
        "9000000000000000000BD AS total_rows_produced", "CAST(4000000000000000000 AS DECIMAL(38, 0)) AS total_bytes_scanned",
    )
    row = M.metrics(days, M.USER_ACTIVITY, list(M.USER_ACTIVITY.measures)).head()
    assert int(row.total_rows_produced) == 27 * 10**18 and int(row.total_bytes_scanned) == 12 * 10**18


def test_profile_equals_single_dimensions(events):
    profile = M.profile(events, M.AGENT_EVENTS)
    measures = list(M.AGENT_EVENTS.measures)
    for name in ("tool_used", "event_hour"):
        alone = M.metrics(events, M.AGENT_EVENTS, measures, [name])
        alone = alone.withColumn(name, F.col(name).cast("string"))
        mine = profile.where(F.col("dimension") == name).select(F.col("value").alias(name), *measures)
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, alone.collect()))
