"""Stored days: the same rows as from events, exact sets, and no event file read."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tracewarden.functions.columns import ascending
from tracewarden.operators import daily
from tracewarden.operators.agent_events import agent_events_flattened
from tracewarden.plans import activity, stored_days
from tracewarden.plans import metric_model as M
from tracewarden.session import new_folder
from tracewarden.sources import sample_logs

SF_DIR = "/root/testdata/sf0.001"
START = date(2024, 1, 1)
EVENTS = (
    "event_date date, agent_name string, event_type string, tool_used string, feedback_sentiment string,"
    " thread_id string, user_name string, span_duration_ms bigint, event_hour int"
)


def random_events(rng, n, days=12):
    def maybe(value):
        return value if rng.random() > 0.1 else None

    return [
        (
            START + timedelta(days=rng.randrange(days)),
            maybe(rng.choice("AB")),
            rng.choice(["CORTEX_AGENT_FEEDBACK", "CORTEX_AGENT_TOOL_EXECUTION", "RESPONSE"]),
            maybe("web"),
            rng.choice([None, "POSITIVE", "NEGATIVE"]),
            maybe(f"T{rng.randrange(60)}"),
            maybe(f"U{rng.randrange(9)}"),
            maybe(rng.randrange(10**12)),
            rng.randrange(24),
        )
        for _ in range(n)
    ]


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    assert sorted(map(repr, left.select(columns).collect())) == sorted(map(repr, right.select(columns).collect()))


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(4)
    rows = random_events(rng, 900)
    events = spark.createDataFrame(rows, EVENTS).cache()
    path = new_folder(spark, "days")
    first = spark.createDataFrame(random_events(rng, 50, 4), EVENTS)  # wrong at first; the refresh replaces these days
    daily.refresh_days(first, path)
    daily.refresh_days(events.where(F.col("event_date") < START + timedelta(days=7)), path)
    daily.refresh_days(events.where(F.col("event_date") >= START + timedelta(days=5)), path)
    daily.refresh_days(events.where(F.col("event_date") == START + timedelta(days=9)), path)
    return events, path


def test_numbers_are_unique_and_never_change(spark, stored):
    events, path = stored
    ids = daily.known_values(spark, path)
    before = {(r.kind, r.value): r.number for r in ids.collect()}
    for kind, column in daily.SETS.items():
        numbers = sorted(n for (k, _), n in before.items() if k == kind)
        assert numbers == list(range(1, len(numbers) + 1))
        assert {r[0] for r in events.select(column).where(f"{column} IS NOT NULL").distinct().collect()} <= {v for k, v in before if k == kind}
    daily.number_new_values(spark.createDataFrame([("threads", "T1"), ("users", "new"), ("users", "U1")], "kind string, value string"), path)
    after = {(r.kind, r.value): r.number for r in daily.known_values(spark, path).collect()}
    assert len(after) == len(before) + 1 and all(after[k] == n for k, n in before.items())
    assert after["users", "new"] == max(n for (k, _), n in before.items() if k == "users") + 1


@pytest.mark.parametrize("length", [0, 3, 90])
def test_reports_equal_those_from_events(spark, stored, as_of, length):
    events, path = stored
    days = daily.read_days(spark, path)
    as_of = as_of.replace(day=12)
    same(stored_days.daily_conversations(days, as_of, length), activity.daily_conversations(events, as_of, length))
    same(stored_days.feedback_rates(days, as_of, length), activity.feedback_rates(events, as_of, length))
    same(stored_days.monthly_audit_summary(days, as_of), activity.monthly_audit_summary(events, as_of))


def test_windows_count_exactly_from_the_same_sets(spark, stored, as_of):
    events, path = stored
    as_of = as_of.replace(day=12)
    found = stored_days.distinct_windows(daily.read_days(spark, path), as_of, [1, 4, 30])
    for length in (1, 4, 30):
        since = events.where(F.col("event_date").between(F.lit(as_of.date() - timedelta(days=length)), F.lit(as_of.date())))
        expected = since.groupBy("agent_name").agg(F.count_distinct("thread_id").alias("conversations"), F.count_distinct("user_name").alias("unique_users"))
        same(found.where(F.col("window_days") == length).drop("window_days"), expected)


@pytest.mark.parametrize(
    "dimensions, where",
    [(["agent_name"], None), (["event_date"], "event_date > DATE '2024-01-04'"), ([], "agent_name = 'A'"), (["tool_used"], None), (["event_hour"], None)],
)
def test_metrics_from_stored_days_equal_those_from_events(spark, stored, dimensions, where):
    events, path = stored
    days = daily.read_days(spark, path)
    measures = list(M.AGENT_EVENTS.measures)
    asked = [measures] if dimensions != ["tool_used"] else [[m for m in measures if m not in M.AGENT_EVENTS.stored_sets], measures]
    for names in asked:
        arguments = (events, M.AGENT_EVENTS, names, dimensions, where)
        same(M.metrics(*arguments, stored=days), M.metrics(*arguments))


def test_metrics_use_stored_days_only_where_they_answer(spark, stored):
    _, path = stored
    days = daily.read_days(spark, path)
    raw = agent_events_flattened(sample_logs.raw_events(spark, SF_DIR))

    def reads(measures, dimensions, **more):
        files = M.metrics(raw, M.AGENT_EVENTS, measures, dimensions, stored=days, **more).inputFiles()
        return {"days" if path in f else "events" for f in files}

    additive, distinct = ["total_events", "positive_feedback_rate"], ["unique_users"]
    assert reads(additive, ["agent_name", "tool_used"]) == {"days"}
    assert reads(additive + distinct, [F.trunc("event_date", "month").alias("month"), "agent_name"]) == {"days"}
    assert reads(additive, ["agent_name"], where=F.col("event_date") > "2024-01-03", order_by=[ascending("agent_name")]) == {"days"}
    assert reads(distinct, ["tool_used"]) == {"events"}  # sets are kept per agent and day
    assert reads(additive, ["user_name"]) == {"events"}
    assert reads(additive, ["agent_name"], where="event_hour > 3") == {"events"}


def test_a_day_is_pruned_to_and_nothing_is_stored_of_no_events(spark, stored):
    events, path = stored
    days = daily.read_days(spark, path)
    plan = days.partials.where("event_date = DATE '2024-01-05'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    count = days.partials.count()
    daily.refresh_days(events.where("false"), path)
    assert daily.read_days(spark, path).partials.count() == count


def test_a_refresh_computes_its_events_once(spark):
    rows = spark.createDataFrame(random_events(random.Random(5), 40), EVENTS)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    daily.refresh_days(rows.mapInPandas(counted, rows.schema), new_folder(spark, "days"))
    assert seen.value == 40
