"""Samples kept per day, records as VARIANT, and tables of patterns."""

from __future__ import annotations

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewarden import schemas
from tracewarden.operators import open_records, pattern_table, stored_sample
from tracewarden.operators.agent_events import agent_events_flattened
from tracewarden.operators.evaluation import evaluation_dataset
from tracewarden.session import new_folder
from tracewarden.sources.logs import read_agent_events, write_agent_events

START = datetime(2024, 1, 1)
CONVERSATIONS = (
    "thread_id string, user_name string, agent_name string, user_query string, agent_response string, tool_used string,"
    " event_date date, event_timestamp timestamp_ntz, trace_id string"
)


def conversations(spark, n, days=12):
    rng = random.Random(6)
    rows = []
    for k in range(n):
        # Two thirds of the responses are of one day.
        at = START + timedelta(days=5 if rng.random() < 0.66 else rng.randrange(days), seconds=rng.randrange(86_400))
        short = rng.random() < 0.1
        rows.append(("t", f"u{k % 9}", "A", "what is it all about?", "x" if short else f"answer {k} " * 9, None, at.date(), at, None if k % 17 == 0 else f"TR{k}"))
    return spark.createDataFrame(rows, CONVERSATIONS).cache()


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    a, b = (sorted(map(repr, x.select(columns).collect())) for x in (left, right))
    assert a == b and a


@pytest.fixture(scope="module")
def sampled(spark):
    rows = conversations(spark, 1500)
    path = new_folder(spark, "samples")
    part = F.pmod(F.crc32("agent_response"), F.lit(4))
    for delivery in (part == 0, part.isin(1, 2), part == 3, part > 1):  # the last comes a second time
        stored_sample.add_to_samples(rows.where(delivery), path, sample_size=20)
    return rows, path


@pytest.mark.parametrize("day", [2, 6, 9, 13, 30])
@pytest.mark.parametrize("hour", [0, 15])
def test_sample_of_a_week_is_merged_from_days(spark, sampled, day, hour):
    rows, path = sampled
    as_of = START + timedelta(days=day - 1, hours=hour)
    found = stored_sample.sample_of_days(spark, path, as_of, sample_size=20, current=rows)
    expected = evaluation_dataset(rows, as_of, sample_size=20)
    if day == 30:
        assert found.isEmpty() and expected.isEmpty()
    else:
        same(found, expected)


def test_a_day_keeps_its_first_rows_and_others_are_not_read(spark, sampled):
    _, path = sampled
    stored = spark.read.parquet(path)
    assert max(r["count"] for r in stored.groupBy("event_date").count().collect()) == 20
    plan = stored_sample.sample_of_days(spark, path, START + timedelta(days=9))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    # A busy day is cut down before it is shuffled.
    new = stored.withColumn("_rank", F.lit(0))
    assert "WindowGroupLimit" in stored_sample._first_of_each_day(new.drop("_rank"), 5)._jdf.queryExecution().executedPlan().toString()


RECORDS = [
    {"agent_type": "CORTEX AGENT", "name": "N", "trace_id": "a", "usage": {"tokens": 12, "by model": [{"m": "x"}, {"m": "y"}]}, "spans": [{"name": "s"}, {"name": "t", "duration_ms": 1.5}]},
    {"agent_type": "CORTEX AGENT", "name": "N", "trace_id": "b", "usage": {"tokens": "many"}, "flag": True, "spans": []},
    {"agent_type": "CORTEX AGENT", "name": "N", "trace_id": "c", "usage": None},
]


@pytest.fixture(scope="module")
def opened(spark):
    rows = [(START + timedelta(hours=k), json.dumps(r)) for k, r in enumerate(RECORDS)]
    raw = spark.createDataFrame([*rows, (START, "no json"), (START, None)], schemas.RAW_EVENTS)
    path = new_folder(spark, "open")
    write_agent_events(open_records.open_agent_events(raw), path)
    return raw, read_agent_events(spark, path)


def test_paths_outside_the_schema(opened):
    _, stored = opened
    paths = {
        "tokens": ("$.usage.tokens", "int"),
        "tokens_text": "$.usage.tokens",
        "second_model": "$.usage['by model'][1].m",
        "second_span_ms": ("$.spans[1].duration_ms", "double"),
        "flag": ("$.flag", "boolean"),
        "nowhere": "$.nowhere[3].x",
    }
    found = {r.trace_id: tuple(r[p] for p in paths) for r in open_records.at_paths(stored, paths).collect()}
    assert found == {
        "a": (12, "12", "y", 1.5, None, None),
        "b": (None, "many", None, None, True, None),
        "c": (None, None, None, None, None, None),
    }
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST|many"):
        open_records.at_paths(stored, {"tokens": ("$.usage.tokens", "int")}, strict=True).collect()
    with pytest.raises(ValueError, match="already"):
        open_records.at_paths(stored, {"trace_id": "$.x"})


def test_flat_columns_and_fields_of_open_records(opened):
    raw, stored = opened
    flat = agent_events_flattened(raw).drop("raw_record")
    same(stored.drop(open_records.RECORD), flat)
    paths = {(r.path, r.type): r.events for r in open_records.paths_in(stored).collect()}
    assert paths["$.trace_id", "STRING"] == 3 and paths["$.usage", "OBJECT"] == 2 and paths["$.flag", "BOOLEAN"] == 1


def like(text, pattern):
    parts = re.findall(r"\\.|.", pattern, re.S)
    regex = "".join({"%": ".*", "_": "."}.get(p, re.escape(p[-1])) for p in parts)
    return re.fullmatch(regex, text, re.S | re.I) is not None


def test_pattern_table_equals_a_test_of_every_pair(spark):
    rng = random.Random(8)
    letters = ["a", "B", "c", "é", "_", "%", ".", "x1"]
    texts = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(9))) for _ in range(150)})
    pieces = [*letters[:4], ".", "x1", "%", "%", "_", "\\_", "\\%"]
    patterns = sorted({"".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(400)})
    table = spark.createDataFrame([(t,) for t in [*texts, None, *texts[:20]]], "name string")
    known = spark.createDataFrame([(k, p) for k, p in enumerate([*patterns, None])], "number int, pattern string")
    found = sorted((r.name, r.pattern) for r in pattern_table.matched_patterns(table, "name", known).collect())
    expected = sorted((t, p) for t in texts for p in patterns if like(t, p))
    assert found == expected and len(expected) > 500


def test_short_patterns_and_none(spark):
    table = spark.createDataFrame([("abc",), ("",), ("B",)], "name string")
    short = spark.createDataFrame([(p,) for p in ("%", "_", "%b%", "ab%", "%__", "", "c", "___")], "pattern string")
    found = {(r.name, r.pattern) for r in pattern_table.matched_patterns(table, "name", short).collect()}
    assert found == {("abc", "%"), ("", "%"), ("B", "%"), ("B", "_"), ("abc", "%b%"), ("B", "%b%"), ("abc", "ab%"), ("abc", "%__"), ("", ""), ("abc", "___")}
    empty = spark.createDataFrame([], "pattern string")
    assert pattern_table.matched_patterns(table, "name", empty).collect() == []
