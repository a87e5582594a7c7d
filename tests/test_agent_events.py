from __future__ import annotations

import json
from datetime import datetime

from tracewarden import schemas
from tracewarden.operators import agent_events as E
from tracewarden.plans import activity

TS = datetime(2024, 1, 30, 13, 5)


def raw(spark, *records, at=TS):
    rows = [(at, r if isinstance(r, (str, type(None))) else json.dumps(r)) for r in records]
    return spark.createDataFrame(rows, schemas.RAW_EVENTS)


def event(**fields):
    return {"agent_type": "CORTEX AGENT", "name": "CORTEX_AGENT_RESPONSE", "trace_id": "T", **fields}


def flat(spark, *records):
    return E.agent_events_flattened(raw(spark, *records)).collect()


def test_text_that_is_not_a_record_is_left_out(spark):
    assert flat(spark, "not json", "[1, 2]", '"text"', None, "{") == []


def test_agent_type_or_name_pattern(spark):
    kept = flat(
        spark,
        {"agent_type": "OTHER", "name": "CORTEX_AGENT_TURN", "trace_id": "name"},
        {"agent_type": "OTHER", "name": "CORTEX AGENT1", "trace_id": "underscore is a wildcard"},
        {"agent_type": "CORTEX AGENT", "name": "ANYTHING", "trace_id": "type"},
        {"agent_type": "cortex agent", "name": "cortex_agent_turn", "trace_id": "case matters"},
        {"trace_id": "neither"},
    )
    assert {r.trace_id for r in kept} == {"name", "underscore is a wildcard", "type"}


def test_spans(spark):
    first = {"name": "planning", "tool_name": "web_search", "input": "q", "output": "a", "duration_ms": 12}
    rows = {
        r.trace_id: r
        for r in flat(
            spark,
            event(trace_id="none"),
            event(trace_id="empty", spans=[]),
            event(trace_id="two", spans=[first, {"name": "sub", "extra": 1}]),
            event(trace_id="null", spans=None),
            event(trace_id="bare", spans=[{}]),
        )
    }
    assert [rows[k].span_count for k in ("none", "empty", "two", "null", "bare")] == [None, 0, 2, None, 1]
    assert rows["empty"].span_name is None and rows["bare"].span_input is None
    two = rows["two"]
    assert (two.span_name, two.tool_used, two.span_input, two.span_output) == ("planning", "web_search", "q", "a")
    assert two.span_duration_ms == 12
    assert json.loads(two.all_spans)[1] == {"name": "sub", "extra": 1}
    assert rows["none"].all_spans is None


def test_values_of_unexpected_type(spark):
    rows = {
        r.trace_id: r
        for r in flat(
            spark,
            event(trace_id="number", user_name=7, spans=[{"duration_ms": 12.5}]),
            event(trace_id="text", spans=[{"duration_ms": "13"}]),
            event(trace_id="bad", spans=[{"duration_ms": "soon"}], agent_name="A"),
            event(trace_id="odd spans", spans=["x"], agent_name="B"),
        )
    }
    assert rows["number"].user_name == "7"
    assert [rows[k].span_duration_ms for k in ("number", "text", "bad")] == [13, 13, None]
    assert rows["bad"].agent_name == "A"
    assert rows["odd spans"].agent_name == "B" and rows["odd spans"].span_name is None


def test_sentiment_only_on_feedback_events(spark):
    def told(trace_id, name, feedback):
        return event(trace_id=trace_id, name=name, feedback=feedback)

    rows = {
        r.trace_id: r
        for r in flat(
            spark,
            told("yes", "CORTEX_AGENT_FEEDBACK", {"positive": True, "comment": "c"}),
            told("no", "CORTEX_AGENT_FEEDBACK", {"positive": False}),
            told("null", "CORTEX_AGENT_FEEDBACK", {"positive": None}),
            told("absent", "CORTEX_AGENT_FEEDBACK", None),
            told("text", "CORTEX_AGENT_FEEDBACK", {"positive": "true"}),
            told("other", "CORTEX_AGENT_RESPONSE", {"positive": True}),
        )
    }
    sentiment = {k: r.feedback_sentiment for k, r in rows.items()}
    assert sentiment == {
        "yes": "POSITIVE",
        "no": "NEGATIVE",
        "null": None,
        "absent": None,
        "text": "POSITIVE",
        "other": None,
    }
    assert rows["other"].feedback_positive is True


def test_dates_and_hours(spark):
    (row,) = flat(spark, event())
    assert (str(row.event_date), row.event_hour, row.event_timestamp) == ("2024-01-30", 13, TS)


def test_feedback_without_verdict_counts_in_the_total(spark, as_of):
    def told(agent, positive):
        return event(agent_name=agent, name="CORTEX_AGENT_FEEDBACK", feedback={"positive": positive})

    events = E.agent_events_flattened(
        raw(spark, told("A", True), told("A", False), told("A", None), told("silent", None), event(agent_name="none"))
    )
    rates = {r.agent_name: r for r in activity.feedback_rates(events, as_of).collect()}
    assert rates.keys() == {"A", "silent"}
    assert (rates["A"].total_feedback, rates["A"].positive_rate_pct) == (3, 33.33)
    assert rates["silent"].positive_rate_pct == 0.0


def test_comments_are_rows_of_their_own(spark):
    def told(comment, minute):
        record = event(agent_name="A", name="CORTEX_AGENT_FEEDBACK", feedback={"positive": True, "comment": comment})
        return raw(spark, record, at=datetime(2024, 1, 30, 9, minute))

    events = told("late", 40).union(told("early", 1)).union(told("middle", 20)).union(told("early", 50))
    events = events.union(told(None, 5)).union(told("also middle", 20))
    flattened = E.agent_events_flattened(events)
    (row,) = E.agent_feedback_summary(flattened).collect()
    assert (row.total_feedback, row.positive_count, row.positive_rate_pct) == (6, 6, 100.0)
    comments = E.feedback_comments(flattened).orderBy("first_seen", "feedback_comment").collect()
    assert [(r.feedback_comment, r.first_seen.minute, r.times) for r in comments] == [
        ("early", 1, 2),
        ("also middle", 20, 1),
        ("middle", 20, 1),
        ("late", 40, 1),
    ]


def test_null_agents_keep_their_group(spark):
    told = event(name="CORTEX_AGENT_FEEDBACK", feedback={"positive": True, "comment": "c"})
    events = E.agent_events_flattened(raw(spark, told))
    (row,) = E.agent_feedback_summary(events).collect()
    (comment,) = E.feedback_comments(events).collect()
    assert row.agent_name is None and row.total_feedback == 1
    assert comment.agent_name is None and comment.feedback_comment == "c"


def test_conversations_and_eval_conversations_differ(spark):
    records = [
        event(trace_id="turn", name="CORTEX_AGENT_TURN"),
        event(trace_id="span", name="CORTEX_AGENT_FEEDBACK", spans=[{"name": "response_generation"}]),
        event(trace_id="judged", name="RESPONSE"),
        event(trace_id="foreign", name="RESPONSE", agent_type="OTHER"),
        event(trace_id="tool", name="CORTEX_AGENT_TOOL_EXECUTION"),
    ]
    source = raw(spark, *records)
    assert E.agent_conversations(E.agent_events_flattened(source)).count() == 2
    judged = E.eval_conversations(E.agent_events_flattened(source))
    assert [r.trace_id for r in judged.collect()] == ["judged"]


def test_response_times_ignore_missing_durations(spark, as_of):
    def took(ms):
        return event(agent_name="A", spans=[{"name": "response_generation", "duration_ms": ms}])

    events = E.agent_events_flattened(raw(spark, took(1), took(2), took(2), took(10), event(agent_name="A")))
    (row,) = activity.response_times(events, as_of).collect()
    assert (row.responses, row.avg_response_ms, row.median_response_ms, row.max_response_ms) == (5, 3.75, 2.0, 10)
    silent = E.agent_events_flattened(raw(spark, event(agent_name=None)))
    (row,) = activity.response_times(silent, as_of).collect()
    assert (row.agent_name, row.responses, row.median_response_ms) == (None, 1, None)
