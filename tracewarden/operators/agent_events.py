"""Relations derived from the raw agent telemetry (nested JSON).

All of them are row-wise apart from the feedback summaries, so they run
unchanged on batch and on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden import fixed_values as V
from tracewarden import schemas
from tracewarden.functions.columns import computed_once, count_where, preview, ratio_pct


def _parsed(raw_events: DataFrame) -> DataFrame:
    """Adds the record as a struct ``r``; text that is not JSON gives NULL fields."""
    return computed_once(raw_events, F.from_json("record", schemas.RECORD).alias("r"))


def _first_span(field: str) -> Column:
    return F.get("r.spans", F.lit(0))[field]


def agent_events_flattened(raw_events: DataFrame, *more: str) -> DataFrame:
    """One flat row per agent event; tool, input, output and duration of the first span, and ``more`` columns of the log."""
    name = F.col("r.name")
    positive = F.expr("try_cast(r.feedback.positive AS boolean)")
    is_feedback = name == V.EVENT_FEEDBACK
    duration = F.get("r.spans", F.lit(0))["duration_ms"].try_cast("decimal(38,6)")
    return (
        _parsed(raw_events)
        .where((F.col("r.agent_type") == V.AGENT_TYPE) | name.like(V.AGENT_EVENT_PATTERN))
        .select(
            F.col("r.agent_name").alias("agent_name"),
            F.col("r.database").alias("agent_database"),
            F.col("r.schema").alias("agent_schema"),
            F.col("r.user_name").alias("user_name"),
            F.col("r.thread_id").alias("thread_id"),
            F.col("r.session_id").alias("session_id"),
            name.alias("event_type"),
            F.col("r.trace_id").alias("trace_id"),
            _first_span("name").alias("span_name"),
            _first_span("tool_name").alias("tool_used"),
            _first_span("input").alias("span_input"),
            _first_span("output").alias("span_output"),
            F.round(duration).cast("bigint").alias("span_duration_ms"),
            F.get_json_object("record", "$.spans").alias("all_spans"),
            F.array_size("r.spans").cast("bigint").alias("span_count"),
            positive.alias("feedback_positive"),
            F.col("r.feedback.comment").alias("feedback_comment"),
            F.when(is_feedback & positive, V.POSITIVE)
            .when(is_feedback & ~positive, V.NEGATIVE)
            .alias("feedback_sentiment"),
            F.col("timestamp").alias("event_timestamp"),
            F.to_date("timestamp").alias("event_date"),
            F.hour("timestamp").alias("event_hour"),
            F.col("record").alias("raw_record"),
            *more,
        )
    )


def _conversation_events(events: DataFrame) -> DataFrame:
    said = F.col("event_type").isin(V.EVENT_RESPONSE, V.EVENT_TURN)
    return events.where(said | (F.col("span_name") == V.SPAN_RESPONSE))


def agent_conversations(events: DataFrame) -> DataFrame:
    """User queries and agent responses."""
    return _conversation_events(events).select(
        "agent_name",
        "user_name",
        "thread_id",
        "event_timestamp",
        "event_date",
        F.col("span_input").alias("user_query"),
        F.col("span_output").alias("agent_response"),
        F.col("span_duration_ms").alias("response_time_ms"),
        "tool_used",
        F.col("span_count").alias("tools_called"),
        "feedback_sentiment",
        "feedback_comment",
    )


def agent_tool_usage(events: DataFrame) -> DataFrame:
    """Tool invocations with short previews of what went in and out."""
    used = (F.col("event_type") == V.EVENT_TOOL_EXECUTION) | F.col("span_name").isin(*V.TOOL_SPANS)
    return events.where(used).select(
        "agent_name",
        "user_name",
        "thread_id",
        "event_timestamp",
        "event_date",
        "tool_used",
        F.col("span_name").alias("execution_type"),
        F.col("span_duration_ms").alias("execution_time_ms"),
        preview(F.col("span_input"), 500).alias("tool_input_preview"),
        preview(F.col("span_output"), 500).alias("tool_output_preview"),
    )


def feedback_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == V.EVENT_FEEDBACK)


def feedback_counts() -> dict[str, Column]:
    """Aggregates over feedback events; the total includes events without a verdict."""
    sentiment = F.col("feedback_sentiment")
    return {
        "total_feedback": F.count(F.lit(1)),
        "positive_count": count_where(sentiment == V.POSITIVE),
        "negative_count": count_where(sentiment == V.NEGATIVE),
    }


def _with_rates(counts: DataFrame) -> DataFrame:
    total = F.col("total_feedback")
    return counts.withColumns(
        {
            "positive_rate_pct": ratio_pct(F.col("positive_count"), total),
            "negative_rate_pct": ratio_pct(F.col("negative_count"), total),
        }
    )


def agent_feedback_summary(events: DataFrame) -> DataFrame:
    """Feedback counts and rates, one row per agent and day.

    What was said is in :func:`feedback_comments`, a row per comment, as the comments of a
    busy agent and day have no bound.
    """
    aggregates = [expr.alias(name) for name, expr in feedback_counts().items()]
    return _with_rates(feedback_events(events).groupBy("agent_name", "event_date").agg(*aggregates))


def feedback_comments(events: DataFrame) -> DataFrame:
    """Distinct comments per agent and day, with when each was first made and how often."""
    return (
        feedback_events(events)
        .where(F.col("feedback_comment").isNotNull())
        .groupBy("agent_name", "event_date", "feedback_comment")
        .agg(F.min("event_timestamp").alias("first_seen"), F.count(F.lit(1)).alias("times"))
    )


def eval_conversations(events: DataFrame) -> DataFrame:
    """Responses to be judged, out of flattened events. ``trace_id`` is carried along as their key.

    Flattened events are of the agent type or of an agent's event name; a judged
    response has a name of its own, so it is there by its type.
    """
    return events.where(F.col("event_type") == V.EVENT_EVALUATED_RESPONSE).select(
        "thread_id",
        "user_name",
        "agent_name",
        F.col("span_input").alias("user_query"),
        F.col("span_output").alias("agent_response"),
        "tool_used",
        "event_date",
        "event_timestamp",
        "trace_id",
    )
