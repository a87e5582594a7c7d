"""Reports on agent activity and user feedback."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden import fixed_values as V
from tracewarden.functions.clock import date_months_before, dates_before, days_before, instant, today
from tracewarden.functions.columns import (
    ascending,
    count_where,
    descending,
    level,
    preview,
    ratio_pct,
    weighted_pct,
)
from tracewarden.functions.median import exact_medians
from tracewarden.operators.agent_events import (
    agent_conversations,
    agent_feedback_summary,
    agent_tool_usage,
    feedback_counts,
    feedback_events,
)


def _since(rows: DataFrame, as_of: datetime, days: int) -> DataFrame:
    return rows.where(F.col("event_date").between(dates_before(as_of, days), today(as_of)))


def daily_conversations(events: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Threads, users and events per agent and day."""
    return (
        _since(events, as_of, days)
        .groupBy("agent_name", "event_date")
        .agg(
            F.count_distinct("thread_id").alias("conversations"),
            F.count_distinct("user_name").alias("unique_users"),
            F.count(F.lit(1)).alias("total_events"),
        )
        .orderBy(descending("event_date"), descending("conversations"), ascending("agent_name"))
    )


def tool_usage_distribution(events: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Calls per agent and tool and their share of the agent's calls."""
    used = _since(agent_tool_usage(events), as_of, days).where(F.col("tool_used").isNotNull())
    calls = used.groupBy("agent_name", "tool_used").agg(F.count(F.lit(1)).alias("usage_count"))
    # The window runs over the few (agent, tool) rows, not over the events.
    of_agent = F.sum("usage_count").over(W.partitionBy("agent_name"))
    return calls.withColumn("pct_of_agent", weighted_pct(F.col("usage_count"), of_agent)).orderBy(
        ascending("agent_name"), descending("usage_count")
    )


def response_times(events: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Count, mean, exact median and maximum response time per agent.

    Responses are first counted per (agent, millisecond), which spreads a busy
    agent over all tasks; everything else is computed from these counts.
    """
    took, times = F.col("response_time_ms"), F.col("times")
    histogram = (
        _since(agent_conversations(events), as_of, days)
        .groupBy("agent_name", "response_time_ms")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    totals = histogram.groupBy("agent_name").agg(
        F.sum(times).alias("responses"),
        F.round(F.sum(took * times) / F.sum(F.when(took.isNotNull(), times)), 2).alias("avg_response_ms"),
        F.max(took).alias("max_response_ms"),
    )
    medians = exact_medians(histogram, ["agent_name"], "response_time_ms", "times").withColumnRenamed(
        "agent_name", "of_agent"
    )
    return (
        totals.join(medians, F.col("agent_name").eqNullSafe(F.col("of_agent")), "left")
        .select(
            "agent_name",
            "responses",
            "avg_response_ms",
            F.round("median", 2).alias("median_response_ms"),
            "max_response_ms",
        )
        .orderBy(descending("avg_response_ms"), ascending("agent_name"))
    )


def feedback_rates(events: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Feedback totals and positive rate per agent, worst first."""
    daily = _since(agent_feedback_summary(events), as_of, days)
    return (
        daily.groupBy("agent_name")
        .agg(
            F.sum("total_feedback").alias("total_feedback"),
            F.sum("positive_count").alias("positive"),
            F.sum("negative_count").alias("negative"),
        )
        .withColumn("positive_rate_pct", weighted_pct(F.col("positive"), F.col("total_feedback")))
        .orderBy(ascending("positive_rate_pct"), ascending("agent_name"))
    )


def negative_feedback_alerts(
    events: DataFrame, as_of: datetime, days: int = 14, min_feedback: int = 5
) -> DataFrame:
    """Alert level per agent and day from the share of negative feedback."""
    rate = F.col("negative_rate_pct")
    return (
        _since(agent_feedback_summary(events), as_of, days)
        .where(F.col("total_feedback") >= min_feedback)
        .select(
            "event_date",
            "agent_name",
            "negative_count",
            "total_feedback",
            "negative_rate_pct",
            level(rate, V.FEEDBACK_ALERT_LEVELS, V.NORMAL_LEVEL).alias("alert_level"),
        )
        .orderBy(descending("event_date"), descending("negative_rate_pct"), ascending("agent_name"))
    )


def negative_conversations(events: DataFrame, as_of: datetime, days: int = 7, limit: int = 20) -> DataFrame:
    """Newest conversations with negative feedback (only feedback events carry one)."""
    return (
        _since(agent_conversations(events), as_of, days)
        .where(F.col("feedback_sentiment") == V.NEGATIVE)
        .select(
            "agent_name",
            "user_name",
            "thread_id",
            "event_timestamp",
            preview(F.col("user_query"), 200).alias("user_query_preview"),
            preview(F.col("agent_response"), 200).alias("agent_response_preview"),
            "feedback_comment",
        )
        .orderBy(
            descending("event_timestamp"),
            ascending("thread_id"),
            ascending("agent_name"),
            ascending("feedback_comment"),
        )
        .limit(limit)
    )


def monthly_audit_summary(events: DataFrame, as_of: datetime, months: int = 3) -> DataFrame:
    """Threads, users and feedback per month and agent."""
    sentiment = F.col("feedback_sentiment")
    return (
        events.where(F.col("event_date").between(date_months_before(as_of, months), today(as_of)))
        .groupBy(F.trunc("event_date", "month").alias("audit_month"), "agent_name")
        .agg(
            F.count_distinct("thread_id").alias("total_conversations"),
            F.count_distinct("user_name").alias("unique_users"),
            count_where(sentiment == V.POSITIVE).alias("positive_feedback"),
            count_where(sentiment == V.NEGATIVE).alias("negative_feedback"),
        )
        .orderBy(descending("audit_month"), ascending("agent_name"))
    )


def _recent(events: DataFrame, as_of: datetime, days_back: int) -> DataFrame:
    """A window counted from now; the dates that it touches prune stored events."""
    return _since(events, as_of, days_back).where(
        F.col("event_timestamp").between(days_before(as_of, days_back), instant(as_of))
    )


def get_agent_events(
    events: DataFrame, as_of: datetime, agent_name: str | None = None, days_back: int = 7
) -> DataFrame:
    """Events of one agent (or of all), newest first."""
    recent = _recent(events, as_of, days_back)
    if agent_name is not None:
        recent = recent.where(F.col("agent_name") == agent_name)
    return recent.select(
        "event_type", "user_name", "thread_id", "tool_used", "feedback_sentiment", "event_timestamp"
    ).orderBy(
        descending("event_timestamp"),
        ascending("thread_id"),
        ascending("user_name"),
        ascending("event_type"),
        ascending("tool_used"),
        ascending("feedback_sentiment"),
    )


def get_feedback_summary(
    events: DataFrame, as_of: datetime, agent_name: str | None = None, days_back: int = 30
) -> DataFrame:
    """Feedback totals of one agent (or of each), over a window counted from now."""
    recent = _recent(feedback_events(events), as_of, days_back)
    if agent_name is not None:
        recent = recent.where(F.col("agent_name") == agent_name)
    aggregates = [expr.alias(name) for name, expr in feedback_counts().items()]
    return (
        recent.groupBy("agent_name")
        .agg(*aggregates)
        .withColumn("positive_rate", ratio_pct(F.col("positive_count"), F.col("total_feedback")))
    )


def investigate_thread(events: DataFrame, thread_id: str) -> DataFrame:
    """All events of one thread in time order."""
    return (
        events.where(F.col("thread_id") == thread_id)
        .select("event_timestamp", "event_type", "tool_used", "span_input", "span_output", "feedback_sentiment")
        .orderBy(*[ascending(c) for c in ("event_timestamp", "event_type", "tool_used", "span_input", "span_output", "feedback_sentiment")])
    )
