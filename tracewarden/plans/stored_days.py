"""Reports on agents out of stored days (``operators.daily``); no event is read."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden import fixed_values as V
from tracewarden.functions.clock import date_months_before, dates_before, today
from tracewarden.functions.columns import ascending, descending, weighted_pct
from tracewarden.operators.daily import StoredDays, counts_and_sums, distinct_counts


def _within(as_of: datetime, days: int) -> Column:
    return F.col("event_date").between(dates_before(as_of, days), today(as_of))


def _events_with(sentiment: str) -> Column:
    return F.sum(F.when(F.col("feedback_sentiment") == sentiment, F.col("events")).otherwise(0))


def daily_conversations(days: StoredDays, as_of: datetime, length: int = 30) -> DataFrame:
    """Threads, users and events per agent and day."""
    rows = counts_and_sums(days, _within(as_of, length), ["agent_name", "event_date"], {"total_events": F.sum("events")})
    return rows.select(
        "agent_name", "event_date", F.col("threads").alias("conversations"), F.col("users").alias("unique_users"), "total_events"
    ).orderBy(descending("event_date"), descending("conversations"), ascending("agent_name"))


def monthly_audit_summary(days: StoredDays, as_of: datetime, months: int = 3) -> DataFrame:
    """Threads, users and feedback per month and agent."""
    window = F.col("event_date").between(date_months_before(as_of, months), today(as_of))
    sums = {"positive_feedback": _events_with(V.POSITIVE), "negative_feedback": _events_with(V.NEGATIVE)}
    rows = counts_and_sums(days, window, [F.trunc("event_date", "month").alias("audit_month"), "agent_name"], sums)
    return rows.withColumnsRenamed({"threads": "total_conversations", "users": "unique_users"}).orderBy(
        descending("audit_month"), ascending("agent_name")
    )


def feedback_rates(days: StoredDays, as_of: datetime, length: int = 30) -> DataFrame:
    """Feedback totals and positive rate per agent, worst first."""
    feedback = days.partials.where(_within(as_of, length) & (F.col("event_type") == V.EVENT_FEEDBACK))
    return (
        feedback.groupBy("agent_name")
        .agg(
            F.sum("events").alias("total_feedback"),
            _events_with(V.POSITIVE).alias("positive"),
            _events_with(V.NEGATIVE).alias("negative"),
        )
        .withColumn("positive_rate_pct", weighted_pct(F.col("positive"), F.col("total_feedback")))
        .orderBy(ascending("positive_rate_pct"), ascending("agent_name"))
    )


def distinct_windows(days: StoredDays, as_of: datetime, lengths: Sequence[int] = (7, 30, 90)) -> DataFrame:
    """Exact numbers of threads and users of each agent over several windows, from one pass over the same sets."""
    windows = [F.when(_within(as_of, n), F.lit(n)) for n in lengths]
    sets = days.sets.where(_within(as_of, max(lengths)))
    sets = sets.select("*", F.explode(F.array_compact(F.array(*windows))).alias("window_days"))
    return distinct_counts(sets, ["agent_name", "window_days"]).withColumnsRenamed({"threads": "conversations", "users": "unique_users"})
