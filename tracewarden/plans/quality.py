"""Reports on evaluated responses. All take the parsed evaluation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden import fixed_values as V
from tracewarden.functions.clock import hours_before, instant
from tracewarden.functions.columns import ascending, count_where, descending, weighted_pct

STATUS = "evaluation_status"


def _mean(name: str) -> Column:
    """Mean score to three decimals.

    Sums of doubles differ in their last bits with the order of rows. Nine decimals do not, so
    a mean that lies halfway is rounded from them and comes out alike on every run.
    """
    mean = F.avg(f"{name}_score")
    steady = F.round(mean.try_cast("decimal(38,9)"), 3).cast("double")
    return F.coalesce(steady, F.round(mean, 3)).alias(f"avg_{name}")


def _pass_rate() -> Column:
    return weighted_pct(count_where(F.col(STATUS) == V.STATUS_PASS), F.count(F.lit(1)), 1).alias("pass_rate_pct")


def evaluation_summary(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count(F.lit(1)).alias("total_evaluated"),
        _mean("groundedness"),
        _mean("relevance"),
        _mean("safety"),
        _mean("comprehensiveness"),
        _mean("composite"),
        count_where(F.col(STATUS) == V.STATUS_PASS).alias("passed"),
        count_where(F.col(STATUS) == V.STATUS_REVIEW).alias("needs_review"),
        count_where(F.col(STATUS) == V.STATUS_CRITICAL).alias("critical_issues"),
        _pass_rate(),
    )


def evaluation_by_agent(parsed: DataFrame) -> DataFrame:
    return (
        parsed.groupBy("agent_name")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            _mean("groundedness"),
            _mean("relevance"),
            _mean("safety"),
            _mean("composite"),
            _pass_rate(),
        )
        .orderBy(descending("avg_composite"), ascending("agent_name"))
    )


def critical_issues(parsed: DataFrame) -> DataFrame:
    return (
        parsed.where(F.col(STATUS) == V.STATUS_CRITICAL)
        .select(
            "agent_name",
            "query_preview",
            "response_preview",
            "safety_score",
            "safety_reasoning",
            "safety_issues",
            "event_timestamp",
        )
        .orderBy(
            ascending("safety_score"),
            descending("event_timestamp"),
            ascending("agent_name"),
            ascending("query_preview"),
            ascending("response_preview"),
        )
    )


def groundedness_issues(parsed: DataFrame) -> DataFrame:
    return (
        parsed.where(F.col("groundedness_score") < 0.5)
        .select(
            "agent_name",
            "query_preview",
            "response_preview",
            "groundedness_score",
            "groundedness_reasoning",
            "groundedness_flags",
            "event_timestamp",
        )
        # Time and texts spread the many rows that may share a score over the sort's tasks.
        .orderBy(
            ascending("groundedness_score"),
            descending("event_timestamp"),
            ascending("agent_name"),
            ascending("query_preview"),
            ascending("response_preview"),
        )
    )


def evaluation_trend(parsed: DataFrame) -> DataFrame:
    return (
        parsed.groupBy(F.to_date("event_timestamp").alias("event_date"))
        .agg(
            F.count(F.lit(1)).alias("samples"),
            _mean("composite"),
            count_where(F.col(STATUS) == V.STATUS_CRITICAL).alias("critical_count"),
        )
        .orderBy(descending("event_date"))
    )


def critical_alert(parsed: DataFrame, as_of: datetime, hours: int = 1) -> DataFrame:
    """One row: did a critical result arrive in the last hours, how many and when."""
    recent = (F.col(STATUS) == V.STATUS_CRITICAL) & (F.col("evaluated_at").between(hours_before(as_of, hours), instant(as_of)))
    return parsed.where(recent).agg(
        (F.count(F.lit(1)) > 0).alias("fired"),
        F.count(F.lit(1)).alias("critical_count"),
        F.min("evaluated_at").alias("first_evaluated_at"),
        F.max("evaluated_at").alias("last_evaluated_at"),
    )
