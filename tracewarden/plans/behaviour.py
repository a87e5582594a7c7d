"""Reports on users, roles and AI function usage, and the activity export."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden import fixed_values as V
from tracewarden.functions.clock import date_months_before, dates_before, days_before, instant, today
from tracewarden.functions.columns import ascending, descending, exact_avg, large_sum, level


def user_activity(activity: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Totals per user and the mean of the daily failure rates."""
    return (
        activity.where(F.col("activity_date").between(dates_before(as_of, days), today(as_of)))
        .groupBy("user_name")
        .agg(
            F.count_distinct("activity_date").alias("active_days"),
            F.sum("total_queries").alias("total_queries"),
            F.sum("failed_queries").alias("total_failures"),
            F.round(exact_avg(F.col("failure_rate_pct"), 2), 2).alias("avg_failure_rate"),
            F.sum("total_rows_produced").cast("decimal(38,0)").alias("total_rows"),
        )
        .orderBy(descending("total_queries"), ascending("user_name"))
    )


def high_failure_users(
    activity: DataFrame, as_of: datetime, days: int = 7, min_queries: int = 10, min_rate: int = 10
) -> DataFrame:
    rate = F.col("failure_rate_pct")
    return (
        activity.where(
            (F.col("activity_date").between(dates_before(as_of, days), today(as_of)))
            & (F.col("total_queries") >= min_queries)
            & (rate > min_rate)
        )
        .select(
            "user_name",
            "activity_date",
            "total_queries",
            "failed_queries",
            "failure_rate_pct",
            level(rate, V.FAILURE_ALERT_LEVELS, V.NORMAL_LEVEL).alias("status"),
        )
        .orderBy(descending("failure_rate_pct"), ascending("user_name"), ascending("activity_date"))
    )


def role_usage(history: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return (
        history.where(F.col("start_time").between(days_before(as_of, days), instant(as_of)))
        .groupBy("role_name")
        .agg(
            F.count_distinct("user_name").alias("unique_users"),
            F.count(F.lit(1)).alias("total_queries"),
            large_sum(F.col("rows_produced")).alias("total_rows"),
        )
        .orderBy(descending("total_queries"))
    )


def _function_calls(history: DataFrame, as_of: datetime, days: int) -> DataFrame:
    return history.where(
        F.col("cortex_function_used").isNotNull() & (F.col("start_time").between(days_before(as_of, days), instant(as_of)))
    )


def function_usage(history: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Calls, users and mean seconds per AI function."""
    return (
        _function_calls(history, as_of, days)
        .groupBy("cortex_function_used")
        .agg(
            F.count(F.lit(1)).alias("call_count"),
            F.count_distinct("user_name").alias("unique_users"),
            F.round(exact_avg(F.col("elapsed_seconds"), 3), 2).alias("avg_seconds"),
        )
        .orderBy(descending("call_count"))
    )


def function_daily_trend(history: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return (
        _function_calls(history, as_of, days)
        .groupBy(F.to_date("start_time").alias("usage_date"), "cortex_function_used")
        .agg(F.count(F.lit(1)).alias("calls"))
        .orderBy(descending("usage_date"), descending("calls"))
    )


def investigate_user_activity(activity: DataFrame, user_name: str) -> DataFrame:
    return activity.where(F.col("user_name") == user_name).orderBy(descending("activity_date"))


def investigate_user_failures(failures: DataFrame, user_name: str, limit: int = 20) -> DataFrame:
    return (
        failures.where(F.col("user_name") == user_name)
        .orderBy(descending("start_time"), ascending("query_id"))
        .limit(limit)
    )


# The default format would cut microseconds.
EXPORT_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def export_activity(activity: DataFrame, as_of: datetime, path: str, months: int = 1) -> None:
    """Write last month's activity as CSV with a header, replacing earlier files."""
    recent = activity.where(F.col("activity_date").between(date_months_before(as_of, months), today(as_of)))
    recent.write.mode("overwrite").options(**EXPORT_OPTIONS).csv(path)
