"""Reports on failures, unusual queries and working hours."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden import fixed_values as V
from tracewarden.functions.clock import dates_before, days_before, instant, today
from tracewarden.functions.columns import ascending, descending, preview

PERMISSION_DENIED = V.ERROR_CATEGORIES[0][1]
SUNDAY, SATURDAY = 1, 7


def failures_by_category(failures: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Failures, affected users and the set of error codes per category.

    Codes and users are made distinct apart, each in tasks of their own, before
    either meets in its category's row.
    """
    recent = failures.where(F.col("failure_date").between(dates_before(as_of, days), today(as_of)))
    codes = (
        recent.groupBy("error_category", "error_code")
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("error_category")
        .agg(F.sum("times").alias("failure_count"), F.array_sort(F.array_agg("error_code")).alias("error_codes"))
    )
    users = (
        recent.groupBy("error_category", "user_name")
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy(F.col("error_category").alias("of_category"))
        .agg(F.count("user_name").alias("affected_users"))
    )
    return (
        codes.join(users, F.col("error_category").eqNullSafe(F.col("of_category")))
        .select("error_category", "failure_count", "affected_users", "error_codes")
        .orderBy(descending("failure_count"), ascending("error_category"))
    )


def _denied(failures: DataFrame, as_of: datetime, days: int) -> DataFrame:
    recent = F.col("failure_date").between(dates_before(as_of, days), today(as_of))
    return failures.where((F.col("error_category") == PERMISSION_DENIED) & recent)


def permission_denials(failures: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Denials per user, role and day; what was asked is in :func:`denial_samples`."""
    return (
        _denied(failures, as_of, days)
        .groupBy("user_name", "role_name", "failure_date")
        .agg(F.count(F.lit(1)).alias("denial_count"))
        .orderBy(descending("denial_count"), ascending("user_name"), ascending("role_name"), ascending("failure_date"))
    )


def denial_samples(failures: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Distinct beginnings of denied queries per user, role and day, and how often each came."""
    return (
        _denied(failures, as_of, days)
        .where(F.col("query_preview").isNotNull())
        .groupBy("user_name", "role_name", "failure_date", preview(F.col("query_preview"), 100).alias("query_sample"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


def high_row_queries(
    history: DataFrame, as_of: datetime, min_rows: int = 10_000, days: int = 7, limit: int = 20
) -> DataFrame:
    """Queries that produced the most rows."""
    return (
        history.where((F.col("rows_produced") > min_rows) & (F.col("start_time").between(days_before(as_of, days), instant(as_of))))
        .select(
            "user_name",
            "query_id",
            "rows_produced",
            preview(F.col("query_text"), 300).alias("query_preview"),
            "start_time",
        )
        .orderBy(descending("rows_produced"), ascending("query_id"))
        .limit(limit)
    )


def after_hours_activity(history: DataFrame, as_of: datetime, days: int = 30, more_than: int = 5) -> DataFrame:
    """Users, days and hours outside business hours on weekdays with many queries."""
    start = F.col("start_time")
    hour = F.hour(start)
    opening, closing = V.BUSINESS_HOURS
    outside = (
        (start.between(days_before(as_of, days), instant(as_of)))
        & ~hour.between(opening, closing)
        & ~F.dayofweek(start).isin(SUNDAY, SATURDAY)
    )
    return (
        history.where(outside)
        .groupBy("user_name", F.to_date(start).alias("activity_date"), hour.alias("activity_hour"))
        .agg(F.count(F.lit(1)).alias("query_count"))
        .where(F.col("query_count") > more_than)
        .orderBy(
            descending("activity_date"), descending("query_count"), ascending("user_name"), ascending("activity_hour")
        )
    )
