"""Relations derived from the platform query log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden import fixed_values as V
from tracewarden.functions.clock import days_before, instant
from tracewarden.functions.columns import active_hours, computed_once, count_where, large_sum, matches_any, preview, ratio_pct

HISTORY_DAYS = 90
FAILURE_DAYS = 30


def ai_function(text: Column) -> Column:
    """Which AI function an upper-case query calls; the first listed one wins."""
    found = None
    for marker, name in V.AI_FUNCTIONS:
        test = text.contains(marker)
        found = F.when(test, name) if found is None else found.when(test, name)
    return found


def agent_query_history(query_log: DataFrame, as_of: datetime) -> DataFrame:
    """Recent queries that call an AI function or run on an agent warehouse."""
    rows = computed_once(query_log, F.upper("query_text").alias("upper_text"))
    text = F.col("upper_text")
    first, second = V.AI_QUERY_MARKERS
    relevant = (
        text.contains(first)
        | text.contains(second)
        | matches_any(F.col("warehouse_name"), V.AI_WAREHOUSE_PATTERNS)
    )
    rows = computed_once(
        rows.where((F.col("start_time").between(days_before(as_of, HISTORY_DAYS), instant(as_of))) & relevant),
        ai_function(text).alias("cortex_function_used"),
    )
    return rows.select(
        "query_id",
        "user_name",
        "role_name",
        "warehouse_name",
        "query_text",
        "query_type",
        "execution_status",
        "error_code",
        "error_message",
        "rows_produced",
        "bytes_scanned",
        (F.col("total_elapsed_time") / 1000).alias("elapsed_seconds"),
        "start_time",
        "end_time",
        "cortex_function_used",
    )


def error_category(error_code: Column, error_message: Column) -> Column:
    """Category of a failure; codes listed twice belong to the first category."""
    code = error_code.try_cast("int")
    category = None
    for codes, name in V.ERROR_CATEGORIES:
        test = code.isin(*codes)
        category = F.when(test, name) if category is None else category.when(test, name)
    return category.when(error_message.ilike(V.TIMEOUT_PATTERN), V.TIMEOUT_CATEGORY).otherwise(V.OTHER_CATEGORY)


def failed_queries_analysis(query_log: DataFrame, as_of: datetime) -> DataFrame:
    """Recent failures with a category and a short text preview."""
    recent = F.col("start_time").between(days_before(as_of, FAILURE_DAYS), instant(as_of))
    return query_log.where((F.col("execution_status") == V.STATUS_FAIL) & recent).select(
        "query_id",
        "user_name",
        "role_name",
        "warehouse_name",
        "error_code",
        "error_message",
        error_category(F.col("error_code"), F.col("error_message")).alias("error_category"),
        preview(F.col("query_text"), 1000).alias("query_preview"),
        "start_time",
        F.to_date("start_time").alias("failure_date"),
        F.hour("start_time").alias("failure_hour"),
    )


def user_activity_summary(query_log: DataFrame, as_of: datetime) -> DataFrame:
    """Activity per user and day, in a single partial and final aggregation."""
    status = F.col("execution_status")
    start = F.col("start_time")
    return (
        query_log.where(start.between(days_before(as_of, HISTORY_DAYS), instant(as_of)))
        .groupBy("user_name", F.to_date(start).alias("activity_date"))
        .agg(
            F.count(F.lit(1)).alias("total_queries"),
            count_where(status == V.STATUS_SUCCESS).alias("successful_queries"),
            count_where(status == V.STATUS_FAIL).alias("failed_queries"),
            large_sum(F.col("rows_produced")).alias("total_rows_produced"),
            large_sum(F.col("bytes_scanned")).alias("total_bytes_scanned"),
            (F.avg("total_elapsed_time") / 1000).alias("avg_query_seconds"),
            F.min(start).alias("first_query"),
            F.max(start).alias("last_query"),
            active_hours(F.hour(start)).alias("active_hours"),
        )
        .select(
            "user_name",
            "activity_date",
            "total_queries",
            "successful_queries",
            "failed_queries",
            ratio_pct(F.col("failed_queries"), F.col("total_queries")).alias("failure_rate_pct"),
            "total_rows_produced",
            "total_bytes_scanned",
            "avg_query_seconds",
            "first_query",
            "last_query",
            "active_hours",
        )
    )
