"""Reports on data access. All take ``source_accesses`` (see operators.lineage).

None of them looks at the target object, so pair counts and sums use the
``fanout`` weight instead of the multiplied lineage rows; results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden import fixed_values as V
from tracewarden.functions.clock import days_before, instant, months_before
from tracewarden.functions.columns import ascending, descending, matches_any
from tracewarden.operators.lineage import pair_count, pair_sum


def _since(accesses: DataFrame, as_of: datetime, days: int) -> DataFrame:
    return accesses.where(F.col("access_time").between(days_before(as_of, days), instant(as_of)))


def top_accessed_tables(accesses: DataFrame, as_of: datetime, days: int = 30, limit: int = 20) -> DataFrame:
    return (
        _since(accesses, as_of, days)
        .where(F.col("source_table").isNotNull())
        .groupBy("source_table")
        .agg(
            pair_count().alias("access_count"),
            F.count_distinct("user_name").alias("unique_users"),
            pair_sum("rows_produced").alias("total_rows_returned"),
        )
        .orderBy(descending("access_count"), ascending("source_table"))
        .limit(limit)
    )


def sensitive_table_access(
    accesses: DataFrame, patterns: Sequence[str] = V.SENSITIVE_TABLE_PATTERNS
) -> DataFrame:
    """Who read tables whose name matches a pattern; no window beyond the lineage's own."""
    return (
        accesses.where(matches_any(F.col("source_table"), patterns, ignore_case=True))
        .groupBy("user_name", "role_name")
        .agg(
            pair_count().alias("access_count"),
            F.min("access_time").alias("first_access"),
            F.max("access_time").alias("last_access"),
        )
        .orderBy(descending("access_count"))
    )


def column_access(accesses: DataFrame, as_of: datetime, pattern: str, days: int = 30) -> DataFrame:
    """Accesses per column of matching tables; NULL stands for 'no column listed'."""
    return (
        _since(accesses, as_of, days)
        .where(F.col("source_table").ilike(pattern))
        .select("source_table", "fanout", F.explode_outer("columns_accessed.columnName").alias("column_accessed"))
        .groupBy("source_table", "column_accessed")
        .agg(pair_count().alias("access_count"))
        .orderBy(descending("access_count"))
    )


def weekly_access_report(accesses: DataFrame, as_of: datetime, months: int = 1) -> DataFrame:
    """Users, tables, rows and pairs per week (weeks start on Monday)."""
    return (
        accesses.where(F.col("access_time").between(months_before(as_of, months), instant(as_of)))
        .groupBy(F.trunc(F.to_date("access_time"), "week").alias("report_week"))
        .agg(
            F.count_distinct("user_name").alias("users_with_access"),
            F.count_distinct("source_table").alias("tables_accessed"),
            pair_sum("rows_produced").alias("total_rows_retrieved"),
            pair_count().alias("total_queries"),
        )
        .orderBy(descending("report_week"))
    )


def investigate_user_access(accesses: DataFrame, user_name: str) -> DataFrame:
    return (
        accesses.where(F.col("user_name") == user_name)
        .groupBy("source_table")
        .agg(pair_count().alias("access_count"))
        .orderBy(descending("access_count"))
    )
