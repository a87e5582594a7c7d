"""Named dimensions and measures over the audit relations.

A :class:`LogicalTable` names what can be grouped by and measured;
:func:`metrics` turns a request into one ``groupBy().agg()``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden import fixed_values as V
from tracewarden.functions.clock import dates_before, days_before, instant, today
from tracewarden.functions.columns import ascending, descending
from tracewarden.operators.daily import StoredDays, distinct_counts


@dataclass(frozen=True)
class LogicalTable:
    """Dimensions and measures as SQL expressions over a base relation.

    ``stored_measures`` are the same measures over the partials of stored days, and
    ``stored_sets`` names the sets that distinct counts come from.
    """

    name: str
    dimensions: Mapping[str, str]
    measures: Mapping[str, str]
    time_dimensions: Mapping[str, str] = field(default_factory=dict)
    stored_measures: Mapping[str, str] = field(default_factory=dict)
    stored_sets: Mapping[str, str] = field(default_factory=dict)

    def dimension(self, name: str) -> Column:
        known = {**self.dimensions, **self.time_dimensions}
        if name not in known:
            raise KeyError(f"{self.name} has no dimension {name!r}, only {sorted(known)}")
        return F.expr(known[name]).alias(name)

    def measure(self, name: str) -> Column:
        if name not in self.measures:
            raise KeyError(f"{self.name} has no measure {name!r}, only {sorted(self.measures)}")
        return F.expr(self.measures[name]).alias(name)


def _same(*names: str) -> dict[str, str]:
    return {name: name for name in names}


def _where(condition: str, times: str = "1") -> str:
    return f"sum(CASE WHEN {condition} THEN {times} ELSE 0 END)"


def _large_sum(product: str) -> str:
    """Sum of a product of 64-bit numbers, which may leave their range."""
    wide = " * ".join(f"CAST({name} AS DECIMAL(38, 0))" for name in product.split(" * "))
    return f"sum(CAST({wide} AS DECIMAL(38, 0)))"


_IS_POSITIVE = f"feedback_sentiment = '{V.POSITIVE}'"
_HAS_SENTIMENT = "feedback_sentiment IS NOT NULL"

AGENT_EVENTS = LogicalTable(
    "agent_events",
    dimensions=_same(
        "agent_name",
        "user_name",
        "event_type",
        "tool_used",
        "feedback_sentiment",
        "thread_id",
        "event_date",
        "event_hour",
    ),
    time_dimensions=_same("event_timestamp"),
    measures={
        "total_events": "count(1)",
        "total_conversations": "count(DISTINCT thread_id)",
        "unique_users": "count(DISTINCT user_name)",
        "positive_feedback_count": _where(_IS_POSITIVE),
        "negative_feedback_count": _where(f"feedback_sentiment = '{V.NEGATIVE}'"),
        "total_feedback": _where(_HAS_SENTIMENT),
        "positive_feedback_rate": (
            f"round(CAST({_where(_IS_POSITIVE)} AS DOUBLE) * 100 / nullif({_where(_HAS_SENTIMENT)}, 0), 2)"
        ),
        "avg_response_time_ms": "avg(span_duration_ms)",
        "tool_invocations": _where(f"event_type LIKE '{V.TOOL_EVENT_PATTERN}'"),
    },
    stored_measures={
        "total_events": "sum(events)",
        "positive_feedback_count": _where(_IS_POSITIVE, "events"),
        "negative_feedback_count": _where(f"feedback_sentiment = '{V.NEGATIVE}'", "events"),
        "total_feedback": _where(_HAS_SENTIMENT, "events"),
        "positive_feedback_rate": (
            f"round(CAST({_where(_IS_POSITIVE, 'events')} AS DOUBLE) * 100 / nullif({_where(_HAS_SENTIMENT, 'events')}, 0), 2)"
        ),
        "avg_response_time_ms": "CAST(sum(duration_sum) AS DOUBLE) / nullif(sum(durations), 0)",
        "tool_invocations": _where(f"event_type LIKE '{V.TOOL_EVENT_PATTERN}'", "events"),
    },
    stored_sets={"total_conversations": "threads", "unique_users": "users"},
)

FAILED_QUERIES = LogicalTable(
    "failed_queries",
    dimensions=_same(
        "user_name", "role_name", "error_category", "error_code", "failure_date", "failure_hour"
    ),
    measures={
        "failure_count": "count(1)",
        "unique_users_with_failures": "count(DISTINCT user_name)",
        "permission_denied_count": _where(f"error_category = '{V.ERROR_CATEGORIES[0][1]}'"),
    },
)

USER_ACTIVITY = LogicalTable(
    "user_activity",
    dimensions=_same("user_name", "activity_date"),
    measures={
        "total_queries": "sum(total_queries)",
        "successful_queries": "sum(successful_queries)",
        "failed_queries": "sum(failed_queries)",
        "failure_rate_pct": (
            "round(CAST(sum(failed_queries) AS DOUBLE) * 100 / nullif(sum(total_queries), 0), 2)"
        ),
        "total_rows_produced": "CAST(sum(total_rows_produced) AS DECIMAL(38, 0))",
        "total_bytes_scanned": "CAST(sum(total_bytes_scanned) AS DECIMAL(38, 0))",
        "active_users": "count(DISTINCT user_name)",
        "active_days": "count(DISTINCT activity_date)",
    },
)

# Base relation: source accesses, whose ``fanout`` is the number of lineage rows
# each of them stands for.
DATA_ACCESS = LogicalTable(
    "data_access",
    dimensions=_same("user_name", "role_name", "source_table", "source_type"),
    time_dimensions=_same("access_time"),
    measures={
        "access_count": "coalesce(sum(fanout), 0)",
        "unique_tables_accessed": "count(DISTINCT source_table)",
        "unique_users": "count(DISTINCT user_name)",
        "total_rows_returned": _large_sum("rows_produced * fanout"),
        "total_bytes_scanned": _large_sum("bytes_scanned * fanout"),
    },
)

TABLES = {t.name: t for t in (AGENT_EVENTS, FAILED_QUERIES, USER_ACTIVITY, DATA_ACCESS)}


def metrics(
    base: DataFrame,
    table: LogicalTable,
    measures: Sequence[str],
    dimensions: Sequence[str | Column] = (),
    where: Column | str | None = None,
    having: Column | str | None = None,
    order_by: Sequence[Column | str] = (),
    limit: int | None = None,
    stored: StoredDays | None = None,
) -> DataFrame:
    """Compute measures by dimensions.

    A dimension is a name of the table or an aliased column over the base
    (``F.trunc("event_date", "month").alias("month")``). ``where`` filters base
    rows; ``having`` and ``order_by`` use the result's names. With ``stored`` days the base is
    read only if they do not hold what is asked for.
    """
    groups = [table.dimension(d) if isinstance(d, str) else d for d in dimensions]
    result = None if stored is None else from_stored(stored, table, measures, groups, where)
    if result is None:
        rows = base if where is None else base.where(where)
        result = rows.groupBy(*groups).agg(*[table.measure(m) for m in measures])
    if having is not None:
        result = result.where(having)
    if order_by:
        result = result.orderBy(*order_by)
    return result if limit is None else result.limit(limit)


def from_stored(
    days: StoredDays, table: LogicalTable, measures: Sequence[str], groups: Sequence[Column], where: Column | str | None
) -> DataFrame | None:
    """The measures out of stored days; None if these lack one, or a column that groups or filter."""
    if not {*measures} <= {*table.stored_measures, *table.stored_sets}:
        return None
    distinct = [m for m in measures if m in table.stored_sets]
    try:
        partials, sets = (rows if where is None else rows.where(where) for rows in (days.partials, days.sets))
        sums = [F.expr(table.stored_measures[m]).alias(m) for m in measures if m not in distinct]
        added = partials.groupBy(*groups).agg(*sums, F.lit(1).alias("_all"))
        names = added.columns[: len(groups)]
        if not distinct:
            return added.drop("_all")
        counts = distinct_counts(sets, [*groups]).select(*[F.col(n).alias(f"_{n}") for n in names], F.lit(1).alias("_one"), *table.stored_sets.values())
    except AnalysisException:
        return None
    same = F.col("_all") == F.col("_one")
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    # A group of values that are all null has no set, and counts 0.
    found = {m: F.coalesce(F.col(table.stored_sets[m]), F.lit(0)) if m in distinct else F.col(m) for m in measures}
    return added.join(counts, same, "left").select(*names, *[value.alias(m) for m, value in found.items()])


def profile(base: DataFrame, table: LogicalTable) -> DataFrame:
    """All measures by each dimension in turn: a row per dimension and value, from one scan.

    Values are texts; instants have microseconds.
    """

    def value(name: str) -> Column:
        if name in table.time_dimensions:
            return F.date_format(table.dimension(name), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return table.dimension(name).cast("string")

    names = [*table.dimensions, *table.time_dimensions]
    pairs = [F.struct(F.lit(name).alias("dimension"), value(name).alias("value")) for name in names]
    rows = base.select("*", F.inline(F.array(*pairs)))
    return rows.groupBy("dimension", "value").agg(*[table.measure(m) for m in table.measures])


def conversations_last_week(events: DataFrame, as_of: datetime) -> DataFrame:
    """How many conversations did each agent have last week?"""
    return metrics(
        events,
        AGENT_EVENTS,
        ["total_conversations"],
        ["agent_name"],
        where=F.col("event_date").between(dates_before(as_of, 7), today(as_of)),
        order_by=[descending("total_conversations")],
    ).withColumnRenamed("total_conversations", "conversations")


def positive_rate(events: DataFrame) -> DataFrame:
    """What is the positive feedback rate for each agent?"""
    result = metrics(
        events,
        AGENT_EVENTS,
        ["positive_feedback_count", "total_feedback", "positive_feedback_rate"],
        ["agent_name"],
        order_by=[ascending("positive_feedback_rate")],
    )
    return result.withColumnsRenamed(
        {
            "positive_feedback_count": "positive",
            "total_feedback": "total",
            "positive_feedback_rate": "positive_rate_pct",
        }
    )


def highest_failure_users(
    activity: DataFrame, as_of: datetime, min_queries: int = 10, limit: int = 10
) -> DataFrame:
    """Which users have the highest failure rates?"""
    result = metrics(
        activity,
        USER_ACTIVITY,
        ["total_queries", "failed_queries", "failure_rate_pct"],
        ["user_name"],
        where=F.col("activity_date").between(dates_before(as_of, 30), today(as_of)),
        having=F.col("total_queries") >= min_queries,
        order_by=[descending("failure_rate_pct"), ascending("user_name")],
        limit=limit,
    )
    return result.withColumnsRenamed(
        {"total_queries": "queries", "failed_queries": "failures", "failure_rate_pct": "failure_rate"}
    )


def most_accessed_tables(accesses: DataFrame, as_of: datetime, limit: int = 20) -> DataFrame:
    """Show me the most accessed tables (accesses without a table included)."""
    return metrics(
        accesses,
        DATA_ACCESS,
        ["access_count", "unique_users"],
        ["source_table"],
        where=F.col("access_time").between(days_before(as_of, 30), instant(as_of)),
        order_by=[descending("access_count"), ascending("source_table")],
        limit=limit,
    )
