"""Which tables and columns successful queries touched."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden import fixed_values as V
from tracewarden.functions.clock import days_before, instant
from tracewarden.operators.query_log import HISTORY_DAYS


def _sources(with_columns: bool) -> Column:
    """Source objects of a query as an array of just the fields in use.

    Zipping field by field, unlike exploding the whole objects, lets the scan
    leave out the nested fields that are not named (the column lists above all).
    """
    fields = {"objectName": "source_table", "objectDomain": "source_type"}
    if with_columns:
        fields["columns"] = "columns_accessed"
    return F.arrays_zip(*[F.col(f"base_objects_accessed.{f}").alias(n) for f, n in fields.items()])


def successful_queries(query_log: DataFrame) -> DataFrame:
    """What lineage keeps of the queries that succeeded."""
    return query_log.where(F.col("execution_status") == V.STATUS_SUCCESS).select(
        "query_id",
        "user_name",
        "role_name",
        F.col("start_time").alias("access_time"),
        "rows_produced",
        "bytes_scanned",
    )


def _accesses(query_log: DataFrame, accesses: DataFrame, as_of: datetime) -> DataFrame:
    """Successful recent queries with what they accessed (both keyed by query).

    Both sides are cut down before the join. Neither is hinted: the logs grow
    with the platform, so the strategy is left to statistics and AQE, which also
    splits skewed partitions; bucketed logs join without a shuffle.
    """
    recent = F.col("start_time").between(days_before(as_of, HISTORY_DAYS), instant(as_of))
    return successful_queries(query_log.where(recent)).join(accesses, "query_id")


QUERY_COLUMNS = ("query_id", "user_name", "role_name", "access_time", "rows_produced", "bytes_scanned")


def source_accesses(
    query_log: DataFrame, access_log: DataFrame, as_of: datetime, with_columns: bool = False
) -> DataFrame:
    """One row per query and source object, with the number of pairs it stands for.

    The lineage relation pairs every source object with every target object.
    Reports that never look at the target need only how many pairs there are, so
    ``fanout`` carries that number instead of repeating the rows. The accessed
    columns are read from storage only ``with_columns``.
    """
    targets = F.array_size("direct_objects_accessed.objectName")
    accesses = access_log.select(
        "query_id",
        F.greatest(targets, F.lit(1)).cast("bigint").alias("fanout"),
        _sources(with_columns).alias("sources"),
    )
    return _accesses(query_log, accesses, as_of).select(*QUERY_COLUMNS, "fanout", F.inline_outer("sources"))


def data_access_lineage(
    query_log: DataFrame, access_log: DataFrame, as_of: datetime, dedup: bool = False
) -> DataFrame:
    """One row per query, source object and target object (outer on both arrays).

    ``dedup=True`` keeps each query and source object once, without a target, so
    that counts and sums are not repeated per target.
    """
    if dedup:
        return source_accesses(query_log, access_log, as_of, with_columns=True).drop("fanout")
    return lineage_rows(_accesses(query_log, accessed_objects(access_log), as_of))


def accessed_objects(access_log: DataFrame, *more: str) -> DataFrame:
    """Source objects and target names of each query, as arrays, and ``more`` columns of the log."""
    return access_log.select(
        "query_id",
        *more,
        _sources(with_columns=True).alias("sources"),
        F.col("direct_objects_accessed.objectName").alias("targets"),
    )


def lineage_rows(joined: DataFrame) -> DataFrame:
    """A row per source and target object of queries joined with :func:`accessed_objects`."""
    return (
        joined.select(*QUERY_COLUMNS, "targets", F.inline_outer("sources"))
        .select("*", F.explode_outer("targets").alias("target_object"))
        .drop("targets")
    )


def pair_count() -> Column:
    """COUNT(*) of the lineage relation, over source accesses."""
    return F.coalesce(F.sum("fanout"), F.lit(0))


def pair_sum(column: str) -> Column:
    """SUM(column) of the lineage relation, over source accesses."""
    return F.sum((F.col(column).cast("decimal(38,0)") * F.col("fanout").cast("decimal(38,0)")).cast("decimal(38,0)"))
