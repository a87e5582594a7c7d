"""Readers of the platform logs and writers of their query-friendly layouts.

Raw telemetry is JSON text. Parsing it for every report would dominate the cost
at scale, so :func:`write_agent_events` (or the stream in
``tracewarden.streaming.refresh``) stores the flattened events once, partitioned
by date: reports then prune partitions and read only their columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden import schemas

LOG_FORMATS = ("parquet", "json", "orc")


@dataclass(frozen=True)
class AuditLogs:
    """The three platform logs an audit starts from."""

    raw_events: DataFrame
    query_log: DataFrame
    access_log: DataFrame


def _read(spark: SparkSession, path: str, schema: T.StructType, file_format: str) -> DataFrame:
    if file_format not in LOG_FORMATS:
        raise ValueError(f"unknown log format {file_format!r}, expected one of {LOG_FORMATS}")
    return spark.read.format(file_format).schema(schema).load(path)


def read_raw_events(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.RAW_EVENTS, file_format)


def stream_raw_events(
    spark: SparkSession, path: str, file_format: str = "parquet", files_per_batch: int = 10_000
) -> DataFrame:
    """New telemetry files as a stream; a backlog is worked off in bounded batches."""
    reader = spark.readStream.format(file_format).schema(schemas.RAW_EVENTS)
    return reader.option("maxFilesPerTrigger", files_per_batch).load(path)


def read_access_log(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.ACCESS_LOG, file_format)


def read_query_log(
    spark: SparkSession, path: str, file_format: str = "parquet", since: date | None = None
) -> DataFrame:
    """The query log; ``since`` prunes the date partitions :func:`write_query_log` made."""
    schema = schemas.QUERY_LOG
    if since is None:
        return _read(spark, path, schema, file_format).select(*schema.names)
    dated = T.StructType(schema.fields + [T.StructField("start_date", T.DateType())])
    return _read(spark, path, dated, file_format).where(F.col("start_date") >= F.lit(since)).drop("start_date")


def _write_by_date(rows: DataFrame, path: str, date_column: str, mode: str, mixed_dates: bool) -> None:
    """Replace (or append to) the dates present, and only those.

    Log files arrive in time order, so a task holds few dates and writes them
    without a shuffle. For input with ``mixed_dates``, rebalancing first gathers
    each date into few large files and splits busy dates.
    """
    if mixed_dates:
        rows = rows.hint("rebalance", date_column)
    writer = rows.write.mode(mode).partitionBy(date_column)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def write_agent_events(
    events: DataFrame, path: str, mode: str = "overwrite", mixed_dates: bool = False
) -> None:
    """Store flattened events by date."""
    _write_by_date(events, path, "event_date", mode, mixed_dates)


def read_agent_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_query_log(
    query_log: DataFrame, path: str, mode: str = "overwrite", mixed_dates: bool = False
) -> None:
    """Store the query log by the date a query started."""
    dated = query_log.withColumn("start_date", F.to_date("start_time"))
    _write_by_date(dated, path, "start_date", mode, mixed_dates)


def write_user_activity(activity: DataFrame, path: str) -> None:
    """Store the activity of users by day in place of what was stored of these days."""
    _write_by_date(activity, path, "activity_date", "overwrite", mixed_dates=False)


def read_user_activity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_bucketed(log: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Save a log as a table bucketed by ``query_id``.

    With both the query and the access log saved this way (same ``buckets``) the
    lineage join reads matching buckets and needs no shuffle.
    """
    log.write.mode(mode).bucketBy(buckets, "query_id").sortBy("query_id").saveAsTable(table)
