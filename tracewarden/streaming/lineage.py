"""Lineage as the logs arrive: a stream of queries joined with a stream of accesses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewarden.functions.clock import days_before, instant
from tracewarden.operators.lineage import accessed_objects, lineage_rows, successful_queries
from tracewarden.operators.query_log import HISTORY_DAYS
from tracewarden.session import settings
from tracewarden.streaming.alerts import ROCKSDB, STATE_STORE
from tracewarden.streaming.refresh import scheduled

# How late a row of either log may come, and how far apart the two logs may date one query.
LATENESS = "1 day"
APART = "1 hour"

# Both logs wait for each other in the state, days of them if one lags: RocksDB keeps it on disk, packed, in one
# store of a partition in place of four; all stores of an executor share a bound of memory.
STATE = {
    STATE_STORE: ROCKSDB,
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def lineage_stream(
    query_stream: DataFrame, access_stream: DataFrame, lateness: str = LATENESS, apart: str = APART
) -> DataFrame:
    """Lineage rows of both streams, each as soon as the second of its two log rows is there.

    ``access_stream`` has, besides the access log's columns, ``query_start_time``. A query
    and its accesses may come in any order and in different batches. Times ``apart`` bound the
    join, so Spark keeps an unmatched row only until the slower log's watermark, ``lateness``
    behind its newest row, rules a match out. Later rows are left out and counted by
    ``refresh.late_rows``; rows without a time cannot match and are not kept.
    """
    queries = (
        successful_queries(query_stream)
        .withColumn("_began", F.col("access_time").cast("timestamp"))
        .where(F.col("_began").isNotNull())
        .withWatermark("_began", lateness)
    )
    accesses = (
        accessed_objects(access_stream, "query_start_time")
        .withColumnRenamed("query_id", "_query_id")
        .withColumn("_logged", F.col("query_start_time").cast("timestamp"))
        .where(F.col("_logged").isNotNull())
        .withWatermark("_logged", lateness)
    )
    near = F.expr(f"_logged BETWEEN _began - INTERVAL {apart} AND _began + INTERVAL {apart}")
    return lineage_rows(queries.join(accesses, (F.col("query_id") == F.col("_query_id")) & near))


def refresh_lineage(
    query_stream: DataFrame,
    access_stream: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = None,
    lateness: str = LATENESS,
    apart: str = APART,
) -> StreamingQuery:
    """Append new lineage rows to ``path``, stored by the date of access.

    The state is kept by RocksDB; a checkpoint that began with another store keeps that one.
    """
    rows = lineage_stream(query_stream, access_stream, lateness, apart)
    dated = rows.withColumn("access_date", F.to_date("access_time"))
    writer = dated.writeStream.format("parquet").outputMode("append").option("path", path).partitionBy("access_date")
    with settings(query_stream.sparkSession, STATE):
        return scheduled(writer, checkpoint, interval).start()


def read_lineage(spark: SparkSession, path: str, as_of: datetime) -> DataFrame:
    """The stored lineage of the days that the relation looks back from ``as_of``; older dates are not read."""
    first, last = days_before(as_of, HISTORY_DAYS), instant(as_of)
    rows = spark.read.parquet(path).where(F.col("access_date").between(first.cast("date"), last.cast("date")))
    return rows.where(F.col("access_time").between(first, last)).drop("access_date")
