"""Alerts on critical evaluation results as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracewarden import fixed_values as V
from tracewarden.operators.evaluation import evaluation_parsed
from tracewarden.streaming.refresh import scheduled

WINDOW = "1 hour"


def critical_windows(results: DataFrame) -> DataFrame:
    """Critical results per hour of evaluation."""
    critical = (
        evaluation_parsed(results)
        .where(F.col("evaluation_status") == V.STATUS_CRITICAL)
        .select(F.col("evaluated_at").cast("timestamp").alias("evaluated_at"))
    )
    return (
        critical.groupBy(F.window("evaluated_at", WINDOW).alias("hour"))
        .agg(F.count(F.lit(1)).alias("critical_count"))
        .select(
            F.col("hour.start").cast("timestamp_ntz").alias("window_start"),
            F.col("hour.end").cast("timestamp_ntz").alias("window_end"),
            "critical_count",
        )
    )


def watch_critical(
    result_stream: DataFrame,
    path: str,
    checkpoint: str,
    notify: Callable[[DataFrame], None] | None = None,
    interval: str | None = "60 minutes",
) -> StreamingQuery:
    """Record each micro-batch's critical results per hour, however late they come.

    Counts add up, so a batch needs no state: it writes its own counts to its own
    folder, and a repeated one overwrites that. ``notify`` gets the hours
    of the batch with the batch's counts (to send mail, say).
    """

    def record(arrived: DataFrame, batch_id: int) -> None:
        folder = f"{path}/batch_id={batch_id}"
        hours = critical_windows(arrived)
        hours.write.mode("overwrite").parquet(folder)
        if notify is not None:
            notify(arrived.sparkSession.read.schema(hours.schema).parquet(folder))

    return scheduled(result_stream.writeStream.foreachBatch(record), checkpoint, interval).start()


def recorded_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Critical results per hour over all recorded batches."""
    schema = "window_start timestamp_ntz, window_end timestamp_ntz, critical_count bigint, batch_id bigint"
    return (
        spark.read.schema(schema)
        .parquet(path)
        .groupBy("window_start", "window_end")
        .agg(F.sum("critical_count").alias("critical_count"))
    )


ALERTS = "trace_id string, agent_name string, evaluated_at timestamp, safety_score double"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertedResponses(StatefulProcessor):
    """Passes a response's first critical result on and holds back others until ``look_back`` has passed."""

    def __init__(self, look_back: timedelta):
        self.look_back = look_back

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alerted = handle.getValueState("alerted", "evaluated_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        first = arrived.sort_values(["evaluated_at", "safety_score"]).head(1)
        if self.alerted.exists():
            return
        at = first["evaluated_at"].iloc[0].to_pydatetime()
        self.alerted.update((at,))
        expiry = at.replace(tzinfo=timezone.utc) + self.look_back
        self.handle.registerTimer(int(expiry.timestamp() * 1000))
        yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alerted.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def critical_alerts(result_stream: DataFrame, look_back: timedelta = timedelta(hours=1), lateness: str = "1 hour") -> DataFrame:
    """One alert per response (``trace_id``) within the look-back, from a stream of evaluation results.

    A response that was alerted is remembered, over restarts, until the watermark
    (``lateness`` behind the newest result) is a look-back past its result; then it may be alerted
    anew. Results that come after the watermark are left out. Results without a key or a time raise no alert.
    """
    critical = (
        evaluation_parsed(result_stream)
        .where((F.col("evaluation_status") == V.STATUS_CRITICAL) & F.col("trace_id").isNotNull() & F.col("evaluated_at").isNotNull())
        .select("trace_id", "agent_name", F.col("evaluated_at").cast("timestamp").alias("evaluated_at"), "safety_score")
        .withWatermark("evaluated_at", lateness)
    )
    return critical.groupBy("trace_id").transformWithStateInPandas(
        AlertedResponses(look_back), outputStructType=ALERTS, outputMode="Append", timeMode="eventTime"
    )


def alert_once(
    result_stream: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = "60 minutes",
    look_back: timedelta = timedelta(hours=1),
    lateness: str = "1 hour",
) -> StreamingQuery:
    """Append each new alert to ``path``. The state is kept by RocksDB, which timers need."""
    spark = result_stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)  # a query keeps the settings that it starts with
    try:
        writer = critical_alerts(result_stream, look_back, lateness).writeStream.format("parquet").outputMode("append")
        return scheduled(writer.option("path", path), checkpoint, interval).start()
    finally:
        spark.conf.set(STATE_STORE, before)


def fired(alerts: DataFrame, at: datetime, look_back: timedelta = timedelta(hours=1)) -> bool:
    """Whether stored alerts hold one of the look-back before ``at``, as the check at an interval asks."""
    return not alerts.where(F.col("evaluated_at").between(F.lit(at - look_back), F.lit(at))).isEmpty()
