from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tracewarden import schemas
from tracewarden.operators.agent_events import agent_events_flattened
from tracewarden.operators.search import conversation_corpus
from tracewarden.session import new_folder
from tracewarden.sources import sample_logs
from tracewarden.sources.logs import (
    read_agent_events,
    read_query_log,
    read_raw_events,
    stream_raw_events,
    write_agent_events,
    write_query_log,
)
from tracewarden.streaming import alerts, refresh

SF_DIR = "/root/testdata/sf0.001"


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    a, b = left.select(columns), right.select(columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_corpus_refresh_takes_in_only_new_files(spark):
    folder = new_folder(spark, "stream")
    raw = sample_logs.raw_events(spark, SF_DIR)
    early, late = raw.where("timestamp < '2024-01-15'"), raw.where("timestamp >= '2024-01-15'")

    def run():
        source = stream_raw_events(spark, f"{folder}/raw")
        refresh.refresh_conversation_corpus(
            source, f"{folder}/corpus", f"{folder}/checkpoint", interval=None
        ).awaitTermination()

    early.write.parquet(f"{folder}/raw")
    run()
    first = spark.read.parquet(f"{folder}/corpus").count()
    run()  # nothing new
    assert spark.read.parquet(f"{folder}/corpus").count() == first
    late.write.mode("append").parquet(f"{folder}/raw")
    run()
    same(spark.read.parquet(f"{folder}/corpus"), conversation_corpus(agent_events_flattened(raw)))


def test_streamed_events_equal_batch_events(spark):
    folder = new_folder(spark, "stream")
    raw = sample_logs.raw_events(spark, SF_DIR)
    raw.write.parquet(f"{folder}/raw")
    refresh.refresh_agent_events(
        stream_raw_events(spark, f"{folder}/raw"), f"{folder}/events", f"{folder}/checkpoint"
    ).awaitTermination()
    same(read_agent_events(spark, f"{folder}/events"), agent_events_flattened(raw))


def test_stored_events_prune_by_date(spark):
    folder = new_folder(spark, "events")
    events = agent_events_flattened(sample_logs.raw_events(spark, SF_DIR))
    write_agent_events(events, folder, mixed_dates=True)
    files = {}
    for path in read_agent_events(spark, folder).inputFiles():
        files.setdefault(path.split("/")[-2], []).append(path)
    assert len(files) == 30 and all(len(paths) == 1 for paths in files.values())
    write_agent_events(events.where("event_date = '2024-01-05'"), folder)  # replaces that day only
    stored = read_agent_events(spark, folder)
    same(stored, events)
    plan = stored.where("event_date >= '2024-01-25'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_logs_as_json_lines(spark, tmp_path):
    (tmp_path / "events.json").write_text(
        '{"timestamp": "2024-01-30T10:00:00", "record": {"agent_type": "CORTEX AGENT", "name": "N", "spans": []}}\n'
        '{"timestamp": "2024-01-30T11:00:00", "record": null}\n'
    )
    raw = read_raw_events(spark, str(tmp_path), "json")
    (row,) = agent_events_flattened(raw).collect()
    assert (row.event_type, row.span_count, row.event_hour) == ("N", 0, 10)
    with pytest.raises(ValueError, match="unknown log format"):
        read_raw_events(spark, str(tmp_path), "xml")


def test_stored_query_log_prunes_by_date(spark):
    folder = new_folder(spark, "queries")
    log = sample_logs.query_log(spark, SF_DIR)
    write_query_log(log, folder)
    same(read_query_log(spark, folder), log)
    recent = read_query_log(spark, folder, since=datetime(2024, 1, 25).date())
    same(recent, log.where("start_time >= '2024-01-25'"))
    assert "PartitionFilters: [isnotnull(start_date" in recent._jdf.queryExecution().toString()


def results(spark, *rows):
    at = datetime(2024, 1, 30)
    full = [
        ("t", "u", "A", "q", "r", None, at.date(), at, f"TR{n}", None, None, f'{{"score": {score}}}', None, when)
        for n, (score, when) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.EVALUATION_RESULTS)


def test_alert_windows_grow_and_late_results_count(spark):
    folder = new_folder(spark, "alerts")
    ten = datetime(2024, 1, 30, 10)
    told = []

    def run(*rows):
        results(spark, *rows).write.mode("append").parquet(f"{folder}/results")
        source = spark.readStream.schema(schemas.EVALUATION_RESULTS).parquet(f"{folder}/results")
        alerts.watch_critical(
            source,
            f"{folder}/alerts",
            f"{folder}/checkpoint",
            notify=lambda changed: told.extend(r.critical_count for r in changed.collect()),
            interval=None,
        ).awaitTermination()
        return {r.window_start: r.critical_count for r in alerts.recorded_alerts(spark, f"{folder}/alerts").collect()}

    assert run((0.1, ten), (0.9, ten), (0.2, ten + timedelta(minutes=59))) == {ten: 2}
    assert run((0.3, ten + timedelta(minutes=30))) == {ten: 3}
    noon = ten + timedelta(hours=5)
    assert run((0.3, noon)) == {ten: 3, noon: 1}
    # Hours past the newest result, and still counted.
    assert run((0.3, ten)) == {ten: 4, noon: 1}
    assert told == [2, 1, 1, 1]


def test_streamed_files_are_packed_by_zstd(spark):
    folder = new_folder(spark, "packed")
    sample_logs.raw_events(spark, "/root/testdata/sf0.001").write.parquet(f"{folder}/raw")
    stream = stream_raw_events(spark, f"{folder}/raw")
    refresh.refresh_agent_events(stream, f"{folder}/events", f"{folder}/checkpoint").awaitTermination()
    files = spark.read.parquet(f"{folder}/events").inputFiles()
    assert files and all(".zstd." in name for name in files)
