"""Streams that keep state: redelivered events, lineage out of two logs, alerts that fire once."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from tracewarden import schemas
from tracewarden.operators.agent_events import agent_events_flattened
from tracewarden.operators.evaluation import evaluation_parsed
from tracewarden.operators.lineage import data_access_lineage
from tracewarden.plans.quality import critical_alert
from tracewarden.session import new_folder
from tracewarden.sources.logs import read_agent_events, stream_raw_events
from tracewarden.streaming import alerts, lineage, refresh

DAY = datetime(2024, 1, 10)


def event(at, trace_id, user="U", name="CORTEX_AGENT_RESPONSE"):
    record = {"agent_type": "CORTEX AGENT", "name": name, "trace_id": trace_id, "user_name": user}
    return at, json.dumps(record)


class Events:
    def __init__(self, spark, within="2 days"):
        self.spark, self.folder, self.within = spark, new_folder(spark, "events"), within

    def deliver(self, *rows):
        """Stores what arrives, runs the stream once from its checkpoint and returns the rows it left out."""
        self.spark.createDataFrame(list(rows), schemas.RAW_EVENTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/raw")
        source = stream_raw_events(self.spark, f"{self.folder}/raw")
        query = refresh.refresh_agent_events(source, f"{self.folder}/events", f"{self.folder}/checkpoint", repeats_within=self.within)
        query.awaitTermination()
        return refresh.late_rows(query) if self.within else 0

    def stored(self):
        return sorted((r.trace_id or "", r.user_name) for r in read_agent_events(self.spark, f"{self.folder}/events").collect())


def test_redelivered_events_are_stored_once_over_restarts(spark):
    events = Events(spark)
    a, b, c = event(DAY, "a"), event(DAY + timedelta(hours=1), "b"), event(DAY + timedelta(hours=2), "c")
    assert events.deliver(a, b, a, b, b) == 0
    assert events.deliver(b, c, a) == 0
    assert events.stored() == [("a", "U"), ("b", "U"), ("c", "U")]


def test_different_events_of_a_trace_stay(spark):
    events = Events(spark)
    one, other = event(DAY, "t", user="V"), event(DAY, "t", user="W")
    none, later = event(DAY, None, user="X"), event(DAY + timedelta(seconds=1), None, user="X")
    events.deliver(one, other, none, later, one, none)
    events.deliver(other, later, none)
    assert events.stored() == [("", "X"), ("", "X"), ("t", "V"), ("t", "W")]


def test_events_behind_the_watermark_are_left_out_and_counted(spark):
    events = Events(spark, within="1 hour")
    old = event(DAY, "old")
    events.deliver(old, event(DAY + timedelta(hours=5), "new"))
    assert events.deliver(old, event(DAY + timedelta(hours=1), "late"), event(DAY + timedelta(hours=6), "newer")) == 2
    assert events.stored() == [("new", "U"), ("newer", "U"), ("old", "U")]


def test_without_a_bound_everything_is_stored(spark):
    events = Events(spark, within=None)
    a = event(DAY, "a")
    events.deliver(a, a)
    events.deliver(a)
    assert events.stored() == [("a", "U")] * 3


def test_events_are_stored_from_where_they_lie(spark, monkeypatch):
    """The state sees keys and places; blocks of 16 rows make several bitmaps a file, and names may need escapes."""
    monkeypatch.setattr(refresh, "BITMAP_ROWS", 16)
    events = Events(spark)
    events.folder += "/a b%20"
    rows = [event(DAY + timedelta(hours=n), f"t{n}", user=f"U{n}") for n in range(50)]
    events.deliver(*rows[:40], *rows[10:30])
    source = stream_raw_events(spark, f"{events.folder}/raw")
    assert refresh._places_once(source, "2 days").columns == ["_file", "_row"]
    events.deliver(*rows[20:], event(DAY + timedelta(hours=49), None, user=None), (DAY, "no JSON"))
    batch = agent_events_flattened(spark.createDataFrame([*rows, event(DAY + timedelta(hours=49), None, user=None)], schemas.RAW_EVENTS))
    stored = read_agent_events(spark, f"{events.folder}/events").select(batch.columns)
    assert stored.exceptAll(batch).count() == batch.exceptAll(stored).count() == 0 and stored.count() == 51
    assert spark.read.parquet(f"{events.folder}/checkpoint/places").columns == ["_file", "_block", "members"]


def test_streams_that_are_not_plain_files_are_stored_once_too(spark):
    events = Events(spark)
    rows = [event(DAY, "a"), event(DAY, "b"), event(DAY, "a")]
    spark.createDataFrame(rows, schemas.RAW_EVENTS).coalesce(1).write.parquet(f"{events.folder}/raw")
    plain = stream_raw_events(spark, f"{events.folder}/raw")
    other = plain.where("record IS NOT NULL")
    assert refresh._is_plain_parquet(plain) and not refresh._is_plain_parquet(other)
    assert not refresh._is_plain_parquet(stream_raw_events(spark, f"{events.folder}/raw", "json"))
    refresh.refresh_agent_events(other, f"{events.folder}/events", f"{events.folder}/checkpoint").awaitTermination()
    assert events.stored() == [("a", "U"), ("b", "U")]


def test_a_batch_that_is_stored_again_changes_nothing(spark):
    path = new_folder(spark, "sink")
    events = agent_events_flattened(spark.createDataFrame([event(DAY, "a"), event(DAY, "b")], schemas.RAW_EVENTS))
    for batch_id in (0, 0, 1, 1):
        refresh._add_to_sink(events, batch_id, path)
    assert read_agent_events(spark, path).count() == 4


def query_row(n, at, status="SUCCESS"):
    return (f"Q{n}", "u", "r", "w", "SELECT 1", "SELECT", status, None, None, n, n, n, at, at)


def access_row(n, at, sources=("T", "S"), targets=("V", "W")):
    def objects(names):
        return None if names is None else [(x, "TABLE", [("ID",)]) for x in names]

    return f"Q{n}", objects(sources), objects(targets), at


class Logs:
    def __init__(self, spark, lateness="2 hours"):
        self.spark, self.folder, self.lateness = spark, new_folder(spark, "lineage"), lateness

    def deliver(self, queries=(), accesses=()):
        for rows, schema, name in ((queries, schemas.QUERY_LOG, "queries"), (accesses, schemas.ACCESS_STREAM, "accesses")):
            self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")
        arriving = [
            self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}")
            for schema, name in ((schemas.QUERY_LOG, "queries"), (schemas.ACCESS_STREAM, "accesses"))
        ]
        query = lineage.refresh_lineage(*arriving, f"{self.folder}/rows", f"{self.folder}/checkpoint", lateness=self.lateness)
        query.awaitTermination()
        return query

    def stored(self, as_of=DAY + timedelta(days=5)):
        return sorted(map(repr, lineage.read_lineage(self.spark, f"{self.folder}/rows", as_of).collect()))

    def batch(self, as_of=DAY + timedelta(days=5)):
        queries, accesses = (self.spark.read.schema(s).parquet(f"{self.folder}/{n}") for s, n in ((schemas.QUERY_LOG, "queries"), (schemas.ACCESS_STREAM, "accesses")))
        return sorted(map(repr, data_access_lineage(queries, accesses, as_of).collect()))


@pytest.mark.parametrize("order", ["queries first", "accesses first", "mixed"])
def test_lineage_does_not_depend_on_which_log_comes_first(spark, order):
    at = [DAY + timedelta(minutes=10 * n) for n in range(8)]
    queries = [query_row(n, at[n], "FAIL" if n == 3 else "SUCCESS") for n in range(8)]
    accesses = [access_row(n, at[n] + timedelta(minutes=n), targets=(None, (), ("V",), ("V", "W"))[n % 4], sources=None if n == 5 else ("T", "S")) for n in range(8)]
    logs = Logs(spark)
    if order == "queries first":
        logs.deliver(queries=queries)
        logs.deliver(accesses=accesses)
    elif order == "accesses first":
        logs.deliver(accesses=accesses)
        logs.deliver(queries=queries)
    else:
        logs.deliver(queries[::2], accesses[1::2])
        logs.deliver(queries[1::2], accesses[::2])
    assert logs.stored() == logs.batch() and len(logs.stored()) > 7


def test_unmatched_rows_are_evicted_and_late_ones_counted(spark):
    logs = Logs(spark, lateness="1 hour")
    logs.deliver([query_row(1, DAY)], [access_row(9, DAY), access_row(8, None)])
    far = DAY + timedelta(hours=12)
    query = logs.deliver([query_row(2, far)], [access_row(2, far)])
    rows_kept = [op["numRowsTotal"] for p in map(refresh._as_dict, query.recentProgress) for op in p["stateOperators"]]
    assert rows_kept[0] >= 2 and rows_kept[-1] == 2  # only the new pair is left
    query = logs.deliver([query_row(3, far), query_row(7, DAY)], [access_row(1, DAY), access_row(3, far)])
    assert refresh.late_rows(query) == 2
    assert {r.split("query_id='")[1][:2] for r in logs.stored()} == {"Q2", "Q3"}


def state_files(spark, checkpoint):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state")
    found, names = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), set()
    while found.hasNext():
        names.add(found.next().getPath().getName().rpartition(".")[2])
    return names


def test_lineage_state_is_kept_by_rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    logs = Logs(spark)
    logs.deliver([query_row(1, DAY)], [access_row(2, DAY)])
    assert "zip" in state_files(spark, f"{logs.folder}/checkpoint") and "delta" not in state_files(spark, f"{logs.folder}/checkpoint")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    logs.deliver([query_row(2, DAY)], [access_row(1, DAY)])
    assert logs.stored() == logs.batch() and len(logs.stored()) == 8


def test_lineage_goes_on_from_a_checkpoint_of_another_store(spark, monkeypatch):
    logs = Logs(spark)
    with monkeypatch.context() as began:
        began.setattr(lineage, "STATE", {})
        logs.deliver([query_row(1, DAY)], [access_row(2, DAY)])
    logs.deliver([query_row(2, DAY)], [access_row(1, DAY)])
    assert "zip" not in state_files(spark, f"{logs.folder}/checkpoint")
    assert logs.stored() == logs.batch() and len(logs.stored()) == 8


def test_both_deliveries_of_lineage_come_from_one_access_log(spark, monkeypatch):
    from tracewarden import catalog
    from tracewarden.sources import sample_logs

    folder, made, seen = "/root/testdata/sf0.001", sample_logs.access_log, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(sample_logs, "access_log", lambda *given: (rows := made(*given)).mapInArrow(counted, rows.schema))
    catalog.QUERIES["lineage_refresh"](spark, folder)
    assert seen.value == made(spark, folder).count()


def result(n, at, score=0.1):
    verdict = f'{{"score": {score}}}'
    return ("t", "u", "A", "q", "r", None, at.date(), at, f"TR{n}", None, None, verdict, None, at)


class Results:
    def __init__(self, spark):
        self.spark, self.folder = spark, new_folder(spark, "alerts")

    def deliver(self, *rows):
        frame = self.spark.createDataFrame(list(rows), schemas.EVALUATION_RESULTS)
        frame.coalesce(1).write.mode("append").parquet(f"{self.folder}/results")
        source = self.spark.readStream.schema(schemas.EVALUATION_RESULTS).parquet(f"{self.folder}/results")
        alerts.alert_once(source, f"{self.folder}/alerts", f"{self.folder}/checkpoint", interval=None).awaitTermination()
        return sorted((r.trace_id, r.evaluated_at) for r in self.alerts().collect())

    def alerts(self):
        return self.spark.read.parquet(f"{self.folder}/alerts")


def test_a_response_is_alerted_once_and_anew_after_the_look_back(spark):
    results = Results(spark)
    nine = DAY + timedelta(hours=9)
    quarter = timedelta(minutes=15)
    assert results.deliver(result(1, nine), result(1, nine + quarter), result(2, nine), result(3, nine, 0.9)) == [("TR1", nine), ("TR2", nine)]
    # The same responses judged again within the look-back, after a restart; a new one is told.
    known = [("TR1", nine), ("TR2", nine), ("TR4", nine + 2 * quarter)]
    assert results.deliver(result(1, nine + 2 * quarter), result(2, nine), result(4, nine + 2 * quarter)) == known
    evening = nine + timedelta(hours=9)
    results.deliver(result(5, evening))  # moves the watermark on, so that the first alerts expire
    again = evening + quarter
    assert results.deliver(result(1, again), result(2, nine)) == sorted([*known, ("TR5", evening), ("TR1", again)])
    # Each interval's check equals the batch query over the look-back.
    parsed = evaluation_parsed(spark.read.schema(schemas.EVALUATION_RESULTS).parquet(f"{results.folder}/results"))
    for hours in range(-1, 12):
        at = nine + timedelta(hours=hours)
        assert alerts.fired(results.alerts(), at) == critical_alert(parsed, at).head().fired


def test_results_without_key_or_time_raise_no_alert(spark):
    row = list(result(1, DAY))
    no_key, no_time = [*row], [*row]
    no_key[8], no_time[13] = None, None
    assert Results(spark).deliver(tuple(no_key), tuple(no_time), tuple(row)) == [("TR1", DAY)]


def test_flattening_with_deduplication_is_the_batch_relation(spark):
    rows = [event(DAY + timedelta(minutes=n), f"t{n}") for n in range(20)]
    events = Events(spark)
    events.deliver(*rows[:12], *rows[:4])
    events.deliver(*rows[8:])
    batch = agent_events_flattened(spark.createDataFrame(rows, schemas.RAW_EVENTS))
    stored = read_agent_events(spark, f"{events.folder}/events").select(batch.columns)
    assert stored.exceptAll(batch).count() == batch.exceptAll(stored).count() == 0 and stored.count() == 20
