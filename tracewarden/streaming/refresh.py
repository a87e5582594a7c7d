"""Keeps flattened events and the search corpora up to date with what arrives.

The transformations are the batch ones; Structured Streaming adds which files
are new. Each micro-batch is appended to the sink exactly once, by the checkpoint
and the file sink's log.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tracewarden import schemas
from tracewarden.operators.agent_events import agent_events_flattened
from tracewarden.operators.search import TERM_BUCKETS, conversation_corpus, notes_corpus, policy_corpus
from tracewarden.operators.search_index import index_documents


# How long an event that was stored is remembered, in event time.
REPEATS_WITHIN = "7 days"
# Events hold their texts several times (record, spans, input and output), which zstd packs better than snappy.
CODEC = "zstd"
# Rows of a file that one bitmap stands for, the size of Spark's bitmaps (4 KB).
BITMAP_ROWS = 32_768


def scheduled(writer: DataStreamWriter, checkpoint: str, interval: str | None) -> DataStreamWriter:
    """Without an interval: take in everything that has arrived, then stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def _append(
    rows: DataFrame, path: str, checkpoint: str, interval: str | None, partitions: tuple[str, ...] = ()
) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").outputMode("append").option("compression", CODEC)
    if partitions:
        writer = writer.partitionBy(*partitions)
    return scheduled(writer, checkpoint, interval).start(path)


def without_redelivered(events: DataFrame, within: str = REPEATS_WITHIN) -> DataFrame:
    """A stream of flattened events in which each one appears once, however often its producer sent it.

    Events are the same if trace, time and record are. Spark remembers each until the
    watermark, ``within`` behind the newest event, has passed it; what arrives later than that is left out
    (counted by :func:`late_rows`), so a repetition is not stored twice at any distance. Events without
    a time are not remembered beyond their batch.
    """
    return _once(_marked(events), within).drop("_at", "_content")


def _marked(events: DataFrame) -> DataFrame:
    return events.withColumns({"_at": F.col("event_timestamp").cast("timestamp"), "_content": F.xxhash64("raw_record")})


def _once(marked: DataFrame, within: str) -> DataFrame:
    return marked.withWatermark("_at", within).dropDuplicatesWithinWatermark(["trace_id", "event_timestamp", "_content"])


def _is_plain_parquet(stream: DataFrame) -> bool:
    """Whether a stream is raw events as Parquet files hold them, so that a row can be read again by file and place."""
    plan = stream._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "StreamingRelation" or stream.schema != schemas.RAW_EVENTS:
        return False
    source = plan.dataSource()
    options = source.options().keySet().mkString(" ").lower().split()
    return source.className().lower() == "parquet" and {*options} <= {"path", "maxfilespertrigger"}


def _places_once(raw_stream: DataFrame, within: str) -> DataFrame:
    """What :func:`without_redelivered` keeps, as file and row of each event in place of the event."""
    placed = raw_stream.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    events = _marked(agent_events_flattened(placed, "_file", "_row"))
    return _once(events.select("trace_id", "event_timestamp", "_content", "_at", "_file", "_row"), within).select("_file", "_row")


def _bitmaps(places: DataFrame) -> DataFrame:
    """(_file, _block, members): the rows of a file that are in ``places``, as bitmaps."""
    return places.groupBy("_file", F.expr(f"_row div {BITMAP_ROWS}").alias("_block")).agg(
        F.bitmap_construct_agg(F.col("_row") % BITMAP_ROWS).alias("members")
    )


def _events_at(spark: SparkSession, bitmaps: DataFrame) -> DataFrame:
    """The raw events of the rows that bitmaps name, in the order of their files.

    The bitmaps are broadcast: 4 KB for 32,768 rows, whose events stay where they are read.
    """
    names = sorted(row[0] for row in bitmaps.select("_file").distinct().collect())
    if not names:
        return spark.createDataFrame([], schemas.RAW_EVENTS)
    jvm = spark._jvm

    def path(name: str) -> str:
        return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)).toString()

    paths = [path(name) for name in names]
    # Names of found files are no patterns.
    files = spark.read.schema(schemas.RAW_EVENTS).option("__globPaths__", "false").parquet(*paths)
    if {*map(path, files.inputFiles())} != {*paths}:
        raise ValueError("the files of a batch are not found again by their names")
    placed = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    byte = F.expr(f"cast(conv(hex(substring(members, cast(_row % {BITMAP_ROWS} div 8 + 1 AS int), 1)), 16, 10) AS int)")
    found = placed.withColumn("_block", F.expr(f"_row div {BITMAP_ROWS}")).join(F.broadcast(bitmaps), ["_file", "_block"])
    return found.where(F.getbit(byte, F.expr("cast(_row % 8 AS int)")) == 1).select(*schemas.RAW_EVENTS.names)


def _add_to_sink(events: DataFrame, batch_id: int, path: str) -> None:
    """Append a batch through Spark's file sink, whose log at ``path`` leaves out a batch that it has."""
    jvm = events.sparkSession._jvm
    sink = jvm.org.apache.spark.sql.execution.streaming.sinks.FileStreamSink(
        events._jdf.sparkSession(),
        path,
        jvm.org.apache.spark.sql.execution.datasources.parquet.ParquetFileFormat(),
        jvm.PythonUtils.toSeq(["event_date"]),
        jvm.PythonUtils.toScalaMap({"path": path, "compression": CODEC}),
    )
    sink.addBatch(batch_id, events._jdf)


def _store_once(raw_stream: DataFrame, path: str, checkpoint: str, interval: str | None, within: str) -> StreamingQuery:
    """Store each event once without moving events: only keys and places travel, and a batch's files are read again."""

    def store(places: DataFrame, batch_id: int) -> None:
        spark, folder = places.sparkSession, f"{checkpoint}/places"
        _bitmaps(places).write.mode("overwrite").parquet(folder)
        bitmaps = spark.read.schema("_file string, _block bigint, members binary").parquet(folder)
        _add_to_sink(agent_events_flattened(_events_at(spark, bitmaps)), batch_id, path)

    return scheduled(_places_once(raw_stream, within).writeStream.foreachBatch(store), checkpoint, interval).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query left out because they came after the watermark, in the batches it still reports."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in map(_as_dict, query.recentProgress)
        for operator in progress["stateOperators"]
    )


def _as_dict(progress) -> dict:
    return progress if isinstance(progress, dict) else json.loads(progress.json)


def _arrived(raw_stream: DataFrame, repeats_within: str | None) -> DataFrame:
    events = agent_events_flattened(raw_stream)
    return events if repeats_within is None else without_redelivered(events, repeats_within)


def refresh_agent_events(
    raw_stream: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = None,
    repeats_within: str | None = REPEATS_WITHIN,
) -> StreamingQuery:
    """Append new telemetry to the flattened events, stored by date.

    Redelivered events are stored once; ``repeats_within=None`` stores all that comes, without state.
    """
    if repeats_within is not None and _is_plain_parquet(raw_stream):
        return _store_once(raw_stream, path, checkpoint, interval, repeats_within)
    return _append(_arrived(raw_stream, repeats_within), path, checkpoint, interval, ("event_date",))


def refresh_conversation_corpus(
    raw_stream: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = "1 hour",
    repeats_within: str | None = REPEATS_WITHIN,
) -> StreamingQuery:
    """Append new conversations to the search corpus, hourly by default, redelivered ones once."""
    return _append(conversation_corpus(_arrived(raw_stream, repeats_within)), path, checkpoint, interval)


def refresh_policy_corpus(
    policy_stream: DataFrame, path: str, checkpoint: str, interval: str | None = "1 day"
) -> StreamingQuery:
    """Append new policies to the search corpus, daily by default."""
    return _append(policy_corpus(policy_stream), path, checkpoint, interval)


def refresh_notes_corpus(
    note_stream: DataFrame, path: str, checkpoint: str, interval: str | None = "1 hour"
) -> StreamingQuery:
    """Append new audit notes to the search corpus, hourly by default."""
    return _append(notes_corpus(note_stream), path, checkpoint, interval)


def refresh_index(
    corpus_stream: DataFrame,
    text_column: str,
    path: str,
    checkpoint: str,
    interval: str | None = "1 hour",
    buckets: int = TERM_BUCKETS,
) -> StreamingQuery:
    """Add new and changed documents to a stored search index, a batch of it per micro-batch.

    A document that comes again replaces its earlier version; a batch that is done again changes nothing.
    """

    def add(documents: DataFrame, batch_id: int) -> None:
        index_documents(documents, text_column, path, buckets)

    return scheduled(corpus_stream.writeStream.foreachBatch(add), checkpoint, interval).start()
