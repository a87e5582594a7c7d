"""Every relation, report and job as a named query over the given test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden import schemas
from tracewarden.functions.columns import computed_once
from tracewarden.operators import agent_events as E
from tracewarden.operators import daily
from tracewarden.operators import evaluation as EV
from tracewarden.operators import judges as J
from tracewarden.operators import lineage as LN
from tracewarden.operators import open_records, pattern_table, stored_sample, verdict_store
from tracewarden.operators import query_log as Q
from tracewarden.operators import search as SR
from tracewarden.operators import search_index as SX
from tracewarden.plans import access, activity, behaviour, jobs, quality, security, sql_views, stored_days
from tracewarden.plans import metric_model as M
from tracewarden.session import new_folder
from tracewarden.sources import sample_logs
from tracewarden.sources.logs import read_agent_events, read_user_activity, stream_raw_events, write_agent_events, write_user_activity
from tracewarden.streaming import alerts, refresh
from tracewarden.streaming import lineage as lineage_refresh

AS_OF = datetime(2024, 1, 31)
WEEK = timedelta(days=7)
AGENT, SERVICE_USER, THREAD = "CLAIMS_AGENT", "SVC_3", "T8_20240102"
TABLE_PATTERN = "%CLAIMS%"
CONVERSATION_QUERY, NOTES_QUERY = "the with", "the of and"

Query = Callable[[SparkSession, str], DataFrame]


def joined(rows: DataFrame, *names: str, separator: str = "|") -> DataFrame:
    """List columns as text, so that results compare across engines."""
    return rows.withColumns({name: F.array_join(name, separator) for name in names})


# --- Base relations ----------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.agent_events_flattened(sample_logs.raw_events(spark, sf_dir))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.agent_query_history(sample_logs.query_log(spark, sf_dir), AS_OF)


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.failed_queries_analysis(sample_logs.query_log(spark, sf_dir), AS_OF)


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.user_activity_summary(sample_logs.query_log(spark, sf_dir), AS_OF)


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LN.source_accesses(
        sample_logs.query_log(spark, sf_dir), sample_logs.access_log(spark, sf_dir), AS_OF
    )


def _accesses_with_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LN.source_accesses(
        sample_logs.query_log(spark, sf_dir), sample_logs.access_log(spark, sf_dir), AS_OF, with_columns=True
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.eval_conversations(_events(spark, sf_dir))


def _recorded(spark: SparkSession, sf_dir: str, bounded: bool = True) -> J.Scorer:
    return J.recorded_scorer(sample_logs.recorded_verdicts(spark, sf_dir), bounded=bounded)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = EV.evaluation_dataset(_judged(spark, sf_dir), AS_OF)
    return EV.evaluation_results(dataset, _recorded(spark, sf_dir), AS_OF)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.evaluation_parsed(_results(spark, sf_dir))


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_logs.policies(spark, sf_dir, AS_OF)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_logs.notes(spark, sf_dir, AS_OF)


def in_64_bits(query: Query) -> Query:
    """Whole-number sums are DECIMAL(38, 0); the test tables' fit 64 bits, the type that checks compare."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = query(spark, sf_dir)
        wide = [f.name for f in rows.schema.fields if f.dataType == T.DecimalType(38, 0)]
        return rows.withColumns({name: F.col(name).cast("bigint") for name in wide})

    return run


def over(base: Query, operator: Callable[..., DataFrame], *args: object, **kwargs: object) -> Query:
    """Query that applies an operator to a base relation."""
    return lambda spark, sf_dir: operator(base(spark, sf_dir), *args, **kwargs)


# --- Queries that need more than one operator ----------------------------------


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineage = LN.data_access_lineage(
        sample_logs.query_log(spark, sf_dir), sample_logs.access_log(spark, sf_dir), AS_OF
    )
    return joined(lineage.withColumn("columns_accessed", F.col("columns_accessed.columnName")), "columns_accessed")


def _lineage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineage = LN.data_access_lineage(
        sample_logs.query_log(spark, sf_dir), sample_logs.access_log(spark, sf_dir), AS_OF, dedup=True
    )
    return joined(lineage.withColumn("columns_accessed", F.col("columns_accessed.columnName")), "columns_accessed")


def _failures_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(security.failures_by_category(_failures(spark, sf_dir), AS_OF), "error_codes")


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _activity(spark, sf_dir)
    path = new_folder(spark, "activity-export")
    behaviour.export_activity(rows, AS_OF, path)
    return spark.read.schema(rows.schema).options(**behaviour.EXPORT_OPTIONS).csv(path)


def _judge(judge: str) -> Query:
    """Rule verdicts on all responses, taken apart."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = J.rule_scorer(_judged(spark, sf_dir)).select("trace_id", J.raw_column(judge))
        verdict = F.try_parse_json(J.raw_column(judge)).alias("v")
        columns = [
            "trace_id",
            F.try_variant_get("v", "$.score", "double").alias("score"),
            F.try_variant_get("v", "$.reasoning", "string").alias("reasoning"),
        ]
        if judge in J.LISTS:
            found = F.try_variant_get("v", f"$.{J.LISTS[judge]}", "array<string>")
            columns.append(F.array_join(F.array_sort(found), "|").alias(J.LISTS[judge]))
        return computed_once(raw, verdict).select(*columns)

    return run


def _sample_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly sample out of samples kept per day, into which responses came in two overlapping deliveries."""
    folder = new_folder(spark, "samples")
    rows = _judged(spark, sf_dir)
    odd = F.pmod(F.crc32("trace_id"), F.lit(3))
    for delivery in (odd < 2, odd > 0):
        stored_sample.add_to_samples(rows.where(delivery), folder)
    return stored_sample.sample_of_days(spark, folder, AS_OF)


def _usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by agent and model, fields that the declared schema lacks, out of stored records."""
    folder = new_folder(spark, "open-events")
    raw = sample_logs.raw_events_with_usage(spark, sf_dir)
    write_agent_events(open_records.open_agent_events(raw), folder)
    rows = open_records.at_paths(
        read_agent_events(spark, folder),
        {"model": "$.usage.model", "tokens": ("$.usage.tokens", "bigint"), "second_span": "$.spans[1].name", "wrong": ("$.usage.model", "int")},
    )
    return rows.groupBy("agent_name", "model").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("tokens").alias("tokens"),
        F.count("second_span").alias("with_second_span"),
        F.count("wrong").alias("wrong_type"),
    )


def _watched_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses to tables by watch list, each of which has thousands of patterns."""
    patterns = sample_logs.watch_patterns(spark, sf_dir)
    accesses = _accesses(spark, sf_dir)
    found = pattern_table.matched_patterns(accesses, "source_table", patterns)
    listed = found.groupBy("source_table", "watch_list").agg(F.count(F.lit(1)).alias("patterns"))
    counts = accesses.groupBy("source_table").agg(LN.pair_count().alias("access_count"))
    return counts.join(listed, "source_table")


def _rule_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule scores of every candidate response, summarised per agent."""
    candidates = EV.evaluation_candidates(_judged(spark, sf_dir), AS_OF)
    return quality.evaluation_by_agent(
        EV.evaluation_parsed(EV.evaluation_results(candidates, J.rule_scorer, AS_OF))
    )


def prompt_lengths(prompts: list[str]) -> list[str]:
    """Stands in for a model: a verdict that follows from the prompt."""
    return [f'{{"score": {len(p) % 100 / 100}, "reasoning": "{len(p)}"}}' for p in prompts]


def _verdicts_bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores out of stored verdicts, of which a first run bought a third."""
    folder = new_folder(spark, "verdicts")
    rows = _judged(spark, sf_dir)
    scorer = verdict_store.stored_scorer(prompt_lengths, folder, partitions=4, chunk_rows=64)
    scorer(rows.where(F.pmod(F.crc32("trace_id"), F.lit(3)) == 0))
    parsed = EV.evaluation_parsed(EV.evaluation_results(rows, scorer, AS_OF))
    return parsed.select("trace_id", *[f"{judge}_score" for judge in J.JUDGES], "groundedness_reasoning")


def _parsed_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = joined(_parsed(spark, sf_dir), "groundedness_flags", "safety_issues", "missing_aspects")
    return flat.withColumn("composite_score", F.round("composite_score", 6))


def _critical_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(quality.critical_issues(_parsed(spark, sf_dir)), "safety_issues")


def _groundedness_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(quality.groundedness_issues(_parsed(spark, sf_dir)), "groundedness_flags")


def _weekly_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weekly runs, the second one repeated, as kept in the history."""
    path = new_folder(spark, "evaluation")
    conversations, scorer = _judged(spark, sf_dir), _recorded(spark, sf_dir)
    for as_of in (AS_OF - WEEK, AS_OF, AS_OF):
        jobs.run_evaluation(conversations, as_of, scorer, path)
    return jobs.evaluation_runs(spark, path)


def _all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response with its recorded verdict, evaluated the moment it was given."""
    return EV.evaluation_results(
        _judged(spark, sf_dir), _recorded(spark, sf_dir, bounded=False), F.col("event_timestamp")
    )


def _critical_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    alert_time = AS_OF - timedelta(hours=1)
    return quality.critical_alert(EV.evaluation_parsed(_all_results(spark, sf_dir)), alert_time, hours=24)


def _critical_alert_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hour, as the alert looks by itself."""
    alert_time = AS_OF - timedelta(hours=1)
    return quality.critical_alert(EV.evaluation_parsed(_all_results(spark, sf_dir)), alert_time)


def _critical_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "alerts")
    results = _all_results(spark, sf_dir)
    results.write.parquet(f"{folder}/results")
    arriving = spark.readStream.schema(results.schema).parquet(f"{folder}/results")
    alerts.watch_critical(
        arriving, f"{folder}/alerts", f"{folder}/checkpoint", interval=None
    ).awaitTermination()
    return alerts.recorded_alerts(spark, f"{folder}/alerts")


def _stream_of_events(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    sample_logs.raw_events(spark, sf_dir).write.parquet(f"{folder}/raw")
    return stream_raw_events(spark, f"{folder}/raw")


def _corpus_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "corpus")
    arriving = _stream_of_events(spark, sf_dir, folder)
    refresh.refresh_conversation_corpus(
        arriving, f"{folder}/corpus", f"{folder}/checkpoint", interval=None
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/corpus")


def _policy_corpus_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "policy-corpus")
    _policies(spark, sf_dir).write.parquet(f"{folder}/policies")
    arriving = spark.readStream.schema(schemas.POLICIES).parquet(f"{folder}/policies")
    refresh.refresh_policy_corpus(
        arriving, f"{folder}/corpus", f"{folder}/checkpoint", interval=None
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/corpus")


def _notes_corpus_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "notes-corpus")
    _notes(spark, sf_dir).write.parquet(f"{folder}/notes")
    arriving = spark.readStream.schema(schemas.NOTES).parquet(f"{folder}/notes")
    refresh.refresh_notes_corpus(
        arriving, f"{folder}/corpus", f"{folder}/checkpoint", interval=None
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/corpus")


def _agent_events_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily conversations out of events that a stream flattened and stored."""
    folder = new_folder(spark, "events")
    arriving = _stream_of_events(spark, sf_dir, folder)
    refresh.refresh_agent_events(
        arriving, f"{folder}/events", f"{folder}/checkpoint", interval=None
    ).awaitTermination()
    return activity.daily_conversations(read_agent_events(spark, f"{folder}/events"), AS_OF)


def _in_turn(first: list[tuple[DataFrame, str]], then: list[tuple[DataFrame, str]], run: Callable[[], None]) -> None:
    """Rows arrive in two deliveries, and the stream stops and starts between them."""
    for delivery in (first, then):
        for rows, path in delivery:
            rows.write.mode("append").parquet(path)
        run()


def _redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same when a third of the events comes twice at once and again after a restart."""
    folder = new_folder(spark, "events")
    raw = sample_logs.raw_events(spark, sf_dir)
    early, third = F.col("timestamp") < "2024-01-20", F.pmod(F.crc32("record"), F.lit(3)) == 0
    first, again = raw.where(early), raw.where(early & third)

    def run() -> None:
        arriving = stream_raw_events(spark, f"{folder}/raw")
        refresh.refresh_agent_events(arriving, f"{folder}/events", f"{folder}/checkpoint").awaitTermination()

    deliveries = [(first.union(again), f"{folder}/raw")], [(raw.where(~early).union(again), f"{folder}/raw")]
    _in_turn(*deliveries, run)
    return activity.daily_conversations(read_agent_events(spark, f"{folder}/events"), AS_OF)


def _lineage_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage out of two streams of which the accesses lag ten days behind and the joining one restarts."""
    folder = new_folder(spark, "lineage")
    queries = sample_logs.query_log(spark, sf_dir)
    # Gathered once for both deliveries, to which accesses without a time do not belong.
    timed = sample_logs.access_stream_log(spark, sf_dir).where("query_start_time IS NOT NULL")
    timed.write.parquet(f"{folder}/access-log")
    accesses = spark.read.schema(timed.schema).parquet(f"{folder}/access-log")
    began, logged = F.col("start_time") < "2024-01-20", F.col("query_start_time") < "2024-01-10"

    def run() -> None:
        arriving = [
            spark.readStream.schema(schema).parquet(f"{folder}/{name}")
            for schema, name in ((schemas.QUERY_LOG, "queries"), (schemas.ACCESS_STREAM, "accesses"))
        ]
        lineage_refresh.refresh_lineage(*arriving, f"{folder}/lineage", f"{folder}/checkpoint").awaitTermination()

    _in_turn(
        [(queries.where(began), f"{folder}/queries"), (accesses.where(logged), f"{folder}/accesses")],
        [(queries.where(~began), f"{folder}/queries"), (accesses.where(~logged), f"{folder}/accesses")],
        run,
    )
    rows = lineage_refresh.read_lineage(spark, f"{folder}/lineage", AS_OF)
    return joined(rows.withColumn("columns_accessed", F.col("columns_accessed.columnName")), "columns_accessed")


def _critical_alert_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per critical response, though a third of the results comes again after a restart."""
    folder = new_folder(spark, "alerts")
    results = _all_results(spark, sf_dir)
    early, third = F.col("evaluated_at") < "2024-01-20", F.pmod(F.crc32("trace_id"), F.lit(3)) == 0

    def run() -> None:
        arriving = spark.readStream.schema(results.schema).parquet(f"{folder}/results")
        alerts.alert_once(arriving, f"{folder}/alerts", f"{folder}/checkpoint", interval=None).awaitTermination()

    again = results.where(early & third)
    _in_turn([(results.where(early), f"{folder}/results")], [(results.where(~early).union(again), f"{folder}/results")], run)
    found = spark.read.parquet(f"{folder}/alerts")
    return found.select("trace_id", "agent_name", F.col("evaluated_at").cast("timestamp_ntz").alias("evaluated_at"), "safety_score")


_indexes: dict[tuple, str] = {}


def _versions(rows: DataFrame) -> tuple:
    """Name, size and time of each file that ``rows`` are read from."""
    spark, found = rows.sparkSession, []
    for name in rows.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def _kept(name: str, base: Query, build: Callable[[DataFrame, str], None]) -> Callable[[SparkSession, str], str]:
    """Folder of what ``build`` stores of a relation, at its first use of a session and again once its tables' files change."""

    def path(spark: SparkSession, sf_dir: str) -> str:
        rows = base(spark, sf_dir)
        key = (spark.sparkContext.applicationId, sf_dir, name, _versions(rows))
        if key not in _indexes:
            folder = f"{new_folder(spark, name)}/index"
            build(rows, folder)
            _indexes[key] = folder
        return _indexes[key]

    return path


def _index(name: str, corpus: Query, text_column: str) -> Callable[[SparkSession, str], str]:
    """The stored index of a corpus."""
    return _kept(name, corpus, lambda rows, folder: SX.index_documents(rows, text_column, folder, buckets=16))


def _store_days(events: DataFrame, folder: str) -> None:
    """Twenty days at first, then the last ten of them again and what came after."""
    daily.refresh_days(events.where("event_date < DATE '2024-01-20'"), folder)
    daily.refresh_days(events.where("event_date >= DATE '2024-01-10'"), folder)


_days = _kept("days", _events, _store_days)


def of_days(report: Callable[..., DataFrame], *args: object) -> Query:
    """A report out of stored days."""
    return lambda spark, sf_dir: report(daily.read_days(spark, _days(spark, sf_dir)), *args)


def _user_activity_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User activity out of stored days, of which a refresh replaced some."""
    folder = new_folder(spark, "activity")
    rows = _activity(spark, sf_dir)
    write_user_activity(rows.where("activity_date < DATE '2024-01-20'"), folder)
    write_user_activity(rows.where("activity_date >= DATE '2024-01-15'"), folder)
    return behaviour.user_activity(read_user_activity(spark, folder), AS_OF)


def _metrics_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily.read_days(spark, _days(spark, sf_dir))
    return M.metrics(_events(spark, sf_dir), M.AGENT_EVENTS, list(M.AGENT_EVENTS.measures), ["agent_name"], stored=days)


_policy_index = _index("policy-index", over(_policies, SR.policy_corpus), "policy_text")
_notes_index = _index("notes-index", over(_notes, SR.notes_corpus), "note_text")
_conversation_index = _index("conversation-index", over(_events, SR.conversation_corpus), "conversation_text")
# What bench.py times as the builds of the indexes.
INDEXES = {"index_policies": _policy_index, "index_notes": _notes_index, "index_conversations": _conversation_index, "store_days": _days}


def indexed(base: Query, index: Callable[[SparkSession, str], str], operator: Callable[..., DataFrame], *args: object) -> Query:
    """A search over a base relation through its stored index."""
    return lambda spark, sf_dir: operator(base(spark, sf_dir), *args, index=index(spark, sf_dir))


def _search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes found through an index that a stream built."""
    folder = new_folder(spark, "notes-index")
    corpus = SR.notes_corpus(_notes(spark, sf_dir))
    corpus.write.parquet(f"{folder}/corpus")
    arriving = spark.readStream.schema(corpus.schema).parquet(f"{folder}/corpus")
    refresh.refresh_index(
        arriving, "note_text", f"{folder}/index", f"{folder}/checkpoint", interval=None, buckets=16
    ).awaitTermination()
    return SX.search_index(spark, f"{folder}/index", NOTES_QUERY, ["auditor_name", "severity"], limit=10)


def _search_changed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after every third note was another text at first, some came twice and one was withdrawn."""
    stored = new_folder(spark, "notes-index")
    folder = f"{stored}/index"
    # Made once: the two batches and the withdrawn note read it five times.
    notes = SR.notes_corpus(_notes(spark, sf_dir))
    notes.write.parquet(f"{stored}/corpus")
    corpus = spark.read.schema(notes.schema).parquet(f"{stored}/corpus")
    third = F.pmod(F.crc32("doc_id"), F.lit(3)) == 0
    stale = F.when(third, F.lit(NOTES_QUERY)).otherwise(F.col("note_text")).alias("note_text")
    others = [c for c in corpus.columns if c != "note_text"]
    first = corpus.select("doc_id", stale, *[c for c in others if c != "doc_id"])
    withdrawn = first.limit(1).select(F.lit("GONE").alias("doc_id"), *[c for c in first.columns if c != "doc_id"])
    SX.index_documents(first.union(withdrawn), "note_text", folder, buckets=16)
    again = corpus.where(third).select(*first.columns)
    SX.index_documents(again.union(again), "note_text", folder, withdrawn=withdrawn)
    return SX.search_index(spark, folder, NOTES_QUERY, ["auditor_name", "severity"], limit=10)


def _metrics(base: Query, table: M.LogicalTable, *dimensions: str) -> Query:
    """All measures of a logical table by some of its dimensions."""
    return over(base, M.metrics, table, list(table.measures), list(dimensions))


def _month_over_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare agent usage this month with last month."""
    return M.metrics(
        _events(spark, sf_dir),
        M.AGENT_EVENTS,
        ["total_events", "total_conversations", "unique_users"],
        [F.trunc("event_date", "month").alias("month"), "agent_name"],
    )


_registered: list[tuple[str, str]] = []


def sql(text: str) -> Query:
    """SQL over the registered views and table functions, registered once per session and folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark._jsparkSession.sessionUUID(), sf_dir)
        if _registered != [key]:
            logs = sample_logs.audit_logs(spark, sf_dir)
            more = {"policies": _policies(spark, sf_dir), "notes": _notes(spark, sf_dir), "results": _results(spark, sf_dir)}
            sql_views.register_views(spark, logs, AS_OF, **more)
            _registered[:] = [key]
        return spark.sql(text)

    return run


def _sql_judge(judge: str) -> Query:
    """A judge called as a SQL function on all responses, its verdict taken apart."""
    listed = ""
    if judge in J.LISTS:
        listed = f", array_join(array_sort(try_variant_get(v, '$.{J.LISTS[judge]}', 'array<string>')), '|') AS {J.LISTS[judge]}"
    return sql(
        f"""SELECT trace_id, try_variant_get(v, '$.score', 'double') AS score, try_variant_get(v, '$.reasoning', 'string') AS reasoning{listed}
            FROM (SELECT trace_id, try_parse_json(judge_{judge}(user_query, agent_response)) AS v FROM eval_conversations)"""
    )


QUERIES: dict[str, Query] = {
    # relations
    "agent_events_flattened": _events,
    "agent_conversations": over(_events, E.agent_conversations),
    "agent_tool_usage": over(_events, E.agent_tool_usage),
    "agent_feedback_summary": over(_events, E.agent_feedback_summary),
    "feedback_comments": over(_events, E.feedback_comments),
    "agent_query_history": _history,
    "data_access_lineage": _lineage,
    "data_access_lineage_dedup": _lineage_dedup,
    "failed_queries_analysis": _failures,
    "user_activity_summary": _activity,
    "eval_conversations": _judged,
    "compliance_policies": _policies,
    "audit_notes": _notes,
    # activity and feedback
    "daily_conversations": over(_events, activity.daily_conversations, AS_OF),
    "tool_usage_distribution": over(_events, activity.tool_usage_distribution, AS_OF),
    "response_times": over(_events, activity.response_times, AS_OF),
    "feedback_rates": over(_events, activity.feedback_rates, AS_OF),
    "negative_feedback_alerts": over(_events, activity.negative_feedback_alerts, AS_OF),
    "negative_conversations": over(_events, activity.negative_conversations, AS_OF),
    "monthly_audit_summary": over(_events, activity.monthly_audit_summary, AS_OF),
    "get_agent_events": over(_events, activity.get_agent_events, AS_OF, AGENT, 7),
    "get_feedback_summary": over(_events, activity.get_feedback_summary, AS_OF),
    "investigate_thread": over(_events, activity.investigate_thread, THREAD),
    # security
    "failures_by_category": _failures_by_category,
    "permission_denials": over(_failures, security.permission_denials, AS_OF),
    "denial_samples": over(_failures, security.denial_samples, AS_OF),
    "high_row_queries": over(_history, security.high_row_queries, AS_OF),
    "after_hours_activity": over(_history, security.after_hours_activity, AS_OF),
    # data access
    "top_accessed_tables": over(_accesses, access.top_accessed_tables, AS_OF),
    "sensitive_table_access": over(_accesses, access.sensitive_table_access),
    "column_access": over(_accesses_with_columns, access.column_access, AS_OF, TABLE_PATTERN),
    "weekly_access_report": over(_accesses, access.weekly_access_report, AS_OF),
    "investigate_user_access": over(_accesses, access.investigate_user_access, SERVICE_USER),
    # users, roles and functions
    "user_activity": over(_activity, behaviour.user_activity, AS_OF),
    "high_failure_users": over(_activity, behaviour.high_failure_users, AS_OF),
    "role_usage": over(_history, behaviour.role_usage, AS_OF),
    "function_usage": over(_history, behaviour.function_usage, AS_OF),
    "function_daily_trend": over(_history, behaviour.function_daily_trend, AS_OF),
    "investigate_user_activity": over(_activity, behaviour.investigate_user_activity, SERVICE_USER),
    "investigate_user_failures": over(_failures, behaviour.investigate_user_failures, SERVICE_USER),
    "export_activity": _export,
    # metric model
    "metrics_agent_events": _metrics(_events, M.AGENT_EVENTS, "agent_name"),
    "metrics_failed_queries": _metrics(_failures, M.FAILED_QUERIES, "error_category"),
    "metrics_user_activity": _metrics(_activity, M.USER_ACTIVITY, "user_name"),
    "metrics_data_access": _metrics(_accesses, M.DATA_ACCESS, "source_table", "source_type"),
    "metrics_agent_events_profile": over(_events, M.profile, M.AGENT_EVENTS),
    "metrics_failed_queries_profile": over(_failures, M.profile, M.FAILED_QUERIES),
    "metrics_user_activity_profile": over(_activity, M.profile, M.USER_ACTIVITY),
    "metrics_data_access_profile": over(_accesses, M.profile, M.DATA_ACCESS),
    "metrics_month_over_month": _month_over_month,
    "vq_conversations_last_week": over(_events, M.conversations_last_week, AS_OF),
    "vq_positive_rate": over(_events, M.positive_rate),
    "vq_highest_failure_users": over(_activity, M.highest_failure_users, AS_OF),
    "vq_most_accessed_tables": over(_accesses, M.most_accessed_tables, AS_OF),
    # paths and patterns
    "usage_by_model": _usage_by_model,
    "watched_tables": _watched_tables,
    # stored days
    "daily_conversations_stored": of_days(stored_days.daily_conversations, AS_OF),
    "monthly_audit_summary_stored": of_days(stored_days.monthly_audit_summary, AS_OF),
    "feedback_rates_stored": of_days(stored_days.feedback_rates, AS_OF),
    "distinct_windows": of_days(stored_days.distinct_windows, AS_OF),
    "metrics_agent_events_stored": _metrics_stored,
    "user_activity_stored": _user_activity_stored,
    # search
    "conversation_corpus": over(_events, SR.conversation_corpus),
    "policy_corpus": over(_policies, SR.policy_corpus),
    "notes_corpus": over(_notes, SR.notes_corpus),
    "search_policies": indexed(_policies, _policy_index, SR.search_policies),
    "search_conversations": indexed(_events, _conversation_index, SR.search_conversations, CONVERSATION_QUERY),
    "search_conversations_default": indexed(_events, _conversation_index, SR.search_conversations),
    "search_conversations_scan": over(_events, SR.search_conversations, CONVERSATION_QUERY),
    "search_negative_conversations": indexed(
        _events, _conversation_index, SR.search_conversations, CONVERSATION_QUERY, {"feedback_sentiment": "NEGATIVE"}, 10
    ),
    "search_notes": indexed(_notes, _notes_index, SR.search_notes, NOTES_QUERY, {"agent_name": AGENT}),
    "search_notes_index": _search_index,
    "search_notes_changed": _search_changed_index,
    # evaluation
    "evaluation_dataset": over(_judged, EV.evaluation_dataset, AS_OF),
    "evaluation_dataset_stored": _sample_stored,
    "evaluation_verdicts_stored": _verdicts_bought,
    "judge_prompts": over(_judged, J.judge_prompts),
    "judge_groundedness": _judge("groundedness"),
    "judge_relevance": _judge("relevance"),
    "judge_safety": _judge("safety"),
    "judge_comprehensiveness": _judge("comprehensiveness"),
    "rule_evaluation": _rule_evaluation,
    "evaluation_results": _results,
    "evaluation_parsed": _parsed_flat,
    "evaluation_summary": over(_parsed, quality.evaluation_summary),
    "evaluation_by_agent": over(_parsed, quality.evaluation_by_agent),
    "critical_issues": _critical_issues,
    "groundedness_issues": _groundedness_issues,
    "evaluation_trend": over(_parsed, quality.evaluation_trend),
    # SQL
    "sql_get_agent_events": sql(f"SELECT * FROM get_agent_events('{AGENT}')"),
    "sql_get_feedback_summary": sql("SELECT * FROM get_feedback_summary(NULL, 30)"),
    "sql_daily_conversations": sql(
        """SELECT agent_name, event_date, count(DISTINCT thread_id) AS conversations,
             count(DISTINCT user_name) AS unique_users, count(*) AS total_events
           FROM agent_events_flattened WHERE event_date >= DATE '2024-01-31' - INTERVAL 30 DAY
           GROUP BY agent_name, event_date ORDER BY event_date DESC, conversations DESC"""
    ),
    "sql_search_policies": sql(
        """SELECT doc_id, policy_name, policy_category, left(policy_text, 200) AS policy_preview, score
           FROM search_policy_corpus('data access security') ORDER BY score DESC, doc_id LIMIT 3"""
    ),
    "sql_search_notes": sql(
        f"""SELECT doc_id, auditor_name, investigation_id, agent_name, severity, created_date,
             left(note_text, 200) AS note_preview, score
           FROM search_notes_corpus('{NOTES_QUERY}') WHERE agent_name = '{AGENT}' ORDER BY score DESC, doc_id LIMIT 10"""
    ),
    "sql_compliance_policies": sql("SELECT * FROM compliance_policies"),
    "sql_audit_notes": sql("SELECT * FROM audit_notes"),
    "sql_notes_corpus": sql("SELECT * FROM notes_corpus"),
    "sql_evaluation_dataset": sql("SELECT * FROM evaluation_dataset"),
    "sql_evaluation_results": sql("SELECT * FROM evaluation_results"),
    "sql_evaluation_trend": sql(
        """SELECT to_date(event_timestamp) AS event_date, count(*) AS samples,
             CAST(round(CAST(avg(composite_score) AS DECIMAL(28, 9)), 3) AS DOUBLE) AS avg_composite,
             sum(CASE WHEN evaluation_status = 'CRITICAL' THEN 1 ELSE 0 END) AS critical_count
           FROM evaluation_parsed GROUP BY 1"""
    ),
    **{f"sql_judge_{judge}": _sql_judge(judge) for judge in J.JUDGES},
    # jobs and streams
    "weekly_evaluation": _weekly_evaluation,
    "critical_alert": _critical_alert,
    "critical_alert_default": _critical_alert_default,
    "critical_alert_stream": _critical_alert_stream,
    "corpus_refresh": _corpus_refresh,
    "policy_corpus_refresh": _policy_corpus_refresh,
    "notes_corpus_refresh": _notes_corpus_refresh,
    "agent_events_refresh": _agent_events_refresh,
    "agent_events_redelivered": _redelivered,
    "lineage_refresh": _lineage_refresh,
    "critical_alert_once": _critical_alert_once,
}
QUERIES = {name: in_64_bits(query) for name, query in QUERIES.items()}
