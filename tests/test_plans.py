"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tracewarden import catalog as C
from tracewarden.operators import agent_events as E
from tracewarden.operators import lineage as LN
from tracewarden.operators import query_log as Q
from tracewarden.plans import access, activity, behaviour, security
from tracewarden.session import new_folder
from tracewarden.sources import sample_logs
from tracewarden.sources.logs import read_access_log, read_query_log, read_raw_events

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    """The plan as it was run, after adaptive changes."""
    df.collect()
    text = plan(df)
    return text[text.index("== Final Plan ==") : text.rindex("== Initial Plan ==")]


@pytest.fixture(scope="module")
def stored(spark):
    folder = new_folder(spark, "logs")
    logs = sample_logs.audit_logs(spark, SF_DIR)
    logs.raw_events.write.parquet(f"{folder}/events")
    logs.query_log.write.parquet(f"{folder}/queries")
    logs.access_log.write.parquet(f"{folder}/accesses")
    return (
        read_raw_events(spark, f"{folder}/events"),
        read_query_log(spark, f"{folder}/queries"),
        read_access_log(spark, f"{folder}/accesses"),
    )


@pytest.mark.parametrize("name", list(C.QUERIES))
def test_no_query_pairs_rows_or_leaves_the_jvm(spark, name):
    text = plan(C.QUERIES[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "ObjectHashAggregate(keys=[], "):
        assert operator not in text
    # Only the one-row partial results of a global aggregate may meet in one task.
    for below in re.findall(r"Exchange SinglePartition.*\n[^\n]*?\+- ([^\n]*)", text):
        assert re.search(r"HashAggregate\(keys=\[\]", below), below


def test_event_windows_reach_the_scan_and_json_is_parsed_once(stored, as_of):
    events = E.agent_events_flattened(stored[0])
    for report in (activity.daily_conversations, activity.feedback_rates, activity.monthly_audit_summary):
        text = plan(report(events, as_of))
        assert "GreaterThanOrEqual(timestamp," in text
        assert text.count("from_json(") == 1
        assert "ReadSchema: struct<timestamp:timestamp_ntz,record:string>" in text


def test_relations_used_several_times_are_computed_once(stored, as_of):
    events = E.agent_events_flattened(stored[0])
    text = executed(activity.response_times(events, as_of))
    assert text.count("from_json(") == 1 and "ReusedExchange" in text
    assert executed(E.agent_feedback_summary(events)).count("from_json(") == 1
    failures = Q.failed_queries_analysis(stored[1], as_of)
    assert executed(security.permission_denials(failures, as_of)).count("FileScan") == 1


def test_query_log_reports_read_only_their_columns(stored, as_of):
    text = plan(behaviour.user_activity(Q.user_activity_summary(stored[1], as_of), as_of))
    assert "GreaterThanOrEqual(start_time," in text
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {
        "user_name",
        "execution_status",
        "rows_produced",
        "start_time",
    }
    text = plan(behaviour.role_usage(Q.agent_query_history(stored[1], as_of), as_of))
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {
        "user_name",
        "role_name",
        "warehouse_name",
        "query_text",
        "rows_produced",
        "start_time",
    }


def test_query_text_is_upper_cased_once(stored, as_of):
    text = plan(behaviour.function_usage(Q.agent_query_history(stored[1], as_of), as_of))
    assert text.count("upper(") == 1


def test_lineage_reports_never_explode_targets(stored, as_of):
    sources = LN.source_accesses(stored[1], stored[2], as_of)
    text = plan(access.top_accessed_tables(sources, as_of))
    assert text.count("Generate ") == 1
    assert "EqualTo(execution_status,SUCCESS)" in text and "GreaterThanOrEqual(start_time," in text
    # Of the nested arrays, only the fields in use are read.
    scan = text.split("ReadSchema")[-1]
    assert "objectName" in scan and "columns" not in scan


def test_user_activity_is_one_shuffle(stored, as_of):
    assert plan(Q.user_activity_summary(stored[1], as_of)).count("Exchange") == 1


def test_sample_is_a_top_k(stored, as_of):
    from tracewarden.operators.evaluation import evaluation_dataset

    text = plan(evaluation_dataset(E.eval_conversations(E.agent_events_flattened(stored[0])), as_of))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_a_hot_group_is_spread(spark, as_of):
    """A third of all feedback falls on one agent and one second."""
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        events = spark.range(30_000).selectExpr(
            "if(id % 3 = 0, 'HOT', concat('A', id % 50)) AS agent_name",
            "'CORTEX_AGENT_FEEDBACK' AS event_type",
            "TIMESTAMP_NTZ '2024-01-30 09:00:00' AS event_timestamp",
            "DATE '2024-01-30' AS event_date",
            "concat('c', id) AS feedback_comment",
            "if(id % 5 = 0, 'NEGATIVE', 'POSITIVE') AS feedback_sentiment",
        )
        rows = E.agent_feedback_summary(events).collect()
        (hot,) = [r for r in rows if r.agent_name == "HOT"]
        assert (hot.total_feedback, hot.negative_count, len(rows)) == (10_000, 2_000, 51)
        comments = E.feedback_comments(events)
        assert comments.count() == 30_000 and comments.where("agent_name = 'HOT'").count() == 10_000
        E.agent_feedback_summary(events).createOrReplaceTempView("hot_summary")
        assert spark.sql("SELECT sum(total_feedback) FROM hot_summary").first()[0] == 30_000
        sizes = comments.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 2 * 30_000 / 4
        # A third of the rows share their time, the sort's first key; its other keys spread them.
        newest = activity.get_agent_events(
            events.selectExpr("*", "feedback_comment AS thread_id", "'u' AS user_name", "'x' AS tool_used"), as_of
        )
        spread = newest.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(spread) > 1 and max(r["count"] for r in spread) < 0.6 * 30_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_hot_query_is_split_in_the_lineage_join(spark, as_of, tmp_path):
    """A third of the access records name one query."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        keys = spark.range(0, 60_000, 1, 8)
        queries = keys.where("id < 20000").selectExpr(
            "concat('Q', id) AS query_id",
            "'U' AS user_name",
            "'R' AS role_name",
            "'SUCCESS' AS execution_status",
            "id AS rows_produced",
            "id AS bytes_scanned",
            "TIMESTAMP_NTZ '2024-01-30 09:00:00' AS start_time",
        )
        accesses = keys.selectExpr(
            "if(id % 3 = 0, 'Q7', concat('Q', id % 20000)) AS query_id",
            "array(named_struct('objectName', concat('T', id % 900), 'objectDomain', 'TABLE', "
            "'columns', array(named_struct('columnName', 'C')))) AS base_objects_accessed",
            "array(named_struct('objectName', 'V', 'objectDomain', 'VIEW', "
            "'columns', array(named_struct('columnName', 'C')))) AS direct_objects_accessed",
        )
        queries.write.parquet(f"{tmp_path}/queries")
        accesses.write.parquet(f"{tmp_path}/accesses")
        sources = LN.source_accesses(
            spark.read.parquet(f"{tmp_path}/queries"), spark.read.parquet(f"{tmp_path}/accesses"), as_of
        )
        report = access.top_accessed_tables(sources, as_of, limit=1000)
        assert "skew=true" in executed(report)
        assert sum(r.access_count for r in report.collect()) == 60_000
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_verdicts_are_cut_to_the_sample_before_any_shuffle(spark, as_of, tmp_path):
    from tracewarden.operators import judges as J

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        raw = [f"'x' AS {J.raw_column(j)}" for j in J.JUDGES]
        spark.range(1000).selectExpr("concat('T', id) AS trace_id", *raw).write.parquet(str(tmp_path / "verdicts"))
        verdicts = spark.read.parquet(str(tmp_path / "verdicts"))
        sample = spark.range(500).selectExpr("concat('T', id) AS trace_id").orderBy("trace_id").limit(100)
        scored = J.recorded_scorer(verdicts, bounded=True)(sample)
        text = plan(scored)
        side = text[: text.index("verdicts")]
        assert "BroadcastHashJoin" in side.split("Exchange hashpartitioning")[-1]
        assert scored.count() == 100 and scored.where(f"{J.raw_column(J.JUDGES[0])} = 'x'").count() == 100
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_stored_events_are_pruned_by_date(spark, stored, as_of):
    from tracewarden.sources.logs import read_agent_events, write_agent_events

    folder = new_folder(spark, "events")
    write_agent_events(E.agent_events_flattened(stored[0]), folder)
    events = read_agent_events(spark, folder)
    for report in (
        activity.get_agent_events(events, as_of, "CLAIMS_AGENT"),
        activity.get_feedback_summary(events, as_of),
        activity.feedback_rates(events, as_of),
        E.eval_conversations(events).where("event_date > '2024-01-20'"),
    ):
        assert "PartitionFilters: [isnotnull(event_date" in plan(report)


def test_sorts_of_whole_reports_end_in_their_keys(stored, as_of):
    events = E.agent_events_flattened(stored[0])
    activity_rows = Q.user_activity_summary(stored[1], as_of)
    failures = Q.failed_queries_analysis(stored[1], as_of)
    history = Q.agent_query_history(stored[1], as_of)
    for report, last in (
        (activity.get_agent_events(events, as_of), "feedback_sentiment"),
        (security.permission_denials(failures, as_of), "failure_date"),
        (security.after_hours_activity(history, as_of), "activity_hour"),
        (behaviour.user_activity(activity_rows, as_of), "user_name"),
        (behaviour.high_failure_users(activity_rows, as_of), "activity_date"),
        (security.failures_by_category(failures, as_of), "error_category"),
    ):
        keys = re.search(r"rangepartitioning\((.*), \d+\)", plan(report)).group(1)
        assert last in keys.split(",")[-1], keys
