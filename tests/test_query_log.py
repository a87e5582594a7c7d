from __future__ import annotations

from datetime import datetime, timedelta

from tracewarden import schemas
from tracewarden.operators import lineage as LN
from tracewarden.operators import query_log as Q
from tracewarden.plans import access, behaviour, security

MONDAY = datetime(2024, 1, 29, 12)


def log(spark, *rows):
    defaults = {
        "user_name": "U",
        "role_name": "R",
        "warehouse_name": "WH",
        "query_text": "SELECT 1",
        "query_type": "SELECT",
        "execution_status": "SUCCESS",
        "rows_produced": 1,
        "bytes_scanned": 1,
        "total_elapsed_time": 1000,
        "start_time": MONDAY,
    }
    full = [
        {**dict.fromkeys(schemas.QUERY_LOG.names), **defaults, "query_id": f"Q{n}", **row} for n, row in enumerate(rows)
    ]
    return spark.createDataFrame([tuple(r[c] for c in schemas.QUERY_LOG.names) for r in full], schemas.QUERY_LOG)


def test_function_is_the_first_listed_whatever_its_case_and_place(spark, as_of):
    texts = [
        "select cortex.translate(x)",
        "SELECT CORTEX_SEARCH(q), Cortex.Complete(q)",
        "CALL cortex_analyst(q) -- cortex.sentiment",
        "SELECT * FROM cortex_log",
        "SELECT 1",
    ]
    history = Q.agent_query_history(log(spark, *[{"query_text": t} for t in texts]), as_of)
    found = {r.query_text: r.cortex_function_used for r in history.collect()}
    assert found == {texts[0]: "TRANSLATE", texts[1]: "COMPLETE", texts[2]: "SENTIMENT", texts[3]: None}


def test_agent_warehouses_count_whatever_the_text(spark, as_of):
    names = ["MY_AGENT_WH", "CORTEX1", "agent_wh", None]
    rows = [{"warehouse_name": n} for n in names]
    history = Q.agent_query_history(log(spark, *rows), as_of)
    assert {r.warehouse_name for r in history.collect()} == {"MY_AGENT_WH", "CORTEX1"}


def test_error_categories(spark, as_of):
    codes = ["1003", "2003", "3001", "2043", "100132", "100051", "604", None, "E-17"]
    rows = [{"execution_status": "FAIL", "error_code": c} for c in codes]
    rows.append({"execution_status": "FAIL", "error_code": "604", "error_message": "a TimeOut hit", "user_name": "T"})
    failures = Q.failed_queries_analysis(log(spark, *rows), as_of)
    found = {(r.error_code, r.user_name): r.error_category for r in failures.collect()}
    assert [found[(c, "U")] for c in codes] == [
        "PERMISSION_DENIED",
        "PERMISSION_DENIED",
        "PERMISSION_DENIED",
        "OBJECT_NOT_FOUND",
        "SYNTAX_ERROR",
        "RESOURCE_LIMIT",
        "OTHER",
        "OTHER",
        "OTHER",
    ]
    assert found[("604", "T")] == "TIMEOUT"


def test_windows_are_relative_to_as_of(spark, as_of):
    rows = [
        {"execution_status": "FAIL", "start_time": as_of - timedelta(days=30)},
        {"execution_status": "FAIL", "start_time": as_of - timedelta(days=30, seconds=1)},
    ]
    assert [r.query_id for r in Q.failed_queries_analysis(log(spark, *rows), as_of).collect()] == ["Q0"]


def test_user_activity_counts_other_statuses_in_the_total_only(spark, as_of):
    rows = [{}, {"execution_status": "FAIL", "rows_produced": None}, {"execution_status": "INCIDENT"}]
    rows.append({"start_time": MONDAY + timedelta(hours=3)})
    (row,) = Q.user_activity_summary(log(spark, *rows), as_of).collect()
    assert (row.total_queries, row.successful_queries, row.failed_queries) == (4, 2, 1)
    assert (row.failure_rate_pct, row.active_hours, row.total_rows_produced) == (25.0, 2, 3)


def test_after_hours_boundaries(spark, as_of):
    times = [MONDAY.replace(hour=h) for h in (7, 8, 18, 19)]
    times += [datetime(2024, 1, 27, 7), datetime(2024, 1, 28, 7)]  # Saturday, Sunday
    rows = [{"start_time": t, "warehouse_name": "AGENT"} for t in times]
    history = Q.agent_query_history(log(spark, *rows), as_of)
    found = security.after_hours_activity(history, as_of, more_than=0).collect()
    assert {(str(r.activity_date), r.activity_hour) for r in found} == {("2024-01-29", 7), ("2024-01-29", 19)}


def test_high_row_queries_break_ties_by_query(spark, as_of):
    rows = [{"rows_produced": n, "warehouse_name": "AGENT"} for n in (10_000, 10_001, 20_000, 20_000)]
    history = Q.agent_query_history(log(spark, *rows), as_of)
    found = security.high_row_queries(history, as_of, limit=2).collect()
    assert [r.query_id for r in found] == ["Q2", "Q3"]


def test_denials_and_their_samples(spark, as_of):
    rows = [
        {"execution_status": "FAIL", "error_code": "1003", "query_text": f"SELECT {n % 7}"} for n in range(20)
    ]
    failures = Q.failed_queries_analysis(log(spark, *rows), as_of)
    (whole,) = security.permission_denials(failures, as_of).collect()
    assert whole.denial_count == 20
    samples = {r.query_sample: r.times for r in security.denial_samples(failures, as_of).collect()}
    assert samples == {f"SELECT {n}": 3 if n < 6 else 2 for n in range(7)}


def test_windows_end_at_the_reference_time(spark, as_of):
    times = [as_of - timedelta(hours=1), as_of, as_of + timedelta(seconds=1), as_of + timedelta(days=3)]
    rows = [{"start_time": t, "warehouse_name": "AGENT", "execution_status": "FAIL"} for t in times]
    queries = log(spark, *rows)
    assert Q.agent_query_history(queries, as_of).count() == 2
    assert Q.failed_queries_analysis(queries, as_of).count() == 2
    assert sum(r.total_queries for r in Q.user_activity_summary(queries, as_of).collect()) == 2


def test_unreachable_label_needs_a_lower_threshold(spark, as_of):
    rows = [{"start_time": as_of - timedelta(days=1)}] * 19
    rows.append({"start_time": as_of - timedelta(days=1), "execution_status": "FAIL"})
    activity = Q.user_activity_summary(log(spark, *rows), as_of)
    assert behaviour.high_failure_users(activity, as_of).count() == 0
    (row,) = behaviour.high_failure_users(activity, as_of, min_rate=1).collect()
    assert (row.failure_rate_pct, row.status) == (5.0, "✅ NORMAL")


def objects(*names):
    return [(n, "TABLE", [("ID",), ("NAME",)] if n == "T.CLAIMS" else []) for n in names]


def test_lineage_is_outer_on_both_arrays(spark, as_of):
    queries = log(spark, {}, {}, {}, {"execution_status": "FAIL"})
    accesses = spark.createDataFrame(
        [
            ("Q0", objects("T.CLAIMS", "T.B"), objects("V1", "V2")),
            ("Q1", None, []),
            ("Q2", [], None),
            ("Q3", objects("T.FAILED"), None),
            ("unknown", objects("T.X"), None),
        ],
        schemas.ACCESS_LOG,
    )
    lineage = LN.data_access_lineage(queries, accesses, as_of)
    pairs = sorted((r.query_id, r.source_table or "", r.target_object or "") for r in lineage.collect())
    assert pairs == [
        ("Q0", "T.B", "V1"),
        ("Q0", "T.B", "V2"),
        ("Q0", "T.CLAIMS", "V1"),
        ("Q0", "T.CLAIMS", "V2"),
        ("Q1", "", ""),
        ("Q2", "", ""),
    ]
    assert LN.data_access_lineage(queries, accesses, as_of, dedup=True).count() == 4
    sources = LN.source_accesses(queries, accesses, as_of, with_columns=True)
    assert sources.selectExpr("sum(fanout)").head()[0] == lineage.count()
    columns = access.column_access(sources, as_of, "%.%").collect()
    assert {(r.source_table, r.column_accessed, r.access_count) for r in columns} == {
        ("T.CLAIMS", "ID", 2),
        ("T.CLAIMS", "NAME", 2),
        ("T.B", None, 2),
    }
    assert access.top_accessed_tables(sources, as_of).count() == 2
    assert {r.source_table: r.access_count for r in access.investigate_user_access(sources, "U").collect()} == {
        "T.CLAIMS": 2,
        "T.B": 2,
        None: 2,
    }


def test_bucketed_logs_join_without_a_shuffle(spark, as_of):
    from tracewarden.sources.logs import save_bucketed

    queries = log(spark, *[{} for _ in range(50)])
    accesses = spark.createDataFrame([(f"Q{n}", objects("T"), None) for n in range(50)], schemas.ACCESS_LOG)
    save_bucketed(queries, "bucketed_queries", 4)
    save_bucketed(accesses, "bucketed_accesses", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sources = LN.source_accesses(spark.table("bucketed_queries"), spark.table("bucketed_accesses"), as_of)
        assert "Exchange" not in sources._jdf.queryExecution().executedPlan().toString()
        assert sources.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE bucketed_queries")
        spark.sql("DROP TABLE bucketed_accesses")
