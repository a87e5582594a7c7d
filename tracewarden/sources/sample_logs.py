"""Derives the platform logs from the given test tables (rules in FIXTURES.md).

The event log is built as real JSON text and the access log as real nested
arrays, so that the operators do their full work on them.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.sources.logs import AuditLogs
from tracewarden.sources.reference_tables import add_audit_notes, add_policies, seed_policies

AGENTS = ("FRAUD_INVESTIGATION_ASSISTANT", "CUSTOMER_SERVICE_AGENT", "CLAIMS_AGENT", "BILLING_AGENT")
TOOLS = ("cortex_analyst", "cortex_search", "web_search")
ROLES = ("AUDITOR", "ANALYST", "ADMIN")
WAREHOUSES = ("AGENT_WH", "CORTEX_WH", "BI_WH")
QUERY_TEXTS = (
    "SELECT CORTEX.COMPLETE('m', c) FROM t",
    "select cortex.summarize(c) from t",
    "SELECT CORTEX.TRANSLATE(c) FROM t",
    "SELECT Cortex.Sentiment(c) FROM t",
    "CALL CORTEX_ANALYST(q)",
    "SELECT CORTEX_SEARCH(q), CORTEX.COMPLETE(q)",
    "SELECT * FROM CORTEX_SEARCH_LOG",
    "SELECT * FROM SALES",
)
ERROR_CODES = (1003, 2003, 3001, 2043, 2140, 100132, 100183, 100051, 100052, 604)
SOURCE_TABLES = ("DB.HEALTH.CLAIMS", "DB.HEALTH.PATIENT_MASTER", "DB.PHI.RECORDS", "DB.SALES.ORDERS", "DB.SALES.PARTS")
ROWS_OF_A_TASK = 250_000
NO_VERDICT = "I cannot judge this."

# Columns used of the given tables.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int",
    "documents": "doc_id bigint, text string, lang string, source string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _numbered(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _spread(table: DataFrame, key: str) -> DataFrame:
    """The table dealt out by its key.

    The small test files are a single row group each, which one core would have
    to turn into JSON and parse alone. A number of partitions that is named is not
    coalesced, small as they are; it grows with the rows, so that a task's memory does not.
    """
    return table.repartition(_parts(table), key)


def _parts(table: DataFrame) -> int:
    return max(table.sparkSession.sparkContext.defaultParallelism, math.ceil(table.count() / ROWS_OF_A_TASK))


def _events(spark: SparkSession, sf_dir: str, in_time_order: bool = False) -> DataFrame:
    table = _table(spark, sf_dir, "events")
    events = table.repartitionByRange(_parts(table), "ts", "event_id") if in_time_order else _spread(table, "event_id")
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _first_turns(turns: DataFrame) -> DataFrame:
    """First user and first assistant text of each conversation."""

    def first(role: str) -> Column:
        said = F.col("role") == role
        return F.min_by(F.when(said, F.col("text")), F.when(said, F.col("turn")))

    return turns.groupBy("conv_id").agg(
        first("user").alias("user_text"),
        first("assistant").alias("assistant_text"),
    )


def raw_events(spark: SparkSession, sf_dir: str, in_time_order: bool = False) -> DataFrame:
    """The event log; ``in_time_order`` gives a task the events of few dates, as log files have them."""
    i, u, k, kind = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("event_type")
    turns = _table(spark, sf_dir, "conversations")
    conversation_count = turns.agg(F.max("conv_id") + 1).scalar()
    events = (
        _events(spark, sf_dir, in_time_order)
        .withColumn("conv_id", i % conversation_count)
        .join(_first_turns(turns), "conv_id", "left")
    )
    is_view, is_click, is_purchase = kind == "view", kind == "click", kind == "purchase"
    is_signup, is_error = kind == "signup", kind == "error"
    duration = F.round(F.col("value") * 100).cast("bigint")

    def span(name: Column, tool: Column, given: Column, answer: Column) -> Column:
        return F.struct(
            name.alias("name"),
            tool.cast("string").alias("tool_name"),
            given.cast("string").alias("input"),
            answer.cast("string").alias("output"),
            duration.alias("duration_ms"),
        )

    first_span = span(
        F.when(is_view | is_signup, "response_generation")
        .when(is_click, "tool_execution")
        .when(is_purchase & (k % 3 == 2), "response_generation")
        .when(is_purchase, "feedback")
        .otherwise("planning"),
        F.when(is_click | (is_view & (i % 2 == 1)), _pick(TOOLS, i % 3)),
        F.col("user_text"),
        F.col("assistant_text"),
    )
    later_span = span(F.lit("sub"), F.lit(None), F.lit(None), F.lit(None))
    span_count = F.when(k == 1, 0).otherwise(1 + i % 3).cast("int")
    spans = F.when(k != 0, F.slice(F.array(first_span, later_span, later_span), 1, span_count))
    feedback = F.struct(
        F.when(k % 7 != 3, k % 5 != 0).alias("positive"),
        F.when(i % 2 == 0, _numbered("comment ", k)).alias("comment"),
    )
    record = F.struct(
        _pick(AGENTS, (u + F.dayofmonth("ts")) % 4).alias("agent_name"),
        F.lit("AGENTS_DB").alias("database"),
        F.lit("PROD").alias("schema"),
        F.when(is_error & (k % 2 == 1), "EXTERNAL").otherwise("CORTEX AGENT").alias("agent_type"),
        _numbered("USER_", u).alias("user_name"),
        F.concat(_numbered("T", u), F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("thread_id"),
        _numbered("S", F.floor(i / 10)).alias("session_id"),
        F.when(is_view, "CORTEX_AGENT_RESPONSE")
        .when(is_click, "CORTEX_AGENT_TOOL_EXECUTION")
        .when(is_purchase, "CORTEX_AGENT_FEEDBACK")
        .when(is_signup & (i % 2 == 0), "CORTEX_AGENT_TURN")
        .when(is_signup, "RESPONSE")
        .when(k % 2 == 0, "AGENT_ERROR")
        .otherwise("EXTERNAL_TRACE")
        .alias("name"),
        _numbered("TR", i).alias("trace_id"),
        spans.alias("spans"),
        F.when(is_purchase, feedback).alias("feedback"),
    )
    return events.select(F.col("ts").alias("timestamp"), F.to_json(record).alias("record"))


def raw_events_with_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in time order, with a part of the record that the declared schema does not have; a third of the records lack it."""
    number = F.regexp_extract("record", r'"trace_id":"TR([0-9]+)"', 1).cast("bigint")
    usage = F.struct(_numbered("m", number % 4).alias("model"), ((number * 7) % 1000).alias("tokens"))
    more = F.concat(F.expr("left(record, length(record) - 1)"), F.lit(',"usage":'), F.to_json(usage), F.lit("}"))
    return raw_events(spark, sf_dir, in_time_order=True).withColumn("record", F.when(number % 3 > 0, more).otherwise(F.col("record")))


def watch_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(watch_list, pattern): one pattern per order, most of which no table is like."""
    n = F.col("o_orderkey")
    forms = ("%{}%", "%claims{}%", "db.%.rec_rds{}", "%Patient\\_M%{}", "_B.SALES.%{}", "%S%{}")
    suffix = F.when(n % 5 == 0, "").otherwise(n.cast("string"))
    choices = [F.concat(F.lit(form.split("{}")[0]), suffix, F.lit(form.split("{}")[1])) for form in forms]
    pattern = F.element_at(F.array(*choices), (1 + n % 6).cast("int"))
    # One list's patterns without literals would be like every table.
    rows = _table(spark, sf_dir, "orders").select(_numbered("L", n % 7).alias("watch_list"), pattern.alias("pattern"))
    return rows.where("pattern <> '%%' AND (pattern <> '%S%' OR watch_list = 'L0')").distinct()


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    failed = F.col("event_type") == "error"
    elapsed = F.round(F.col("value") * 100).cast("bigint")
    return _events(spark, sf_dir).select(
        _numbered("Q", i).alias("query_id"),
        _numbered("SVC_", u % 5).alias("user_name"),
        _pick(ROLES, u % 3).alias("role_name"),
        _pick(WAREHOUSES, i % 3).alias("warehouse_name"),
        _pick(QUERY_TEXTS, k % 8).alias("query_text"),
        F.when(k % 8 == 4, "CALL").otherwise("SELECT").alias("query_type"),
        F.when(failed, "FAIL").when(k == 50, "INCIDENT").otherwise("SUCCESS").alias("execution_status"),
        F.when(failed, _pick(ERROR_CODES, k % 10)).cast("string").alias("error_code"),
        F.when(failed & (k % 10 == 9) & (i % 2 == 0), "Statement reached its TimeOut")
        .when(failed, _numbered("error ", k))
        .alias("error_message"),
        F.when(~failed, (i * 7919) % 20011).alias("rows_produced"),
        ((i * 1031) % 1000003).alias("bytes_scanned"),
        elapsed.alias("total_elapsed_time"),
        F.col("ts").alias("start_time"),
        (F.col("ts") + F.make_dt_interval(secs=(elapsed / 1000).cast("decimal(18,6)"))).alias("end_time"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    parts = _parts(lines)
    # Collecting reduces nothing before the shuffle, so rows are spread by order first, and orders alike to meet them.
    lines = lines.repartition(parts, "l_orderkey")
    orders = _table(spark, sf_dir, "orders").repartition(parts, "o_orderkey")

    def columns(*names: str) -> Column:
        if not names:
            return F.from_json(F.lit("[]"), "array<struct<columnName:string>>")
        return F.array(*[F.struct(F.lit(n).alias("columnName")) for n in names])

    def accessed(name: Column, domain: Column, cols: Column) -> Column:
        return F.struct(name.alias("objectName"), domain.alias("objectDomain"), cols.alias("columns"))

    def base(line: Column) -> Column:
        return accessed(
            _pick(SOURCE_TABLES, line["table"]),
            F.when(line["is_table"], "TABLE").otherwise("VIEW"),
            F.when(line["number"] == 1, columns("ID", "NAME"))
            .when(line["number"] == 2, columns("ID"))
            .when(line["number"] == 3, columns())
            .otherwise(columns("ID", "AMOUNT", "DOB")),
        )

    # Numbers are gathered and turned into objects afterwards, which are several times as large.
    numbers = F.struct(
        (F.col("l_partkey") % 5).alias("table"),
        (F.col("l_suppkey") % 2 == 0).alias("is_table"),
        F.col("l_linenumber").alias("number"),
    )
    base_objects = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(numbers).alias("lines"))
    direct = [
        accessed(_numbered("DB.APP.V", (F.col("o_custkey") + n) % 4), F.lit("VIEW"), columns()) for n in (0, 1)
    ]
    direct_count = F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(1 + F.col("o_orderkey") % 2).cast("int")
    return orders.join(base_objects, "o_orderkey", "left").select(
        _numbered("Q", F.col("o_orderkey")).alias("query_id"),
        F.transform("lines", base).alias("base_objects_accessed"),
        F.slice(F.array(*direct), 1, direct_count).alias("direct_objects_accessed"),
    )


def access_stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access log with the time that each query began; null for orders without an event."""
    began = query_log(spark, sf_dir).select("query_id", F.col("start_time").alias("query_start_time"))
    return access_log(spark, sf_dir).join(began, "query_id", "left")


def audit_logs(spark: SparkSession, sf_dir: str) -> AuditLogs:
    return AuditLogs(raw_events(spark, sf_dir), query_log(spark, sf_dir), access_log(spark, sf_dir))


def recorded_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored raw judge outputs, some malformed and some without a score."""
    i = F.col("event_id")

    def score(factor: int, spread: int) -> Column:
        return F.round(1 - ((i * factor) % spread) / 100, 2)

    def verdict(value: Column, list_name: str | None = None) -> Column:
        fields = [value.alias("score"), _numbered("r", i).alias("reasoning")]
        if list_name:
            found = F.slice(F.array(F.lit("first"), F.lit("second")), 1, (i % 3).cast("int"))
            fields.append(found.alias(list_name))
        return F.when(i % 13 == 0, NO_VERDICT).otherwise(F.to_json(F.struct(*fields)))

    return _table(spark, sf_dir, "events").select(
        _numbered("TR", i).alias("trace_id"),
        verdict(score(37, 60), "flagged_claims").alias("groundedness_raw"),
        verdict(F.when(i % 17 != 0, score(53, 60))).alias("relevance_raw"),
        verdict(score(71, 40), "issues_found").alias("safety_raw"),
        verdict(score(29, 60), "missing_aspects").alias("comprehensiveness_raw"),
    )


def policies(spark: SparkSession, sf_dir: str, as_of: datetime) -> DataFrame:
    """Seed policies and one policy per document."""
    documents = _table(spark, sf_dir, "documents").select(
        _numbered("DOC-", F.col("doc_id")).alias("policy_id"),
        F.col("source").alias("policy_name"),
        F.col("lang").alias("policy_category"),
        F.col("text").alias("policy_text"),
        F.lit("2024-01-01").cast("date").alias("effective_date"),
    )
    return seed_policies(spark, as_of).unionByName(add_policies(documents, as_of))


def notes(spark: SparkSession, sf_dir: str, as_of: datetime) -> DataFrame:
    """One audit note per labelled document."""
    doc = F.col("doc_id")
    documents = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    labelled = _table(spark, sf_dir, "labels").join(documents, "doc_id")
    return add_audit_notes(
        labelled.select(
            _numbered("N", doc).alias("note_id"),
            _numbered("INV-", doc % 20).alias("investigation_id"),
            _pick(AGENTS, doc % 4).alias("agent_name"),
            _numbered("AUD_", doc % 7).alias("auditor_name"),
            F.col("text").alias("note_text"),
            F.when(F.col("toxic") == 1, "CRITICAL").when(F.col("quality") == 0, "WARNING").alias("severity"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(doc % 30).cast("int"))).alias(
                "created_date"
            ),
        ),
        as_of,
    )
