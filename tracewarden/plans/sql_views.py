"""The audit relations as temporary views, for those who write SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tracewarden.functions.text import TOKEN_PATTERN
from tracewarden.operators import agent_events as E
from tracewarden.operators import evaluation as EV
from tracewarden.operators import judges as J
from tracewarden.operators import lineage as LN
from tracewarden.operators import query_log as Q
from tracewarden.operators import search as SR
from tracewarden.operators.search import B, K1, SCORE_DIGITS
from tracewarden.sources.logs import AuditLogs

TABLE_FUNCTIONS = (
    """
    CREATE OR REPLACE TEMPORARY FUNCTION get_agent_events(p_agent_name STRING, p_days_back INT DEFAULT 7)
    RETURNS TABLE (event_type STRING, user_name STRING, thread_id STRING, tool_used STRING,
                   feedback_sentiment STRING, event_timestamp TIMESTAMP_NTZ)
    RETURN SELECT event_type, user_name, thread_id, tool_used, feedback_sentiment, event_timestamp
           FROM agent_events_flattened
           WHERE (p_agent_name IS NULL OR agent_name = p_agent_name)
             AND event_date BETWEEN date_sub(DATE '{today}', p_days_back) AND DATE '{today}'
             AND event_timestamp BETWEEN TIMESTAMP_NTZ '{as_of}' - make_dt_interval(p_days_back)
                                     AND TIMESTAMP_NTZ '{as_of}'
           ORDER BY event_timestamp DESC NULLS FIRST, thread_id NULLS LAST, user_name NULLS LAST,
                    event_type NULLS LAST, tool_used NULLS LAST, feedback_sentiment NULLS LAST
    """,
    """
    CREATE OR REPLACE TEMPORARY FUNCTION get_feedback_summary(p_agent_name STRING, p_days_back INT DEFAULT 30)
    RETURNS TABLE (agent_name STRING, total_feedback BIGINT, positive_count BIGINT, negative_count BIGINT,
                   positive_rate DOUBLE)
    RETURN SELECT agent_name, total_feedback, positive_count, negative_count,
                  round(CAST(positive_count AS DOUBLE) / nullif(total_feedback, 0) * 100, 2)
           FROM (SELECT agent_name, count(*) AS total_feedback,
                        sum(CASE WHEN feedback_sentiment = 'POSITIVE' THEN 1 ELSE 0 END) AS positive_count,
                        sum(CASE WHEN feedback_sentiment = 'NEGATIVE' THEN 1 ELSE 0 END) AS negative_count
                 FROM agent_events_flattened
                 WHERE event_type = 'CORTEX_AGENT_FEEDBACK'
                   AND (p_agent_name IS NULL OR agent_name = p_agent_name)
                   AND event_date BETWEEN date_sub(DATE '{today}', p_days_back) AND DATE '{today}'
                   AND event_timestamp BETWEEN TIMESTAMP_NTZ '{as_of}' - make_dt_interval(p_days_back)
                                           AND TIMESTAMP_NTZ '{as_of}'
                 GROUP BY agent_name)
    """,
)


def audit_views(
    logs: AuditLogs,
    as_of: datetime,
    events: DataFrame | None = None,
    policies: DataFrame | None = None,
    notes: DataFrame | None = None,
    results: DataFrame | None = None,
    history: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All audit relations by name, over stored flattened ``events`` if there are any.

    Policies and notes come with their corpora; ``results`` are those of the newest evaluation
    and ``history`` those of earlier ones.
    """
    if events is None:
        events = E.agent_events_flattened(logs.raw_events)
    views = {
        "agent_events_flattened": events,
        "agent_conversations": E.agent_conversations(events),
        "agent_tool_usage": E.agent_tool_usage(events),
        "agent_feedback_summary": E.agent_feedback_summary(events),
        "feedback_comments": E.feedback_comments(events),
        "agent_query_history": Q.agent_query_history(logs.query_log, as_of),
        "data_access_lineage": LN.data_access_lineage(logs.query_log, logs.access_log, as_of),
        "failed_queries_analysis": Q.failed_queries_analysis(logs.query_log, as_of),
        "user_activity_summary": Q.user_activity_summary(logs.query_log, as_of),
        "eval_conversations": E.eval_conversations(events),
        "conversation_corpus": SR.conversation_corpus(events),
        "evaluation_dataset": EV.evaluation_dataset(E.eval_conversations(events), as_of),
    }
    if policies is not None:
        views |= {"compliance_policies": policies, "policy_corpus": SR.policy_corpus(policies)}
    if notes is not None:
        views |= {"audit_notes": notes, "notes_corpus": SR.notes_corpus(notes)}
    if results is not None:
        views |= {"evaluation_results": results, "evaluation_parsed": EV.evaluation_parsed(results)}
    if history is not None:
        views["evaluation_history"] = history
    return views


def register_views(
    spark: SparkSession, logs: AuditLogs, as_of: datetime, events: DataFrame | None = None, **tables: DataFrame | None
) -> None:
    """Make the relations, the judges and the table functions available to ``spark.sql`` (see :func:`audit_views`)."""
    for name, relation in audit_views(logs, as_of, events, **tables).items():
        relation.createOrReplaceTempView(name)
    for function in TABLE_FUNCTIONS:
        spark.sql(function.format(as_of=as_of.isoformat(sep=" "), today=as_of.date().isoformat()))
    for judge in J.JUDGES:
        spark.sql(J.judge_function(judge))
    for corpus, text_column, attributes in SEARCHES:
        if tables.get("notes" if corpus == "notes_corpus" else "policies") is not None or corpus == "conversation_corpus":
            spark.sql(search_function(corpus, text_column, attributes))


SEARCHES = (
    ("conversation_corpus", "conversation_text", ("agent_name", "user_name", "thread_id", "feedback_sentiment")),
    ("policy_corpus", "policy_text", ("policy_name", "policy_category")),
    ("notes_corpus", "note_text", ("auditor_name", "investigation_id", "agent_name", "severity", "created_date")),
)


def search_function(corpus: str, text_column: str, attributes: tuple[str, ...]) -> str:
    """A table function ``search_<corpus>(query)``: all documents that score, best first.

    It ranks like ``search`` by a scan. Filters go into the WHERE and a number of rows into the
    LIMIT of the query around it; neither changes a score.
    """
    pattern = TOKEN_PATTERN.replace("\\", "\\\\")
    names = ", ".join(attributes)
    columns = ", ".join(f"{name} STRING" for name in attributes)
    return f"""
    CREATE OR REPLACE TEMPORARY FUNCTION search_{corpus}(p_query STRING)
    RETURNS TABLE (doc_id STRING, {columns}, {text_column} STRING, score DOUBLE)
    RETURN WITH words AS (
        SELECT doc_id, {names}, {text_column}, regexp_extract_all(lower({text_column}), '{pattern}', 0) AS said FROM {corpus}),
      hits AS (SELECT doc_id, size(said) AS length, inline(transform(
                 array_distinct(regexp_extract_all(lower(p_query), '{pattern}', 0)),
                 t -> named_struct('term', t, 'frequency', size(filter(said, w -> w = t))))) FROM words),
      counted AS (SELECT term, count(*) AS containing, (SELECT count(*) FROM {corpus}) AS documents,
                    (SELECT avg(size(regexp_extract_all(lower({text_column}), '{pattern}', 0))) FROM {corpus}) AS mean_length
                  FROM hits WHERE frequency > 0 GROUP BY term),
      scores AS (SELECT doc_id, round(sum(ln(1 + (documents - containing + 0.5D) / (containing + 0.5D)) * frequency * {K1 + 1}D
                   / (frequency + {K1}D * ({1 - B}D + {B}D * length / mean_length))), {SCORE_DIGITS}) AS score
                 FROM hits JOIN counted USING (term) WHERE frequency > 0 GROUP BY doc_id)
      SELECT doc_id, {names}, {text_column}, score FROM scores JOIN words USING (doc_id)
      ORDER BY score DESC, doc_id
    """
