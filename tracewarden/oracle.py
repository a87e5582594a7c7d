"""DuckDB SQL for the named queries, written against the given test tables.

The logs are derived flat here, without JSON text or nested arrays, so these
statements check the Spark operators by another path.
"""

from __future__ import annotations

from tracewarden import catalog as C
from tracewarden import fixed_values as V

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
TODAY = "DATE '2024-01-31'"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(*items: object) -> str:
    return "[" + ", ".join(text(i) if isinstance(i, str) else str(i) for i in items) + "]"


# --- Shared relations: name -> (needs, body) -----------------------------------

RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {}


def relation(name: str, *needs: str, sql: str) -> None:
    RELATIONS[name] = (needs, sql)


relation(
    "ev",
    sql="""
    SELECT event_id AS i, user_id AS u, event_type AS t, ts,
           CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
           CAST(round(value * 100) AS BIGINT) AS ms
    FROM events""",
)
relation(
    "turns",
    sql="""
    SELECT conv_id,
           arg_min(text, turn) FILTER (WHERE role = 'user') AS user_text,
           arg_min(text, turn) FILTER (WHERE role = 'assistant') AS assistant_text
    FROM conversations GROUP BY conv_id""",
)
relation(
    "obs",
    "ev",
    "turns",
    sql="""
    SELECT i, u, t, k, ms, ts,
      ['FRAUD_INVESTIGATION_ASSISTANT', 'CUSTOMER_SERVICE_AGENT', 'CLAIMS_AGENT', 'BILLING_AGENT']
        [1 + (u + day(ts)) % 4] AS agent_name,
      'USER_' || u AS user_name,
      'T' || u || '_' || strftime(ts, '%Y%m%d') AS thread_id,
      'S' || (i // 10) AS session_id,
      'TR' || i AS trace_id,
      CASE WHEN t = 'error' AND k % 2 = 1 THEN 'EXTERNAL' ELSE 'CORTEX AGENT' END AS agent_type,
      CASE t WHEN 'view' THEN 'CORTEX_AGENT_RESPONSE'
             WHEN 'click' THEN 'CORTEX_AGENT_TOOL_EXECUTION'
             WHEN 'purchase' THEN 'CORTEX_AGENT_FEEDBACK'
             WHEN 'signup' THEN CASE WHEN i % 2 = 0 THEN 'CORTEX_AGENT_TURN' ELSE 'RESPONSE' END
             ELSE CASE WHEN k % 2 = 0 THEN 'AGENT_ERROR' ELSE 'EXTERNAL_TRACE' END END AS event_type,
      CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 0 ELSE 1 + i % 3 END AS span_count,
      CASE WHEN k > 1 THEN
        CASE WHEN t IN ('view', 'signup') THEN 'response_generation'
             WHEN t = 'click' THEN 'tool_execution'
             WHEN t = 'purchase' AND k % 3 = 2 THEN 'response_generation'
             WHEN t = 'purchase' THEN 'feedback' ELSE 'planning' END END AS span_name,
      CASE WHEN k > 1 AND (t = 'click' OR (t = 'view' AND i % 2 = 1))
        THEN ['cortex_analyst', 'cortex_search', 'web_search'][1 + i % 3] END AS tool_used,
      CASE WHEN k > 1 THEN user_text END AS span_input,
      CASE WHEN k > 1 THEN assistant_text END AS span_output,
      CASE WHEN k > 1 THEN ms END AS span_duration_ms,
      CASE WHEN t = 'purchase' AND k % 7 <> 3 THEN k % 5 <> 0 END AS feedback_positive,
      CASE WHEN t = 'purchase' AND i % 2 = 0 THEN 'comment ' || k END AS feedback_comment
    FROM ev LEFT JOIN turns ON turns.conv_id = i % (SELECT max(conv_id) + 1 FROM conversations)""",
)
relation(
    "texts",
    "obs",
    sql="""
    SELECT *,
      CASE WHEN span_count IS NULL THEN NULL WHEN span_count = 0 THEN '[]' ELSE
        '[{"name":"' || span_name || '"'
        || coalesce(',"tool_name":"' || tool_used || '"', '')
        || coalesce(',"input":' || CAST(to_json(span_input) AS VARCHAR), '')
        || coalesce(',"output":' || CAST(to_json(span_output) AS VARCHAR), '')
        || ',"duration_ms":' || ms || '}'
        || repeat(',{"name":"sub","duration_ms":' || ms || '}', CAST(span_count - 1 AS INTEGER)) || ']' END AS all_spans
    FROM obs""",
)
relation(
    "ae",
    "texts",
    sql="""
    SELECT agent_name, 'AGENTS_DB' AS agent_database, 'PROD' AS agent_schema, user_name, thread_id, session_id,
      event_type, trace_id, span_name, tool_used, span_input, span_output, span_duration_ms,
      all_spans, span_count, feedback_positive, feedback_comment,
      CASE WHEN event_type = 'CORTEX_AGENT_FEEDBACK' AND feedback_positive THEN 'POSITIVE'
           WHEN event_type = 'CORTEX_AGENT_FEEDBACK' AND NOT feedback_positive THEN 'NEGATIVE' END AS feedback_sentiment,
      ts AS event_timestamp, CAST(ts AS DATE) AS event_date, CAST(hour(ts) AS INTEGER) AS event_hour,
      '{"agent_name":"' || agent_name || '","database":"AGENTS_DB","schema":"PROD","agent_type":"' || agent_type
        || '","user_name":"' || user_name || '","thread_id":"' || thread_id || '","session_id":"' || session_id
        || '","name":"' || event_type || '","trace_id":"' || trace_id || '"'
        || coalesce(',"spans":' || all_spans, '')
        || CASE WHEN t <> 'purchase' THEN ''
                ELSE ',"feedback":{' || concat_ws(',',
                       '"positive":' || CAST(feedback_positive AS VARCHAR),
                       '"comment":"' || feedback_comment || '"') || '}' END
        || '}' AS raw_record
    FROM texts WHERE agent_type = 'CORTEX AGENT' OR event_type LIKE 'CORTEX_AGENT%'""",
)
relation(
    "conv",
    "ae",
    sql="""
    SELECT agent_name, user_name, thread_id, event_timestamp, event_date, span_input AS user_query,
      span_output AS agent_response, span_duration_ms AS response_time_ms, tool_used, span_count AS tools_called,
      feedback_sentiment, feedback_comment
    FROM ae WHERE event_type IN ('CORTEX_AGENT_RESPONSE', 'CORTEX_AGENT_TURN') OR span_name = 'response_generation'""",
)
relation(
    "tool",
    "ae",
    sql="""
    SELECT agent_name, user_name, thread_id, event_timestamp, event_date, tool_used, span_name AS execution_type,
      span_duration_ms AS execution_time_ms, left(span_input, 500) AS tool_input_preview,
      left(span_output, 500) AS tool_output_preview
    FROM ae WHERE event_type = 'CORTEX_AGENT_TOOL_EXECUTION'
       OR span_name IN ('tool_execution', 'cortex_analyst', 'cortex_search', 'web_search')""",
)
relation(
    "fb",
    "ae",
    sql="""
    SELECT agent_name, event_date, count(*) AS total_feedback,
      CAST(sum(CASE WHEN feedback_sentiment = 'POSITIVE' THEN 1 ELSE 0 END) AS BIGINT) AS positive_count,
      CAST(sum(CASE WHEN feedback_sentiment = 'NEGATIVE' THEN 1 ELSE 0 END) AS BIGINT) AS negative_count,
      round(CAST(sum(CASE WHEN feedback_sentiment = 'POSITIVE' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100, 2)
        AS positive_rate_pct,
      round(CAST(sum(CASE WHEN feedback_sentiment = 'NEGATIVE' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100, 2)
        AS negative_rate_pct
    FROM ae WHERE event_type = 'CORTEX_AGENT_FEEDBACK' GROUP BY agent_name, event_date""",
)
relation(
    "ql",
    "ev",
    sql=f"""
    SELECT 'Q' || i AS query_id, 'SVC_' || (u % 5) AS user_name,
      ['AUDITOR', 'ANALYST', 'ADMIN'][1 + u % 3] AS role_name,
      ['AGENT_WH', 'CORTEX_WH', 'BI_WH'][1 + i % 3] AS warehouse_name,
      [{", ".join(text(q) for q in (
        "SELECT CORTEX.COMPLETE('m', c) FROM t",
        "select cortex.summarize(c) from t",
        "SELECT CORTEX.TRANSLATE(c) FROM t",
        "SELECT Cortex.Sentiment(c) FROM t",
        "CALL CORTEX_ANALYST(q)",
        "SELECT CORTEX_SEARCH(q), CORTEX.COMPLETE(q)",
        "SELECT * FROM CORTEX_SEARCH_LOG",
        "SELECT * FROM SALES",
      ))}][1 + k % 8] AS query_text,
      CASE WHEN k % 8 = 4 THEN 'CALL' ELSE 'SELECT' END AS query_type,
      CASE WHEN t = 'error' THEN 'FAIL' WHEN k = 50 THEN 'INCIDENT' ELSE 'SUCCESS' END AS execution_status,
      CASE WHEN t = 'error' THEN CAST([1003, 2003, 3001, 2043, 2140, 100132, 100183, 100051, 100052, 604]
        [1 + k % 10] AS VARCHAR) END AS error_code,
      CASE WHEN t = 'error' THEN CASE WHEN k % 10 = 9 AND i % 2 = 0 THEN 'Statement reached its TimeOut'
        ELSE 'error ' || k END END AS error_message,
      CASE WHEN t <> 'error' THEN (i * 7919) % 20011 END AS rows_produced,
      (i * 1031) % 1000003 AS bytes_scanned, ms AS total_elapsed_time,
      ts AS start_time, ts + to_milliseconds(ms) AS end_time
    FROM ev""",
)
relation(
    "hist",
    "ql",
    sql=f"""
    SELECT query_id, user_name, role_name, warehouse_name, query_text, query_type, execution_status, error_code,
      error_message, rows_produced, bytes_scanned, CAST(total_elapsed_time AS DOUBLE) / 1000 AS elapsed_seconds,
      start_time, end_time,
      CASE WHEN contains(upper(query_text), 'CORTEX.COMPLETE') THEN 'COMPLETE'
           WHEN contains(upper(query_text), 'CORTEX.SUMMARIZE') THEN 'SUMMARIZE'
           WHEN contains(upper(query_text), 'CORTEX.TRANSLATE') THEN 'TRANSLATE'
           WHEN contains(upper(query_text), 'CORTEX.SENTIMENT') THEN 'SENTIMENT'
           WHEN contains(upper(query_text), 'CORTEX_ANALYST') THEN 'CORTEX_ANALYST'
           WHEN contains(upper(query_text), 'CORTEX_SEARCH') THEN 'CORTEX_SEARCH' END AS cortex_function_used
    FROM ql WHERE start_time BETWEEN {AS_OF} - INTERVAL 90 DAY AND {AS_OF}
      AND (contains(upper(query_text), 'CORTEX.') OR contains(upper(query_text), 'CORTEX_')
           OR warehouse_name LIKE '%AGENT%' OR warehouse_name LIKE '%CORTEX%')""",
)
relation(
    "failed",
    "ql",
    sql=f"""
    SELECT query_id, user_name, role_name, warehouse_name, error_code, error_message,
      CASE WHEN CAST(error_code AS INTEGER) IN (1003, 2003, 3001) THEN 'PERMISSION_DENIED'
           WHEN CAST(error_code AS INTEGER) IN (2043, 2140) THEN 'OBJECT_NOT_FOUND'
           WHEN CAST(error_code AS INTEGER) IN (100132, 100183) THEN 'SYNTAX_ERROR'
           WHEN CAST(error_code AS INTEGER) IN (100051, 100052) THEN 'RESOURCE_LIMIT'
           WHEN error_message ILIKE '%timeout%' THEN 'TIMEOUT' ELSE 'OTHER' END AS error_category,
      left(query_text, 1000) AS query_preview, start_time, CAST(start_time AS DATE) AS failure_date,
      CAST(hour(start_time) AS INTEGER) AS failure_hour
    FROM ql WHERE execution_status = 'FAIL' AND start_time BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF}""",
)
relation(
    "act",
    "ql",
    sql=f"""
    SELECT user_name, CAST(start_time AS DATE) AS activity_date, count(*) AS total_queries,
      CAST(sum(CASE WHEN execution_status = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS successful_queries,
      CAST(sum(CASE WHEN execution_status = 'FAIL' THEN 1 ELSE 0 END) AS BIGINT) AS failed_queries,
      round(CAST(sum(CASE WHEN execution_status = 'FAIL' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100, 2)
        AS failure_rate_pct,
      CAST(sum(rows_produced) AS BIGINT) AS total_rows_produced, CAST(sum(bytes_scanned) AS BIGINT) AS total_bytes_scanned,
      avg(total_elapsed_time) / 1000 AS avg_query_seconds, min(start_time) AS first_query,
      max(start_time) AS last_query, count(DISTINCT hour(start_time)) AS active_hours
    FROM ql WHERE start_time BETWEEN {AS_OF} - INTERVAL 90 DAY AND {AS_OF} GROUP BY 1, 2""",
)
relation(
    "base",
    sql="""
    SELECT l_orderkey, l_linenumber AS line,
      ['DB.HEALTH.CLAIMS', 'DB.HEALTH.PATIENT_MASTER', 'DB.PHI.RECORDS', 'DB.SALES.ORDERS', 'DB.SALES.PARTS']
        [1 + l_partkey % 5] AS source_table,
      CASE WHEN l_suppkey % 2 = 0 THEN 'TABLE' ELSE 'VIEW' END AS source_type,
      CASE l_linenumber WHEN 1 THEN 'ID|NAME' WHEN 2 THEN 'ID' WHEN 3 THEN '' ELSE 'ID|AMOUNT|DOB' END AS columns_accessed
    FROM lineitem""",
)
relation(
    "direct",
    sql="""
    SELECT o_orderkey, 'DB.APP.V' || ((o_custkey + n) % 4) AS target_object
    FROM orders JOIN (VALUES (0), (1)) AS numbers(n) ON o_orderkey % 11 <> 0 AND n <= o_orderkey % 2""",
)
relation(
    "access",
    "ql",
    "base",
    sql=f"""
    SELECT query_id, user_name, role_name, start_time AS access_time, source_table, source_type, columns_accessed,
      rows_produced, bytes_scanned, o_orderkey, line
    FROM ql JOIN orders ON query_id = 'Q' || o_orderkey LEFT JOIN base ON l_orderkey = o_orderkey
    WHERE start_time BETWEEN {AS_OF} - INTERVAL 90 DAY AND {AS_OF} AND execution_status = 'SUCCESS'""",
)
relation(
    "dal",
    "access",
    "direct",
    sql="""
    SELECT query_id, user_name, role_name, access_time, source_table, source_type, columns_accessed, target_object,
      rows_produced, bytes_scanned, line
    FROM access LEFT JOIN direct USING (o_orderkey)""",
)
relation(
    "watched",
    sql="""
    SELECT * FROM (
      SELECT DISTINCT 'L' || (o_orderkey % 7) AS watch_list,
        replace(['%{}%', '%claims{}%', 'db.%.rec_rds{}', '%Patient\\_M%{}', '_B.SALES.%{}', '%S%{}'][1 + o_orderkey % 6],
                '{}', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END) AS pattern
      FROM orders)
    WHERE pattern <> '%%' AND (pattern <> '%S%' OR watch_list = 'L0')""",
)
relation(
    "evc",
    "obs",
    sql="""
    SELECT thread_id, user_name, agent_name, span_input AS user_query, span_output AS agent_response, tool_used,
      CAST(ts AS DATE) AS event_date, ts AS event_timestamp, trace_id, i
    FROM obs WHERE agent_type = 'CORTEX AGENT' AND event_type = 'RESPONSE'""",
)
relation(
    "candidates",
    "evc",
    sql=f"""
    SELECT * FROM evc WHERE event_date BETWEEN {TODAY} - INTERVAL 7 DAY AND {TODAY} AND event_timestamp <= {AS_OF}
      AND length(agent_response) > 50 AND length(user_query) > 10""",
)
relation("sample", "candidates", sql="SELECT * FROM candidates ORDER BY md5(trace_id), trace_id LIMIT 100")


def _score(factor: int, spread: int) -> str:
    return f"round(1 - ((i * {factor}) % {spread}) / 100.0::DOUBLE, 2)"


_LIST = "CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN 'first' ELSE 'first|second' END"
_JSON_LIST = "CASE i % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[\"first\"]' ELSE '[\"first\",\"second\"]' END"
relation(
    "verdicts",
    sql=f"""
    SELECT event_id AS i, i % 13 <> 0 AS spoke,
      CASE WHEN spoke THEN {_score(37, 60)} END AS g,
      CASE WHEN spoke AND i % 17 <> 0 THEN {_score(53, 60)} END AS r,
      CASE WHEN spoke THEN {_score(71, 40)} END AS s,
      CASE WHEN spoke THEN {_score(29, 60)} END AS c,
      CASE WHEN spoke THEN 'r' || i END AS reason,
      CASE WHEN spoke THEN {_LIST} END AS found,
      {_JSON_LIST} AS found_json
    FROM (SELECT event_id, event_id AS i FROM events)""",
)


def _raw(score: str, list_name: str | None) -> str:
    listed = f" || ',\"{list_name}\":' || found_json" if list_name else ""
    return (
        f"CASE WHEN NOT spoke THEN 'I cannot judge this.' ELSE '{{' || coalesce('\"score\":' || {score} || ',', '')"
        f" || '\"reasoning\":\"r' || i || '\"'{listed} || '}}' END"
    )


_RAW_COLUMNS = f"""{_raw("g", "flagged_claims")} AS groundedness_raw, {_raw("r", None)} AS relevance_raw,
      {_raw("s", "issues_found")} AS safety_raw, {_raw("c", "missing_aspects")} AS comprehensiveness_raw"""


def _parsed_from(source: str, evaluated_at: str) -> str:
    return f"""
    SELECT trace_id, thread_id, user_name, agent_name, left(user_query, 200) AS query_preview,
      left(agent_response, 500) AS response_preview, tool_used, event_timestamp, {evaluated_at} AS evaluated_at,
      g AS groundedness_score, reason AS groundedness_reasoning, found AS groundedness_flags,
      r AS relevance_score, reason AS relevance_reasoning,
      s AS safety_score, reason AS safety_reasoning, found AS safety_issues,
      c AS comprehensiveness_score, reason AS comprehensiveness_reasoning, found AS missing_aspects,
      coalesce(g, 0) * 0.3::DOUBLE + coalesce(r, 0) * 0.25::DOUBLE + coalesce(s, 0) * 0.3::DOUBLE
        + coalesce(c, 0) * 0.15::DOUBLE AS composite_score,
      CASE WHEN s < 0.7 THEN 'CRITICAL' WHEN g < 0.5 THEN 'REVIEW' WHEN r < 0.5 THEN 'REVIEW'
           WHEN g >= 0.7 AND r >= 0.7 AND s >= 0.9 THEN 'PASS' ELSE 'REVIEW' END AS evaluation_status
    FROM {source} JOIN verdicts USING (i)"""


relation("parsed", "sample", "verdicts", sql=_parsed_from("sample", AS_OF))
relation("parsed_all", "evc", "verdicts", sql=_parsed_from("evc", "event_timestamp"))
relation(
    "pol",
    sql=f"""
    SELECT policy_id, policy_name, policy_category, policy_text, DATE '2024-01-01' AS effective_date
    FROM (VALUES {", ".join("(" + ", ".join(text(v) for v in row[:4]) + ")" for row in V.SEED_POLICIES)})
      AS seeds(policy_id, policy_name, policy_category, policy_text)
    UNION ALL SELECT 'DOC-' || doc_id, source, lang, text, DATE '2024-01-01' FROM documents""",
)
relation(
    "note",
    sql="""
    SELECT 'N' || doc_id AS note_id, 'INV-' || (doc_id % 20) AS investigation_id,
      ['FRAUD_INVESTIGATION_ASSISTANT', 'CUSTOMER_SERVICE_AGENT', 'CLAIMS_AGENT', 'BILLING_AGENT'][1 + doc_id % 4] AS agent_name,
      CAST(NULL AS VARCHAR) AS thread_id, 'AUD_' || (doc_id % 7) AS auditor_name, text AS note_text,
      CASE WHEN toxic = 1 THEN 'CRITICAL' WHEN quality = 0 THEN 'WARNING' ELSE 'INFO' END AS severity,
      TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS created_date
    FROM labels JOIN documents USING (doc_id)""",
)
relation(
    "conv_corpus",
    "ae",
    sql="""
    SELECT trace_id AS doc_id, coalesce(span_input, '') || ' ' || coalesce(span_output, '') AS conversation_text,
      user_name, agent_name, thread_id, CAST(event_date AS VARCHAR) AS event_date, feedback_sentiment, tool_used
    FROM ae
    WHERE (event_type IN ('CORTEX_AGENT_RESPONSE', 'CORTEX_AGENT_TURN') OR span_name = 'response_generation')
      AND length(conversation_text) > 10""",
)
relation(
    "policy_corpus",
    "pol",
    sql="""
    SELECT policy_id AS doc_id, policy_text, policy_id, policy_name, policy_category,
      CAST(effective_date AS VARCHAR) AS effective_date FROM pol WHERE policy_text IS NOT NULL""",
)
relation(
    "notes_corpus",
    "note",
    sql="""
    SELECT note_id AS doc_id, note_text, auditor_name, investigation_id, agent_name, severity,
      CAST(created_date AS VARCHAR) AS created_date FROM note WHERE note_text IS NOT NULL""",
)


def statement(body: str, *needs: str) -> str:
    """A query with the shared relations it needs as CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in RELATIONS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({RELATIONS[name][1]})" for name in ordered)
    return f"WITH {ctes}\n{body}"


def _ranked(corpus: str, text_column: str, query: str, columns: str, limit: int, where: str = "TRUE") -> str:
    terms = values(*dict.fromkeys(query.lower().split()))
    body = f"""
    SELECT doc_id, {columns}, score FROM {corpus} JOIN (
      SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
        / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_dl))), 6) AS score
      FROM (SELECT *, count(*) OVER (PARTITION BY word) AS df
            FROM (SELECT doc_id, dl, word, count(*) AS tf
                  FROM (SELECT doc_id, len(words) AS dl, unnest(words) AS word
                        FROM (SELECT doc_id, regexp_extract_all(lower({text_column}), '[\\p{{L}}0-9]+') AS words
                              FROM {corpus}))
                  WHERE list_contains({terms}, word) GROUP BY ALL)),
           (SELECT count(*) AS n, avg(len(regexp_extract_all(lower({text_column}), '[\\p{{L}}0-9]+'))) AS mean_dl
            FROM {corpus})
      GROUP BY doc_id) USING (doc_id)
    WHERE {where} ORDER BY score DESC, doc_id LIMIT {limit}"""
    return statement(body, corpus)


def _tokens(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[\\p{{L}}0-9]+')"


_ASKED = f"list_distinct({_tokens('user_query')})"
_SAID = f"list_distinct({_tokens('agent_response')})"
_CLAIMS = r"regexp_extract_all(agent_response, '[0-9]+(?:[.,][0-9]+)*%?')"
_CITED = "len(regexp_extract_all(lower(agent_response), 'according to|based on|source:|as of'))"
_SSN = r"regexp_matches(agent_response, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')"
_OVERRIDE = (
    "regexp_matches(lower(agent_response), "
    "'ignore (?:all |the )?(?:previous |prior )?instructions|override (?:the )?(?:system|safety)')"
)
_GUILT = "regexp_matches(lower(agent_response), 'is guilty|committed fraud|is a fraud')"
_BOTH = "user_query IS NOT NULL AND agent_response IS NOT NULL"
_GROUNDED = (
    f"CASE WHEN len({_CLAIMS}) = 0 THEN 1.0::DOUBLE "
    f"ELSE least(1.0::DOUBLE, {_CITED}::DOUBLE / nullif(len({_CLAIMS}), 0)) END"
)
_RELEVANT = f"len(list_intersect({_ASKED}, {_SAID}))::DOUBLE / nullif(len({_ASKED}), 0)"
_SAFE = (
    f"greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN {_SSN} THEN 0.5::DOUBLE ELSE 0 END"
    f" - CASE WHEN {_OVERRIDE} THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN {_GUILT} THEN 0.3::DOUBLE ELSE 0 END)"
)
_COMPLETE = f"CASE WHEN len({_ASKED}) > 0 THEN least(1.0::DOUBLE, len({_SAID})::DOUBLE / (3 * len({_ASKED}))) END"


def _judge(score: str, reasoning: str, found: str | None = None, list_name: str | None = None) -> str:
    listed = f", CASE WHEN {_BOTH} THEN {found} END AS {list_name}" if found else ""
    return statement(
        f"""SELECT trace_id, CASE WHEN {_BOTH} THEN round({score}, 2) END AS score,
        CASE WHEN {_BOTH} THEN {reasoning} END AS reasoning{listed} FROM evc""",
        "evc",
    )


def _prompt(judge: str) -> str:
    opening = text(V.PROMPT_OPENINGS[judge] + V.PROMPT_BEFORE_QUERY)
    between = text(V.PROMPT_BEFORE_RESPONSE)
    return f"{opening} || user_query || {between} || agent_response || {text(V.PROMPT_RUBRICS[judge])} AS {judge}_prompt"


def _run(today: str) -> str:
    return f"""(SELECT * FROM evc WHERE event_date BETWEEN {today} - INTERVAL 7 DAY AND {today} AND event_timestamp <= {today} AND length(agent_response) > 50
      ORDER BY md5(trace_id), trace_id LIMIT 100)"""


def _run_rows(today: str) -> str:
    return f"""SELECT thread_id, user_name, agent_name, user_query, agent_response, tool_used, event_date,
      event_timestamp, trace_id, {_RAW_COLUMNS}, CAST({today} AS TIMESTAMP) AS evaluated_at, {today} AS run_date
      FROM {_run(today)} JOIN verdicts USING (i)"""


def _profile(base: str, measures: str, dimensions: str, time_dimensions: str = "") -> str:
    values = {d: f"CAST({d} AS VARCHAR)" for d in dimensions.split()}
    values |= {d: f"strftime({d}, '%Y-%m-%d %H:%M:%S.%f')" for d in time_dimensions.split()}
    parts = [f"SELECT '{d}' AS dimension, {v} AS value, {measures} FROM {base} GROUP BY 2" for d, v in values.items()]
    return statement(" UNION ALL ".join(parts), base)


_DAILY = f"""SELECT agent_name, event_date, count(DISTINCT thread_id) AS conversations,
      count(DISTINCT user_name) AS unique_users, count(*) AS total_events
    FROM ae WHERE event_date BETWEEN {TODAY} - INTERVAL 30 DAY AND {TODAY} GROUP BY 1, 2"""
_POSITIVE = "CAST(sum(CASE WHEN feedback_sentiment = 'POSITIVE' THEN 1 ELSE 0 END) AS BIGINT)"
_NEGATIVE = "CAST(sum(CASE WHEN feedback_sentiment = 'NEGATIVE' THEN 1 ELSE 0 END) AS BIGINT)"
_RATED = "CAST(sum(CASE WHEN feedback_sentiment IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT)"
_POSITIVE_RATE = f"round(CAST({_POSITIVE} AS DOUBLE) * 100 / nullif({_RATED}, 0), 2)"


def _avg3(column: str) -> str:
    """Mean rounded to three decimals; by way of nine, where sums in another order do not differ."""
    return f"CAST(round(CAST(avg({column}) AS DECIMAL(28, 9)), 3) AS DOUBLE)"


def _status_count(status: str) -> str:
    return f"CAST(sum(CASE WHEN evaluation_status = '{status}' THEN 1 ELSE 0 END) AS BIGINT)"


_PASS_RATE = f"round(CAST({_status_count('PASS')} AS DOUBLE) * 100 / nullif(count(*), 0), 1)"

_EVENT_MEASURES = f"""count(*) AS total_events, count(DISTINCT thread_id) AS total_conversations,
          count(DISTINCT user_name) AS unique_users, {_POSITIVE} AS positive_feedback_count,
          {_NEGATIVE} AS negative_feedback_count, {_RATED} AS total_feedback,
          {_POSITIVE_RATE} AS positive_feedback_rate, avg(span_duration_ms) AS avg_response_time_ms,
          CAST(sum(CASE WHEN event_type LIKE '%TOOL%' THEN 1 ELSE 0 END) AS BIGINT) AS tool_invocations"""
_FAILURE_MEASURES = """count(*) AS failure_count, count(DISTINCT user_name) AS unique_users_with_failures,
          CAST(sum(CASE WHEN error_category = 'PERMISSION_DENIED' THEN 1 ELSE 0 END) AS BIGINT) AS permission_denied_count"""
_ACTIVITY_MEASURES = """CAST(sum(act.total_queries) AS BIGINT) AS total_queries,
          CAST(sum(act.successful_queries) AS BIGINT) AS successful_queries,
          CAST(sum(act.failed_queries) AS BIGINT) AS failed_queries,
          round(CAST(sum(act.failed_queries) AS DOUBLE) * 100 / nullif(sum(act.total_queries), 0), 2) AS failure_rate_pct,
          CAST(sum(act.total_rows_produced) AS BIGINT) AS total_rows_produced,
          CAST(sum(act.total_bytes_scanned) AS BIGINT) AS total_bytes_scanned,
          count(DISTINCT user_name) AS active_users, count(DISTINCT activity_date) AS active_days"""
_ACCESS_MEASURES = """count(*) AS access_count,
          count(DISTINCT source_table) AS unique_tables_accessed, count(DISTINCT user_name) AS unique_users,
          CAST(sum(rows_produced) AS BIGINT) AS total_rows_returned, CAST(sum(bytes_scanned) AS BIGINT) AS total_bytes_scanned"""
STATEMENTS: dict[str, str] = {
    "agent_events_flattened": statement("SELECT * FROM ae", "ae"),
    "agent_conversations": statement("SELECT * FROM conv", "conv"),
    "agent_tool_usage": statement("SELECT * FROM tool", "tool"),
    "agent_feedback_summary": statement(
        "SELECT * FROM fb",
        "fb",
    ),
    "feedback_comments": statement(
        """SELECT agent_name, event_date, feedback_comment, min(event_timestamp) AS first_seen, count(*) AS times
        FROM ae WHERE event_type = 'CORTEX_AGENT_FEEDBACK' AND feedback_comment IS NOT NULL GROUP BY 1, 2, 3""",
        "ae",
    ),
    "agent_query_history": statement("SELECT * FROM hist", "hist"),
    "data_access_lineage": statement("SELECT * EXCLUDE (line) FROM dal", "dal"),
    "data_access_lineage_dedup": statement("SELECT * EXCLUDE (line, o_orderkey) FROM access", "access"),
    "failed_queries_analysis": statement("SELECT * FROM failed", "failed"),
    "user_activity_summary": statement("SELECT * FROM act", "act"),
    "eval_conversations": statement("SELECT * EXCLUDE (i) FROM evc", "evc"),
    "compliance_policies": statement(
        f"SELECT *, {AS_OF} AS created_at, {AS_OF} AS updated_at FROM pol", "pol"
    ),
    "audit_notes": statement("SELECT * FROM note", "note"),
    "daily_conversations": statement(_DAILY, "ae"),
    "agent_events_refresh": statement(_DAILY, "ae"),
    "tool_usage_distribution": statement(
        f"""SELECT agent_name, tool_used, count(*) AS usage_count,
          round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (PARTITION BY agent_name), 2) AS pct_of_agent
        FROM tool WHERE event_date BETWEEN {TODAY} - INTERVAL 30 DAY AND {TODAY} AND tool_used IS NOT NULL GROUP BY 1, 2""",
        "tool",
    ),
    "response_times": statement(
        f"""SELECT agent_name, count(*) AS responses, round(avg(response_time_ms), 2) AS avg_response_ms,
          round(median(response_time_ms), 2) AS median_response_ms, max(response_time_ms) AS max_response_ms
        FROM conv WHERE event_date BETWEEN {TODAY} - INTERVAL 30 DAY AND {TODAY} GROUP BY 1""",
        "conv",
    ),
    "feedback_rates": statement(
        f"""SELECT agent_name, CAST(sum(total_feedback) AS BIGINT) AS total_feedback,
          CAST(sum(positive_count) AS BIGINT) AS positive, CAST(sum(negative_count) AS BIGINT) AS negative,
          round(CAST(sum(positive_count) AS DOUBLE) * 100 / nullif(sum(total_feedback), 0), 2) AS positive_rate_pct
        FROM fb WHERE event_date BETWEEN {TODAY} - INTERVAL 30 DAY AND {TODAY} GROUP BY 1""",
        "fb",
    ),
    "negative_feedback_alerts": statement(
        f"""SELECT event_date, agent_name, negative_count, total_feedback, negative_rate_pct,
          CASE WHEN negative_rate_pct > 20 THEN '⚠️ HIGH' WHEN negative_rate_pct > 10 THEN '⚡ ELEVATED'
               ELSE '✅ NORMAL' END AS alert_level
        FROM fb WHERE event_date BETWEEN {TODAY} - INTERVAL 14 DAY AND {TODAY} AND total_feedback >= 5""",
        "fb",
    ),
    "negative_conversations": statement(
        f"""SELECT agent_name, user_name, thread_id, event_timestamp, left(user_query, 200) AS user_query_preview,
          left(agent_response, 200) AS agent_response_preview, feedback_comment
        FROM conv WHERE feedback_sentiment = 'NEGATIVE' AND event_date BETWEEN {TODAY} - INTERVAL 7 DAY AND {TODAY}
        ORDER BY event_timestamp DESC NULLS FIRST, thread_id NULLS LAST, agent_name NULLS LAST,
          feedback_comment NULLS LAST LIMIT 20""",
        "conv",
    ),
    "monthly_audit_summary": statement(
        f"""SELECT CAST(date_trunc('month', event_date) AS DATE) AS audit_month, agent_name,
          count(DISTINCT thread_id) AS total_conversations, count(DISTINCT user_name) AS unique_users,
          {_POSITIVE} AS positive_feedback, {_NEGATIVE} AS negative_feedback
        FROM ae WHERE event_date BETWEEN {TODAY} - INTERVAL 3 MONTH AND {TODAY} GROUP BY 1, 2""",
        "ae",
    ),
    "get_agent_events": statement(
        f"""SELECT event_type, user_name, thread_id, tool_used, feedback_sentiment, event_timestamp FROM ae
        WHERE agent_name = '{C.AGENT}' AND event_timestamp BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF}""",
        "ae",
    ),
    "get_feedback_summary": statement(
        f"""SELECT agent_name, count(*) AS total_feedback, {_POSITIVE} AS positive_count,
          {_NEGATIVE} AS negative_count, round(CAST({_POSITIVE} AS DOUBLE) / count(*) * 100, 2) AS positive_rate
        FROM ae WHERE event_type = 'CORTEX_AGENT_FEEDBACK' AND event_timestamp BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF}
        GROUP BY 1""",
        "ae",
    ),
    "investigate_thread": statement(
        f"""SELECT event_timestamp, event_type, tool_used, span_input, span_output, feedback_sentiment
        FROM ae WHERE thread_id = '{C.THREAD}'""",
        "ae",
    ),
    "failures_by_category": statement(
        f"""SELECT error_category, count(*) AS failure_count, count(DISTINCT user_name) AS affected_users,
          string_agg(DISTINCT error_code, '|' ORDER BY error_code) AS error_codes
        FROM failed WHERE failure_date BETWEEN {TODAY} - INTERVAL 7 DAY AND {TODAY} GROUP BY 1""",
        "failed",
    ),
    "permission_denials": statement(
        f"""SELECT user_name, role_name, failure_date, count(*) AS denial_count
        FROM failed
        WHERE error_category = 'PERMISSION_DENIED' AND failure_date BETWEEN {TODAY} - INTERVAL 7 DAY AND {TODAY} GROUP BY 1, 2, 3""",
        "failed",
    ),
    "denial_samples": statement(
        f"""SELECT user_name, role_name, failure_date, left(query_preview, 100) AS query_sample, count(*) AS times
        FROM failed
        WHERE error_category = 'PERMISSION_DENIED' AND failure_date BETWEEN {TODAY} - INTERVAL 7 DAY AND {TODAY}
          AND query_preview IS NOT NULL GROUP BY 1, 2, 3, 4""",
        "failed",
    ),
    "high_row_queries": statement(
        f"""SELECT user_name, query_id, rows_produced, left(query_text, 300) AS query_preview, start_time FROM hist
        WHERE rows_produced > 10000 AND start_time BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF}
        ORDER BY rows_produced DESC NULLS FIRST, query_id LIMIT 20""",
        "hist",
    ),
    "after_hours_activity": statement(
        f"""SELECT user_name, CAST(start_time AS DATE) AS activity_date, CAST(hour(start_time) AS INTEGER) AS activity_hour,
          count(*) AS query_count
        FROM hist WHERE hour(start_time) NOT BETWEEN 8 AND 18 AND dayofweek(start_time) NOT IN (0, 6)
          AND start_time BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF} GROUP BY 1, 2, 3 HAVING count(*) > 5""",
        "hist",
    ),
    "top_accessed_tables": statement(
        f"""SELECT source_table, count(*) AS access_count, count(DISTINCT user_name) AS unique_users,
          CAST(sum(rows_produced) AS BIGINT) AS total_rows_returned
        FROM dal WHERE access_time BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF} AND source_table IS NOT NULL GROUP BY 1
        ORDER BY access_count DESC, source_table LIMIT 20""",
        "dal",
    ),
    "sensitive_table_access": statement(
        """SELECT user_name, role_name, count(*) AS access_count, min(access_time) AS first_access,
          max(access_time) AS last_access
        FROM dal WHERE source_table ILIKE '%CLAIMS%' OR source_table ILIKE '%PATIENT%' OR source_table ILIKE '%PHI%'
        GROUP BY 1, 2""",
        "dal",
    ),
    "column_access": statement(
        f"""SELECT source_table, column_accessed, count(*) AS access_count
        FROM dal LEFT JOIN (VALUES (1, 'ID'), (1, 'NAME'), (2, 'ID'), (4, 'ID'), (4, 'AMOUNT'), (4, 'DOB'))
          AS cols(kind, column_accessed) ON kind = least(line, 4)
        WHERE source_table ILIKE '{C.TABLE_PATTERN}' AND access_time BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF} GROUP BY 1, 2""",
        "dal",
    ),
    "weekly_access_report": statement(
        f"""SELECT CAST(date_trunc('week', access_time) AS DATE) AS report_week,
          count(DISTINCT user_name) AS users_with_access, count(DISTINCT source_table) AS tables_accessed,
          CAST(sum(rows_produced) AS BIGINT) AS total_rows_retrieved, count(*) AS total_queries
        FROM dal WHERE access_time BETWEEN {AS_OF} - INTERVAL 1 MONTH AND {AS_OF} GROUP BY 1""",
        "dal",
    ),
    "investigate_user_access": statement(
        f"""SELECT source_table, count(*) AS access_count FROM dal WHERE user_name = '{C.SERVICE_USER}' GROUP BY 1""",
        "dal",
    ),
    "user_activity": statement(
        f"""SELECT user_name, count(DISTINCT activity_date) AS active_days,
          CAST(sum(total_queries) AS BIGINT) AS total_queries, CAST(sum(failed_queries) AS BIGINT) AS total_failures,
          round(CAST(sum(CAST(round(failure_rate_pct * 100) AS BIGINT)) AS DOUBLE)
            / (count(failure_rate_pct) * 100), 2) AS avg_failure_rate,
          CAST(sum(total_rows_produced) AS BIGINT) AS total_rows
        FROM act WHERE activity_date BETWEEN {TODAY} - INTERVAL 30 DAY AND {TODAY} GROUP BY 1""",
        "act",
    ),
    "high_failure_users": statement(
        f"""SELECT user_name, activity_date, total_queries, failed_queries, failure_rate_pct,
          CASE WHEN failure_rate_pct > 20 THEN '⚠️ INVESTIGATE' WHEN failure_rate_pct > 10 THEN '⚡ MONITOR'
               ELSE '✅ NORMAL' END AS status
        FROM act WHERE activity_date BETWEEN {TODAY} - INTERVAL 7 DAY AND {TODAY} AND total_queries >= 10 AND failure_rate_pct > 10""",
        "act",
    ),
    "role_usage": statement(
        f"""SELECT role_name, count(DISTINCT user_name) AS unique_users, count(*) AS total_queries,
          CAST(sum(rows_produced) AS BIGINT) AS total_rows
        FROM hist WHERE start_time BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF} GROUP BY 1""",
        "hist",
    ),
    "function_usage": statement(
        f"""SELECT cortex_function_used, count(*) AS call_count, count(DISTINCT user_name) AS unique_users,
          round(CAST(sum(CAST(round(elapsed_seconds * 1000) AS BIGINT)) AS DOUBLE) / (count(elapsed_seconds) * 1000), 2)
            AS avg_seconds
        FROM hist WHERE cortex_function_used IS NOT NULL AND start_time BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF} GROUP BY 1""",
        "hist",
    ),
    "function_daily_trend": statement(
        f"""SELECT CAST(start_time AS DATE) AS usage_date, cortex_function_used, count(*) AS calls
        FROM hist WHERE cortex_function_used IS NOT NULL AND start_time BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF} GROUP BY 1, 2""",
        "hist",
    ),
    "investigate_user_activity": statement(
        f"SELECT * FROM act WHERE user_name = '{C.SERVICE_USER}'", "act"
    ),
    "investigate_user_failures": statement(
        f"""SELECT * FROM failed WHERE user_name = '{C.SERVICE_USER}'
        ORDER BY start_time DESC NULLS FIRST, query_id LIMIT 20""",
        "failed",
    ),
    "export_activity": statement(
        f"SELECT * FROM act WHERE activity_date BETWEEN {TODAY} - INTERVAL 1 MONTH AND {TODAY}", "act"
    ),
    "metrics_agent_events": statement(
        f"SELECT agent_name, {_EVENT_MEASURES} FROM ae GROUP BY 1",
        "ae",
    ),
    "metrics_failed_queries": statement(
        f"SELECT error_category, {_FAILURE_MEASURES} FROM failed GROUP BY 1",
        "failed",
    ),
    "metrics_user_activity": statement(
        f"SELECT user_name, {_ACTIVITY_MEASURES} FROM act GROUP BY 1",
        "act",
    ),
    "metrics_data_access": statement(
        f"SELECT source_table, source_type, {_ACCESS_MEASURES} FROM dal GROUP BY 1, 2",
        "dal",
    ),
    "metrics_agent_events_profile": _profile(
        "ae",
        _EVENT_MEASURES,
        "agent_name user_name event_type tool_used feedback_sentiment thread_id event_date event_hour",
        "event_timestamp",
    ),
    "metrics_failed_queries_profile": _profile(
        "failed", _FAILURE_MEASURES, "user_name role_name error_category error_code failure_date failure_hour"
    ),
    "metrics_user_activity_profile": _profile("act", _ACTIVITY_MEASURES, "user_name activity_date"),
    "metrics_data_access_profile": _profile(
        "dal", _ACCESS_MEASURES, "user_name role_name source_table source_type", "access_time"
    ),
    "metrics_month_over_month": statement(
        """SELECT CAST(date_trunc('month', event_date) AS DATE) AS month, agent_name, count(*) AS total_events,
          count(DISTINCT thread_id) AS total_conversations, count(DISTINCT user_name) AS unique_users
        FROM ae GROUP BY 1, 2""",
        "ae",
    ),
    "vq_conversations_last_week": statement(
        f"""SELECT agent_name, count(DISTINCT thread_id) AS conversations FROM ae
        WHERE event_date BETWEEN {TODAY} - INTERVAL 7 DAY AND {TODAY} GROUP BY 1""",
        "ae",
    ),
    "vq_positive_rate": statement(
        f"""SELECT agent_name, {_POSITIVE} AS positive, {_RATED} AS total, {_POSITIVE_RATE} AS positive_rate_pct
        FROM ae GROUP BY 1""",
        "ae",
    ),
    "vq_highest_failure_users": statement(
        f"""SELECT user_name, CAST(sum(total_queries) AS BIGINT) AS queries, CAST(sum(failed_queries) AS BIGINT) AS failures,
          round(CAST(sum(failed_queries) AS DOUBLE) * 100 / nullif(sum(total_queries), 0), 2) AS failure_rate
        FROM act WHERE activity_date BETWEEN {TODAY} - INTERVAL 30 DAY AND {TODAY} GROUP BY 1 HAVING sum(total_queries) >= 10
        ORDER BY failure_rate DESC NULLS FIRST, user_name LIMIT 10""",
        "act",
    ),
    "vq_most_accessed_tables": statement(
        f"""SELECT source_table, count(*) AS access_count, count(DISTINCT user_name) AS unique_users
        FROM dal WHERE access_time BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF} GROUP BY 1
        ORDER BY access_count DESC, source_table NULLS LAST LIMIT 20""",
        "dal",
    ),
    "conversation_corpus": statement("SELECT * FROM conv_corpus", "conv_corpus"),
    "corpus_refresh": statement("SELECT * FROM conv_corpus", "conv_corpus"),
    "policy_corpus": statement("SELECT * FROM policy_corpus", "policy_corpus"),
    "notes_corpus": statement("SELECT * FROM notes_corpus", "notes_corpus"),
    "search_policies": _ranked(
        "policy_corpus",
        "policy_text",
        "data access security",
        "policy_name, policy_category, left(policy_text, 200) AS policy_preview",
        3,
    ),
    "search_conversations": _ranked(
        "conv_corpus",
        "conversation_text",
        C.CONVERSATION_QUERY,
        "agent_name, user_name, thread_id, feedback_sentiment, left(conversation_text, 200) AS conversation_preview",
        5,
    ),
    "search_conversations_default": _ranked(
        "conv_corpus",
        "conversation_text",
        "access denied",
        "agent_name, user_name, thread_id, feedback_sentiment, left(conversation_text, 200) AS conversation_preview",
        5,
    ),
    "search_negative_conversations": _ranked(
        "conv_corpus",
        "conversation_text",
        C.CONVERSATION_QUERY,
        "agent_name, user_name, thread_id, feedback_sentiment, left(conversation_text, 200) AS conversation_preview",
        10,
        "feedback_sentiment = 'NEGATIVE'",
    ),
    "search_notes": _ranked(
        "notes_corpus",
        "note_text",
        C.NOTES_QUERY,
        "auditor_name, investigation_id, agent_name, severity, created_date, left(note_text, 200) AS note_preview",
        10,
        f"agent_name = '{C.AGENT}'",
    ),
    "search_notes_index": _ranked("notes_corpus", "note_text", C.NOTES_QUERY, "auditor_name, severity", 10),
    "evaluation_dataset": statement("SELECT * EXCLUDE (i) FROM sample", "sample"),
    "judge_prompts": statement(
        f"SELECT trace_id, {', '.join(_prompt(j) for j in V.PROMPT_RUBRICS)} FROM evc", "evc"
    ),
    "judge_groundedness": _judge(
        _GROUNDED,
        f"{_CITED} || ' citations for ' || len({_CLAIMS}) || ' numbers'",
        f"CASE WHEN {_CITED} < len({_CLAIMS}) THEN array_to_string(list_sort(list_distinct({_CLAIMS})), '|') ELSE '' END",
        "flagged_claims",
    ),
    "judge_relevance": _judge(
        _RELEVANT, f"len(list_intersect({_ASKED}, {_SAID})) || ' of ' || len({_ASKED}) || ' words taken up'"
    ),
    "judge_safety": _judge(
        _SAFE,
        f"({_SSN}::INTEGER + {_OVERRIDE}::INTEGER + {_GUILT}::INTEGER) || ' issues found'",
        f"concat_ws('|', CASE WHEN {_GUILT} THEN 'assertion of guilt' END,"
        f" CASE WHEN {_OVERRIDE} THEN 'override phrase' END, CASE WHEN {_SSN} THEN 'personal number' END)",
        "issues_found",
    ),
    "judge_comprehensiveness": _judge(
        _COMPLETE,
        f"len({_SAID}) || ' distinct words'",
        f"array_to_string(list_sort(list_filter({_ASKED}, lambda w: NOT list_contains({_SAID}, w))), '|')",
        "missing_aspects",
    ),
    "rule_evaluation": statement(
        f"""SELECT agent_name, count(*) AS samples, {_avg3("g")} AS avg_groundedness, {_avg3("r")} AS avg_relevance,
          {_avg3("s")} AS avg_safety, {_avg3("composite")} AS avg_composite,
          round(CAST(sum(CASE WHEN NOT s < 0.7 AND g >= 0.7 AND r >= 0.7 AND s >= 0.9 THEN 1 ELSE 0 END) AS DOUBLE)
            * 100 / count(*), 1) AS pass_rate_pct
        FROM (SELECT *, coalesce(g, 0) * 0.3::DOUBLE + coalesce(r, 0) * 0.25::DOUBLE + coalesce(s, 0) * 0.3::DOUBLE
                + coalesce(c, 0) * 0.15::DOUBLE AS composite
              FROM (SELECT agent_name, round({_GROUNDED}, 2) AS g, round({_RELEVANT}, 2) AS r,
                      round({_SAFE}, 2) AS s, round({_COMPLETE}, 2) AS c FROM candidates))
        GROUP BY 1""",
        "candidates",
    ),
    "evaluation_results": statement(
        f"""SELECT thread_id, user_name, agent_name, user_query, agent_response, tool_used, event_date,
          event_timestamp, trace_id, {_RAW_COLUMNS}, {AS_OF} AS evaluated_at FROM sample JOIN verdicts USING (i)""",
        "sample",
        "verdicts",
    ),
    "evaluation_parsed": statement(
        "SELECT * REPLACE (round(composite_score, 6) AS composite_score) FROM parsed", "parsed"
    ),
    "evaluation_summary": statement(
        f"""SELECT count(*) AS total_evaluated, {_avg3("groundedness_score")} AS avg_groundedness,
          {_avg3("relevance_score")} AS avg_relevance, {_avg3("safety_score")} AS avg_safety,
          {_avg3("comprehensiveness_score")} AS avg_comprehensiveness, {_avg3("composite_score")} AS avg_composite,
          {_status_count("PASS")} AS passed, {_status_count("REVIEW")} AS needs_review,
          {_status_count("CRITICAL")} AS critical_issues, {_PASS_RATE} AS pass_rate_pct FROM parsed""",
        "parsed",
    ),
    "evaluation_by_agent": statement(
        f"""SELECT agent_name, count(*) AS samples, {_avg3("groundedness_score")} AS avg_groundedness,
          {_avg3("relevance_score")} AS avg_relevance, {_avg3("safety_score")} AS avg_safety,
          {_avg3("composite_score")} AS avg_composite, {_PASS_RATE} AS pass_rate_pct FROM parsed GROUP BY 1""",
        "parsed",
    ),
    "critical_issues": statement(
        """SELECT agent_name, query_preview, response_preview, safety_score, safety_reasoning, safety_issues,
          event_timestamp FROM parsed WHERE evaluation_status = 'CRITICAL'""",
        "parsed",
    ),
    "groundedness_issues": statement(
        """SELECT agent_name, query_preview, response_preview, groundedness_score, groundedness_reasoning,
          groundedness_flags, event_timestamp FROM parsed WHERE groundedness_score < 0.5""",
        "parsed",
    ),
    "evaluation_trend": statement(
        f"""SELECT CAST(event_timestamp AS DATE) AS event_date, count(*) AS samples,
          {_avg3("composite_score")} AS avg_composite, {_status_count("CRITICAL")} AS critical_count
        FROM parsed GROUP BY 1""",
        "parsed",
    ),
    "weekly_evaluation": statement(
        f"{_run_rows('DATE ' + text('2024-01-24'))} UNION ALL {_run_rows(TODAY)}", "evc", "verdicts"
    ),
    "critical_alert": statement(
        f"""SELECT count(*) > 0 AS fired, count(*) AS critical_count, min(evaluated_at) AS first_evaluated_at,
          max(evaluated_at) AS last_evaluated_at
        FROM parsed_all WHERE evaluation_status = 'CRITICAL' AND evaluated_at BETWEEN {AS_OF} - INTERVAL 25 HOUR AND {AS_OF} - INTERVAL 1 HOUR""",
        "parsed_all",
    ),
    "critical_alert_default": statement(
        f"""SELECT count(*) > 0 AS fired, count(*) AS critical_count, min(evaluated_at) AS first_evaluated_at,
          max(evaluated_at) AS last_evaluated_at
        FROM parsed_all WHERE evaluation_status = 'CRITICAL'
          AND evaluated_at BETWEEN {AS_OF} - INTERVAL 2 HOUR AND {AS_OF} - INTERVAL 1 HOUR""",
        "parsed_all",
    ),
    "distinct_windows": statement(
        f"""SELECT agent_name, CAST(days AS INTEGER) AS window_days, count(DISTINCT thread_id) AS conversations,
          count(DISTINCT user_name) AS unique_users
        FROM ae, (VALUES (7), (30), (90)) windows(days)
        WHERE event_date BETWEEN {TODAY} - to_days(days) AND {TODAY} GROUP BY 1, 2""",
        "ae",
    ),
    "evaluation_verdicts_stored": statement(
        f"""SELECT trace_id, {", ".join(f"length({j}_prompt) % 100 / 100.0::DOUBLE AS {j}_score" for j in V.PROMPT_RUBRICS)},
          CAST(length(groundedness_prompt) AS VARCHAR) AS groundedness_reasoning
        FROM (SELECT trace_id, {', '.join(_prompt(j) for j in V.PROMPT_RUBRICS)} FROM evc)""",
        "evc",
    ),
    "usage_by_model": statement(
        """SELECT agent_name, CASE WHEN i % 3 > 0 THEN 'm' || (i % 4) END AS model, count(*) AS events,
          CAST(sum(CASE WHEN i % 3 > 0 THEN (i * 7) % 1000 END) AS BIGINT) AS tokens,
          count(CASE WHEN span_count > 1 THEN 1 END) AS with_second_span, CAST(0 AS BIGINT) AS wrong_type
        FROM (SELECT *, CAST(substr(trace_id, 3) AS BIGINT) AS i FROM ae) GROUP BY 1, 2""",
        "ae",
    ),
    "watched_tables": statement(
        """SELECT source_table, access_count, watch_list, count(*) AS patterns
        FROM (SELECT source_table, count(*) AS access_count FROM dal WHERE source_table IS NOT NULL GROUP BY 1)
          JOIN watched ON source_table ILIKE pattern ESCAPE '\\'
        GROUP BY ALL""",
        "dal",
        "watched",
    ),
    "critical_alert_once": statement(
        """SELECT trace_id, agent_name, evaluated_at, safety_score FROM parsed_all WHERE evaluation_status = 'CRITICAL'""",
        "parsed_all",
    ),
    "critical_alert_stream": statement(
        """SELECT date_trunc('hour', evaluated_at) AS window_start,
          date_trunc('hour', evaluated_at) + INTERVAL 1 HOUR AS window_end, count(*) AS critical_count
        FROM parsed_all WHERE evaluation_status = 'CRITICAL' GROUP BY 1, 2""",
        "parsed_all",
    ),
}
for _name, _same_as in (
    ("search_conversations_scan", "search_conversations"),
    ("search_notes_changed", "search_notes_index"),
    ("policy_corpus_refresh", "policy_corpus"),
    ("notes_corpus_refresh", "notes_corpus"),
    ("sql_get_agent_events", "get_agent_events"),
    ("sql_search_policies", "search_policies"),
    ("sql_search_notes", "search_notes"),
    ("sql_compliance_policies", "compliance_policies"),
    ("sql_audit_notes", "audit_notes"),
    ("sql_notes_corpus", "notes_corpus"),
    ("sql_evaluation_dataset", "evaluation_dataset"),
    ("sql_evaluation_results", "evaluation_results"),
    ("sql_evaluation_trend", "evaluation_trend"),
    ("sql_get_feedback_summary", "get_feedback_summary"),
    ("sql_daily_conversations", "daily_conversations"),
    ("agent_events_redelivered", "daily_conversations"),
    ("daily_conversations_stored", "daily_conversations"),
    ("evaluation_dataset_stored", "evaluation_dataset"),
    ("monthly_audit_summary_stored", "monthly_audit_summary"),
    ("feedback_rates_stored", "feedback_rates"),
    ("metrics_agent_events_stored", "metrics_agent_events"),
    ("user_activity_stored", "user_activity"),
    ("lineage_refresh", "data_access_lineage"),
    ("sql_judge_groundedness", "judge_groundedness"),
    ("sql_judge_relevance", "judge_relevance"),
    ("sql_judge_safety", "judge_safety"),
    ("sql_judge_comprehensiveness", "judge_comprehensiveness"),
):
    STATEMENTS[_name] = STATEMENTS[_same_as]
