"""Declared schemas of the input logs and reference tables (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


S, L, NTZ = T.StringType(), T.LongType(), T.TimestampNTZType()

# Raw agent telemetry: one JSON document per row.
RAW_EVENTS = _struct(timestamp=NTZ, record=S)

# What is read out of the JSON document. duration_ms and positive are taken as
# text and cast afterwards so that 12.7, "12" and "true" do not void the record.
SPAN = _struct(name=S, tool_name=S, input=S, output=S, duration_ms=S)
RECORD = _struct(
    agent_name=S,
    database=S,
    schema=S,
    agent_type=S,
    user_name=S,
    thread_id=S,
    session_id=S,
    name=S,
    trace_id=S,
    spans=T.ArrayType(SPAN),
    feedback=_struct(positive=S, comment=S),
)

QUERY_LOG = _struct(
    query_id=S,
    user_name=S,
    role_name=S,
    warehouse_name=S,
    query_text=S,
    query_type=S,
    execution_status=S,
    error_code=S,
    error_message=S,
    rows_produced=L,
    bytes_scanned=L,
    total_elapsed_time=L,
    start_time=NTZ,
    end_time=NTZ,
)

ACCESSED_OBJECT = T.StructType(
    [
        T.StructField("objectName", S),
        T.StructField("objectDomain", S),
        T.StructField("columns", T.ArrayType(_struct(columnName=S))),
    ]
)
ACCESS_LOG = _struct(
    query_id=S,
    base_objects_accessed=T.ArrayType(ACCESSED_OBJECT),
    direct_objects_accessed=T.ArrayType(ACCESSED_OBJECT),
)

# As it streams: with the time that the query began, by which the two logs are matched.
ACCESS_STREAM = T.StructType([*ACCESS_LOG.fields, T.StructField("query_start_time", NTZ)])

POLICIES = _struct(
    policy_id=S,
    policy_name=S,
    policy_category=S,
    policy_text=S,
    effective_date=T.DateType(),
    created_at=NTZ,
    updated_at=NTZ,
)

NOTES = _struct(
    note_id=S,
    investigation_id=S,
    agent_name=S,
    thread_id=S,
    auditor_name=S,
    note_text=S,
    severity=S,
    created_date=NTZ,
)

EVALUATION_RESULTS = _struct(
    thread_id=S,
    user_name=S,
    agent_name=S,
    user_query=S,
    agent_response=S,
    tool_used=S,
    event_date=T.DateType(),
    event_timestamp=NTZ,
    trace_id=S,
    groundedness_raw=S,
    relevance_raw=S,
    safety_raw=S,
    comprehensiveness_raw=S,
    evaluated_at=NTZ,
)
