"""Compliance policies and audit notes: schemas, seed rows, defaults and checks."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden import fixed_values as V
from tracewarden import schemas
from tracewarden.functions.clock import instant


def seed_policies(spark: SparkSession, as_of: datetime) -> DataFrame:
    rows = [
        (pid, name, category, text, date.fromisoformat(effective), as_of, as_of)
        for pid, name, category, text, effective in V.SEED_POLICIES
    ]
    return spark.createDataFrame(rows, schemas.POLICIES)


def add_policies(policies: DataFrame, as_of: datetime) -> DataFrame:
    """New policy rows in the table's shape: both timestamps default to ``as_of``."""
    return _in_shape(
        policies,
        schemas.POLICIES,
        {"created_at": instant(as_of), "updated_at": instant(as_of)},
    )


def add_audit_notes(notes: DataFrame, as_of: datetime) -> DataFrame:
    """New notes in the table's shape: generated id, severity INFO, dated ``as_of``.

    A generated id follows from the note, ``as_of`` and, for notes that are alike in every column, a
    running number: a retried task or a second run of the same insert gives the same ids.
    """
    rows = _in_shape(notes, schemas.NOTES, {"severity": F.lit(V.DEFAULT_SEVERITY), "created_date": instant(as_of)})
    if "note_id" not in notes.columns:
        return _with_ids(rows, as_of)
    return rows.where("note_id IS NOT NULL").unionByName(_with_ids(rows.where("note_id IS NULL"), as_of))


def _with_ids(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Notes that are alike are counted before they are numbered, so that many of them burden no task."""
    names = [f.name for f in schemas.NOTES.fields]
    others = [name for name in names if name != "note_id"]
    numbered = rows.groupBy(*others).agg(F.count(F.lit(1)).alias("_n")).select(
        *others, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_n")
    )
    content = F.to_json(F.struct(*others, "_n", instant(as_of).alias("_as_of")), {"ignoreNullFields": "false"})
    digest = F.md5(content)
    # The form of a UUID whose bits are its maker's own (version 8).
    parts = [F.substr(digest, F.lit(at), F.lit(size)) for at, size in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    uuid = F.concat_ws("-", parts[0], parts[1], F.concat(F.lit("8"), parts[2]), F.concat(F.lit("8"), parts[3]), parts[4])
    return numbered.withColumn("note_id", uuid).select(*names)


def _in_shape(rows: DataFrame, schema, defaults: dict) -> DataFrame:
    columns = []
    for field in schema.fields:
        given = F.col(field.name) if field.name in rows.columns else F.lit(None)
        value = F.coalesce(given, defaults[field.name]) if field.name in defaults else given
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def invalid_policies(policies: DataFrame) -> DataFrame:
    """Rows that break the table's rules: key set and unique, name set."""
    repeated = policies.groupBy("policy_id").count().where("count > 1").select("policy_id")
    missing = policies.where(F.col("policy_id").isNull() | F.col("policy_name").isNull()).select("policy_id")
    return repeated.withColumn("problem", F.lit("duplicate key")).unionByName(
        missing.withColumn("problem", F.lit("missing value"))
    )


def invalid_notes(notes: DataFrame) -> DataFrame:
    """Rows that break the table's rules: key set and unique, known severity."""
    repeated = notes.groupBy("note_id").count().where("count > 1").select("note_id")
    missing = notes.where(F.col("note_id").isNull()).select("note_id")
    unknown = notes.where(~F.col("severity").isin(*V.SEVERITIES)).select("note_id")
    return (
        repeated.withColumn("problem", F.lit("duplicate key"))
        .unionByName(missing.withColumn("problem", F.lit("missing value")))
        .unionByName(unknown.withColumn("problem", F.lit("unknown severity")))
    )
