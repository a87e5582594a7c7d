from __future__ import annotations

from datetime import date, datetime

from tracewarden import schemas
from tracewarden.sources.reference_tables import (
    add_audit_notes,
    add_policies,
    invalid_notes,
    invalid_policies,
    seed_policies,
)


def test_seed_policies(spark, as_of):
    policies = seed_policies(spark, as_of)
    assert policies.schema == schemas.POLICIES
    rows = {r.policy_id: r for r in policies.collect()}
    assert sorted(rows) == [f"POL-00{n}" for n in range(1, 6)]
    assert "the user's authorized scope" in rows["POL-001"].policy_text
    assert {r.effective_date for r in rows.values()} == {date(2024, 1, 1)}
    assert invalid_policies(policies).count() == 0


def test_new_policies_get_timestamps(spark, as_of):
    given = spark.createDataFrame([("P1", "n")], "policy_id string, policy_name string")
    (row,) = add_policies(given, as_of).collect()
    assert (row.policy_id, row.policy_text, row.created_at, row.updated_at) == ("P1", None, as_of, as_of)


def test_note_defaults_and_given_values(spark, as_of):
    at = datetime(2023, 5, 1)
    given = spark.createDataFrame(
        [("first", None, None, None), ("second", "N2", "CRITICAL", at)],
        "note_text string, note_id string, severity string, created_date timestamp_ntz",
    )
    notes = add_audit_notes(given, as_of)
    assert notes.schema.names == schemas.NOTES.names
    rows = {r.note_text: r for r in notes.collect()}
    assert len(rows["first"].note_id) == 36
    assert (rows["first"].severity, rows["first"].created_date) == ("INFO", as_of)
    assert (rows["second"].note_id, rows["second"].severity, rows["second"].created_date) == ("N2", "CRITICAL", at)


def test_generated_ids_survive_retries_and_tell_equal_notes_apart(spark, as_of):
    rows = [(f"text {k % 5}", None) for k in range(40)] + [("given", "N1"), (None, None)]
    given = spark.createDataFrame(rows, "note_text string, note_id string")
    first, again = (sorted(add_audit_notes(given.repartition(n), as_of).collect(), key=str) for n in (1, 7))
    assert first == again and len(first) == len(rows)
    assert len({r.note_id for r in first}) == len(rows) and "N1" in {r.note_id for r in first}
    assert {r.note_text: 0 for r in first} == {r[0]: 0 for r in rows}
    later = add_audit_notes(given, datetime(2024, 2, 1)).collect()
    assert {r.note_id for r in later} & {r.note_id for r in first} == {"N1"}
    without = add_audit_notes(given.select("note_text"), as_of)
    assert without.columns == schemas.NOTES.names and without.select("note_id").distinct().count() == len(rows)
    assert add_audit_notes(given.limit(0), as_of).collect() == []


def test_checks(spark, as_of):
    policies = spark.createDataFrame(
        [("P1", "n"), ("P1", "n"), ("P2", None), ("P3", "n")], "policy_id string, policy_name string"
    )
    found = {(r.policy_id, r.problem) for r in invalid_policies(policies).collect()}
    assert found == {("P1", "duplicate key"), ("P2", "missing value")}
    notes = spark.createDataFrame(
        [("N1", "INFO"), ("N1", "INFO"), ("N2", "LOUD"), (None, "INFO")], "note_id string, severity string"
    )
    found = {(r.note_id, r.problem) for r in invalid_notes(notes).collect()}
    assert found == {("N1", "duplicate key"), ("N2", "unknown severity"), (None, "missing value")}
