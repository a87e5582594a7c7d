"""Every named query against its DuckDB statement on the smallest test data."""

from __future__ import annotations

import pytest
from compare import database, differences

import __spark_entry__ as entry_module
from tracewarden.catalog import QUERIES
from tracewarden.oracle import STATEMENTS

SF_DIR = "/root/testdata/sf0.001"
# Too little data at this scale for a user-hour above the threshold; no invented text says "access denied".
EMPTY = {"after_hours_activity", "search_conversations_default"}


@pytest.fixture(scope="module")
def duck():
    return database(SF_DIR)


def test_every_query_has_a_statement():
    assert entry_module.oracle_sql().keys() <= entry_module.queries().keys()
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_duckdb(spark, duck, name):
    rows, found = differences(entry_module.queries()[name](spark, SF_DIR), duck, entry_module.oracle_sql()[name])
    assert not found, "\n".join(found)
    assert rows or name in EMPTY


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns == ["agent_name", "total_feedback", "positive", "negative", "positive_rate_pct"]
    assert result.count() == 4
