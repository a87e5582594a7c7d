"""Ranked text search over conversations, policies and audit notes.

Ranking is BM25 (Robertson & Zaragoza 2009). :func:`search` scores a corpus
directly: no shuffle, since term counts and lengths are per row and the corpus
statistics are one small aggregate. Repeated searches go through a stored index
(``search_index.py``), which is read only for the terms asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.columns import ascending, computed_once
from tracewarden.functions.text import tokens
from tracewarden.operators.agent_events import _conversation_events

K1, B = 1.2, 0.75
SCORE_DIGITS = 6
MIN_CONVERSATION_CHARS = 10
TERM_BUCKETS = 256


def conversation_corpus(events: DataFrame) -> DataFrame:
    """Query and response of each conversation event; ``doc_id`` is its trace."""
    text = F.concat(F.coalesce("span_input", F.lit("")), F.lit(" "), F.coalesce("span_output", F.lit("")))
    return (
        _conversation_events(events)
        .select(
            F.col("trace_id").alias("doc_id"),
            text.alias("conversation_text"),
            "user_name",
            "agent_name",
            "thread_id",
            F.col("event_date").cast("string").alias("event_date"),
            "feedback_sentiment",
            "tool_used",
        )
        .where(F.length("conversation_text") > MIN_CONVERSATION_CHARS)
    )


def policy_corpus(policies: DataFrame) -> DataFrame:
    return policies.where(F.col("policy_text").isNotNull()).select(
        F.col("policy_id").alias("doc_id"),
        "policy_text",
        "policy_id",
        "policy_name",
        "policy_category",
        F.col("effective_date").cast("string").alias("effective_date"),
    )


def notes_corpus(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("note_text").isNotNull()).select(
        F.col("note_id").alias("doc_id"),
        "note_text",
        "auditor_name",
        "investigation_id",
        "agent_name",
        "severity",
        F.col("created_date").cast("string").alias("created_date"),
    )


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query, cut the same way as the corpus tokens."""
    kept = "".join(c if c.isalpha() or c in "0123456789" else " " for c in query.lower())
    return list(dict.fromkeys(kept.split()))


def inverse_document_frequency(documents: Column, containing: Column) -> Column:
    return F.ln(1 + (documents - containing + 0.5) / (containing + 0.5))


def term_score(idf: Column, frequency: Column, length: Column, mean_length: Column) -> Column:
    damping = K1 * (1 - B + B * length / mean_length)
    return idf * frequency * (K1 + 1) / (frequency + damping)


def _occurrences(words: Column, term: str) -> Column:
    return F.array_size(F.filter(words, lambda word: word == F.lit(term)))


def matching(filters: Mapping[str, object] | None) -> Column:
    condition = F.lit(True)
    for name, value in (filters or {}).items():
        condition = condition & (F.col(name) == F.lit(value))
    return condition


def search(
    corpus: DataFrame,
    text_column: str,
    query: str,
    columns: Sequence[str],
    filter: Mapping[str, object] | None = None,
    limit: int = 10,
) -> DataFrame:
    """The ``limit`` best documents for a query, with their attributes and score.

    Statistics cover the whole corpus, so a filter changes which documents are
    returned but not their scores. Equal scores are ordered by ``doc_id``.
    """
    terms = query_terms(query)
    if not terms:
        raise ValueError("the query has no searchable term")
    names = [f"_tf{n}" for n in range(len(terms))]
    words = F.col("_words")
    measured = computed_once(
        computed_once(corpus, tokens(F.col(text_column)).alias("_words")),
        F.array_size(words).alias("_length"),
        *[_occurrences(words, term).alias(name) for name, term in zip(names, terms)],
    ).drop("_words")
    # One row; Spark evaluates it once and hands it to every task as a constant.
    statistics = measured.agg(
        F.struct(
            F.count(F.lit(1)).alias("documents"),
            F.avg("_length").alias("mean_length"),
            *[F.sum(F.when(F.col(n) > 0, 1).otherwise(0)).alias(n) for n in names],
        )
    ).scalar()
    # A document holding none of the terms as plain text cannot score, and
    # finding that out is far cheaper than cutting it into tokens.
    lowered = F.lower(F.col(text_column))
    candidate = F.lit(False)
    found = F.lit(False)
    for name, term in zip(names, terms):
        candidate = candidate | lowered.contains(term)
        found = found | (F.col(name) > 0)
    score = F.lit(0.0)
    for name in names:
        idf = inverse_document_frequency(F.col("_all.documents"), F.col(f"_all.{name}"))
        score = score + term_score(idf, F.col(name), F.col("_length"), F.col("_all.mean_length"))
    return (
        measured.where(matching(filter) & candidate & found)
        .withColumn("_all", statistics)
        .select("doc_id", *columns, F.round(score, SCORE_DIGITS).alias("score"))
        .orderBy(F.col("score").desc(), ascending("doc_id"))
        .limit(limit)
    )


def _found(
    corpus: DataFrame,
    text_column: str,
    query: str,
    columns: Sequence[str],
    filter: Mapping[str, object] | None,
    limit: int,
    index: str | None,
) -> DataFrame:
    """By the stored index at the path ``index``, or by a scan of the corpus."""
    if index is None:
        return search(corpus, text_column, query, columns, filter, limit)
    from tracewarden.operators.search_index import search_index

    return search_index(corpus.sparkSession, index, query, columns, filter, limit)


def search_policies(
    policies: DataFrame,
    query: str = "data access security",
    limit: int = 3,
    preview_chars: int = 200,
    index: str | None = None,
) -> DataFrame:
    columns = ["policy_name", "policy_category", "policy_text"]
    found = _found(policy_corpus(policies), "policy_text", query, columns, None, limit, index)
    return found.select(
        "doc_id",
        "policy_name",
        "policy_category",
        F.left("policy_text", F.lit(preview_chars)).alias("policy_preview"),
        "score",
    )


def search_conversations(
    events: DataFrame,
    query: str = "access denied",
    filter: Mapping[str, object] | None = None,
    limit: int = 5,
    preview_chars: int = 200,
    index: str | None = None,
) -> DataFrame:
    columns = ["agent_name", "user_name", "thread_id", "feedback_sentiment", "conversation_text"]
    found = _found(conversation_corpus(events), "conversation_text", query, columns, filter, limit, index)
    return found.select(
        "doc_id",
        "agent_name",
        "user_name",
        "thread_id",
        "feedback_sentiment",
        F.left("conversation_text", F.lit(preview_chars)).alias("conversation_preview"),
        "score",
    )


def search_notes(
    notes: DataFrame,
    query: str,
    filter: Mapping[str, object] | None = None,
    limit: int = 10,
    preview_chars: int = 200,
    index: str | None = None,
) -> DataFrame:
    columns = ["auditor_name", "investigation_id", "agent_name", "severity", "created_date", "note_text"]
    found = _found(notes_corpus(notes), "note_text", query, columns, filter, limit, index)
    return found.select(
        "doc_id",
        "auditor_name",
        "investigation_id",
        "agent_name",
        "severity",
        "created_date",
        F.left("note_text", F.lit(preview_chars)).alias("note_preview"),
        "score",
    )
