"""The pipeline's stages against brute force, and as a whole."""

from __future__ import annotations

import pytest

import corpus_pipeline as P
from tests.llm.helpers import SF, WORD, documents
from tests.llm.test_jaccard import expected as near_expected
from tests.llm.test_repeats import expected as repeats_expected
from tracewarden.llm import quality_ranking
from tracewarden.llm.tables import stored


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in P.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), "stage"))
    return tables


def texts(table):
    return sorted(((r["doc_id"], r["text"]) for r in table.collect()), key=repr)


def test_names_and_columns(stages):
    assert [name for name, _ in P.STAGES] == [
        "quality classifier",
        "n-gram jaccard join",
        "suffix-array dedup",
        "mixing sources",
        "best-fit packing",
    ]
    assert all(t.columns == list(P.COLUMNS) for t in stages[:-1])


def test_quality_keeps_what_its_model_accepts(spark, stages):
    docs, kept = stages[0], stages[1]
    labels = quality_ranking.training_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality_ranking.scored(docs, quality_ranking.learn(docs, labels)).collect()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scores if r["score"] >= 0.3}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len({r["doc_id"] for r in kept.collect()} & good) >= 0.95 * len(good)


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert sorted(i for i, _ in after) == sorted(r[0] for r in near_expected(before) if r[4])
    assert set(after) <= set(before)


def test_passages_are_removed(stages):
    want = {i: (gone, text) for i, _, gone, text in repeats_expected(texts(stages[2]), 50)}
    before = dict(texts(stages[2]))
    for row in stages[3].collect():
        gone, text = want[row["doc_id"]]
        assert row["text"] == (text if gone else before[row["doc_id"]]) and row["n_chars"] == len(row["text"])
    assert stages[3].count() == len(before)


def test_mix_repeats_whole_documents(stages):
    before, after = dict(texts(stages[3])), texts(stages[4])
    counts = {i: sum(j == i for j, _ in after) for i in before}
    assert all(before[i] == text for i, text in after) and set(counts.values()) <= {0, 1, 2}
    words = {i: len(WORD.findall(t)) for i, t in before.items()}
    taken, whole = sum(counts[i] * words[i] for i in before), sum(words.values())
    assert abs(taken - 1.5 * whole) <= 20 * max(words.values())


def test_packing_holds_every_token(spark, stages):
    rows = P.pack(spark, stages[4], SF).collect()
    by_document = {}
    for r in rows:
        by_document.setdefault(r["doc_id"], 0)
        by_document[r["doc_id"]] += r["length"]
    assert set(by_document) == {i for i, _ in texts(stages[4])}
    sequences = {}
    for r in rows:
        sequences[r["sequence_id"]] = sequences.get(r["sequence_id"], 0) + r["length"]
    assert max(sequences.values()) <= 2048 and len(sequences) <= -(-sum(sequences.values()) // 2048) + 1


def test_run_equals_the_stages(spark, stages):
    want = stages[-1].select("doc_id", "piece", "start", "length", "ids_crc32")
    got = P.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nulls_repeated_rows_and_empty_tables_pass_all_stages(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "seven eight nine ten"), (4, "x " * 3000)]
    for table in (documents(spark, rows), documents(spark, [])):
        for _, stage in P.STAGES:
            table = stored(stage(spark, table, SF), "stage")
        table.collect()
    docs = documents(spark, rows)
    one = P.near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] for r in one), key=repr) == [1, 2, 4, None]
