"""Super-k-mers (5) and suffix arrays (7): equal to brute force over windows."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, WORD, by_id, documents, prose
from tracewarden.llm import suffix_arrays as SA
from tracewarden.llm import super_kmers as SK
from tracewarden.llm.words import Texts, utf8


def expected(rows, window):
    first = {}
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in cut:
        for k in range(len(words) - window + 1 if i is not None else 0):
            s = tuple(words[k : k + window])
            first[s] = min(first.get(s, i), i)
    out = []
    for i, words in cut:
        gone = set()
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    passage, other = prose(rng, 70), prose(rng, 55)
    rows = [(1, f"{prose(rng, 90)} {passage} {prose(rng, 9)}")]
    for i in range(2, 40):
        a = rng.randrange(0, 20)
        cut = " ".join(passage.split()[a : a + rng.randrange(10, 70)])
        rows.append((i, f"{prose(rng, rng.randrange(0, 60), 30)}\n {cut}\t{prose(rng, 5)} {other if i % 3 else ''}"))
    rows += [(40, "the " * 300), (41, "the " * 120), (42, rows[0][1]), (43, rows[0][1]), (7, rows[0][1])]
    rows += [(60, None), (61, ""), (62, " \t\n"), (None, passage), (63, "short text"), (64, "x" * 100_000), (65, prose(rng, 20_000, 5))]
    rows += [(5, rows[0][1]), (5, rows[0][1])]
    rows += [(66, "a b " + passage.replace(" ", "\x0b")), (67, "ä ö\x1fü " * 30), (68, "ä ö\x1fü " * 30)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return documents(spark, corpus()).repartition(3).cache()


@pytest.mark.parametrize("bucket_windows", [5, 400, 10**6])
def test_super_kmers_equal_brute_force_with_and_without_frequent_minimisers(spark, table, bucket_windows):
    found = SK.without_repeats(table, SK.repeated_windows(table, bucket_windows=bucket_windows), 13)
    rows = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr)
    assert rows == expected(corpus(), 13)


@pytest.mark.parametrize("settings", [{}, {"largest_group": 3}, {"bits": 16}])
def test_suffix_arrays_equal_brute_force_with_and_without_hot_groups(spark, table, settings):
    found = SK.without_repeats(table, SA.repeated_passages(table, **settings), 50)
    rows = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr)
    assert rows == expected(corpus(), 50)
    assert sum(r[2] for r in rows) > 500


def test_groups_that_span_batches_are_matched_whole(spark, table, monkeypatch):
    monkeypatch.setattr(SA, "TASK_ROWS", 1)
    whole = SK.without_repeats(table, SA.repeated_passages(table), 50).agg(F.sum("n_removed")).first()[0]
    assert whole == sum(r[2] for r in expected(corpus(), 50))


@pytest.mark.parametrize("query", [SK.op5_super_kmers, SA.op7_suffix_arrays])
def test_every_document_has_a_row(spark, query):
    ids = by_id(query(spark, SF), "n_words", "n_removed")
    source = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(ids) == source.count() and all(0 <= gone <= n for n, gone in ids.values())


def test_empty_table(spark):
    empty = documents(spark, [])
    for repeats, window in ((SK.repeated_windows, 13), (SA.repeated_passages, 50)):
        assert SK.without_repeats(empty, repeats(empty), window).collect() == []


def test_ordinary_texts_travel_packed_at_every_number_of_buckets(spark):
    """No window is dealt apart without a frequent minimiser, however small buckets are against the corpus."""
    rng = random.Random(9)
    table = documents(spark, [(k, prose(rng, 300, 50_000)) for k in range(200)]).repartition(4)
    rows = table.selectExpr("doc_id", "0L AS key", "text")
    for bucket_windows in (300, 3_000, 10**6):
        plan = SK.plan_of(rows, 13, bucket_windows)
        assert not len(plan.frequent) and not len(plan.too_frequent)
        assert plan.buckets == -(-200 * 288 // bucket_windows)
        sizes = {r["bucket"]: r["n"] for r in SK.packed_super_kmers(rows, plan, 13).selectExpr("bucket", "length(packed) AS n").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
        assert len(sizes) == plan.buckets and max(sizes.values()) <= 2.5 * sum(sizes.values()) / len(sizes)


def test_frequent_minimisers_are_dealt_by_longer_ones_and_still_packed(spark):
    rng = random.Random(10)
    # Three words in a row, in all texts, amid others: one minimiser (their hash is small), many different windows.
    tried = [f"a{k} b{k} c{k}" for k in range(5_000)]
    texts = Texts(*utf8(pa.array(tried)))
    values = SK.RangeHashes(texts.word_hashes()).of(texts.first[:-1], texts.first[1:])
    three = tried[int(values.argmin())]
    rows = []
    for k in range(300):
        words = prose(rng, 40, 3_000).split()
        rows.append((k, " ".join([*words[:20], three, *words[20:]])))
    table = documents(spark, rows).selectExpr("doc_id", "0L AS key", "text").repartition(3)
    plan = SK.plan_of(table, 13, 400)
    assert len(plan.frequent) and not len(plan.too_frequent)
    found = SK.without_repeats(table, SK.repeated_windows(table, bucket_windows=400), 13)
    assert sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr) == expected(rows, 13)


def test_frequent_values_are_counted_within_a_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 10**6, 20_000), np.repeat([7, 8], [3_000, 900])]).astype(np.uint64)
    rng.shuffle(values)
    found = SK.FrequentValues(50)
    for part in np.array_split(values, 9):
        found.add(part)
    count = dict(zip(found.values.tolist(), found.counts.tolist()))
    true = {7: (values == 7).sum(), 8: (values == 8).sum()}
    assert len(count) <= 50 and found.lost <= len(values) / 50
    assert all(true[v] - found.lost <= count[v] <= true[v] for v in (7, 8))


def test_windows_with_equal_hashes_are_told_apart_by_their_words(spark, monkeypatch):
    """With a hash that has two values only, the words decide."""
    class Poor(SK.RangeHashes):
        def of(self, starts, ends):
            full = super().of(starts, ends)
            return full & full.dtype.type(1) if len(starts) and (ends - starts)[0] == 13 else full

    rng = random.Random(3)
    rows = [(k, prose(rng, 60, 40)) for k in range(12)]
    rows += [(20 + k, rows[k][1] + " " + prose(rng, 5)) for k in range(4)]
    table = documents(spark, rows).selectExpr("doc_id", "0L AS key", "text").coalesce(1)
    packed = SK.packed_super_kmers(table, SK.Plan(1, *[SK.np.zeros(0, SK.np.uint64)] * 2), 13).toArrow()
    monkeypatch.setattr(SK, "RangeHashes", Poor)
    found = SK.repeated_in_bucket(packed, 13).to_pydict()
    gone = {}
    for doc, start, n in zip(found["doc_id"], found["start"], found["n"]):
        gone.setdefault(doc, set()).update(range(start, start + n + 12))
    want = {i: n for i, _, n, _ in expected(rows, 13) if n}
    assert {i: len(g) for i, g in gone.items()} == want and want


def test_anchors_spread_over_the_bitmap(spark):
    import numpy as np

    rng = random.Random(12)
    found = SA.Suffixes(Texts(*utf8(pa.array([prose(rng, 20_000, 5_000)]))), 50, 8)
    places = np.unique(SA.bit_places(found.value, 16))
    # Of some 900 anchors, hardly any share a bit, and the lowest half of the places has half of them.
    assert len(places) > 0.97 * len(np.unique(found.value)) and 0.4 < (places < 1 << 15).mean() < 0.6
