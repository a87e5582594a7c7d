"""Pivotal mixing (1) and minimum bin slack packing (4)."""

from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, WORD, documents, prose
from tracewarden.llm import mixing as M
from tracewarden.llm import packing as P


def corpus():
    rng = random.Random(2)
    rows = []
    for k in range(600):
        source = rng.choice(["src0"] * 6 + ["src1", "src10", "src2", "Ä", None, "empty"])
        text = rng.choice([None, "", " \n"]) if source == "empty" else prose(rng, rng.randrange(0, 60))
        rows.append((rng.choice([k, k, None]) if k % 50 == 0 else k, text, "en", source))
    return rows + rows[:20] + [(5000, "a " * 40_000, "en", "src2")]


def level(sizes, weights, budget):
    """Targets by repeated sharing, in plain Python."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        rest = budget * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        share = {s: 2 * sizes[s] if s in full else rest * weight[s] / total for s in names}
        more = {s for s in names if share[s] > 2 * sizes[s]}
        if not more:
            return share
        full |= more


@pytest.mark.parametrize("leaf_rows", [50, 10**6])
def test_mix_meets_its_targets(spark, leaf_rows):
    table = documents(spark, corpus()).repartition(5)
    rows = [r.asDict() for r in M.mixed(table, leaf_rows=leaf_rows).collect()]
    assert len(rows) == len(corpus())
    sizes = {}
    for _, text, _, source in corpus():
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = level(sizes, (5, 2, 1), 1.5)
    for source, size in sizes.items():
        mine = [r for r in rows if r["source"] == source]
        assert {r["source_size"] for r in mine} == {size}
        assert all(math.isclose(r["target"], want[source], rel_tol=1e-9) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[source]) <= max([r["size"] for r in mine if r["taken"] % max(1, r["size"]) == 0])
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in rows)
    again = [r.asDict() for r in M.mixed(table.repartition(2), leaf_rows=leaf_rows).collect()]
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_many_sources_do_not_meet_in_one_task(spark, monkeypatch):
    most, write = [], M.stored

    def spy(rows, purpose):
        if purpose == "level":
            sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
            most.append((max(sizes), sum(sizes)))
        return write(rows, purpose)

    monkeypatch.setattr(M, "stored", spy)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = documents(spark, [(k, prose(random.Random(k), 1 + k % 7), "en", f"host{k % 1500}") for k in range(3000)])
        assert len(M.mixed(table, leaf_rows=60).collect()) == 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    largest, all_rows = most[-1]  # the root
    assert all_rows > 400 and largest < all_rows * 0.7


def test_pivotal_rounding_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size, p = np.array([5.0, 1, 3, 8, 2, 2, 9]), np.array([0.3, 0.5, 0.9, 0.25, 0.0, 1.0, 0.6])
    total = np.zeros(7)
    for _ in range(4000):
        out = M.pivotal(size, p, rng.random(7))
        assert math.isclose(out @ size, p @ size) and ((out > 0) & (out < 1)).sum() <= 1
        total += out
    assert np.abs(total / 4000 - p).max() < 0.04


def test_repeated_rows_share_their_copies(spark):
    table = documents(spark, [(1, "a b c", "en", "s")] * 3 + [(2, "d", "en", "s"), (3, None, "en", None)])
    taken = M.repeated_by_mix(table, ("doc_id", "text"))
    counts = {r["doc_id"]: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert abs(sum({1: 3, 2: 1}[k] * n for k, n in counts.items()) - 15) <= 3 and 3 <= counts[1] <= 6
    assert M.mixed(documents(spark, [])).collect() == []


def test_reports_of_the_test_table(spark):
    rows = M.op1_pivotal_mixing(spark, SF).collect()
    assert math.isclose(sum({r["source"]: r["target"] for r in rows}.values()), 1.5 * sum(r["size"] for r in rows))


def test_fullest_combination_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(0, 80)
        counts = np.bincount(items, minlength=100)
        chosen = P.fullest(counts, sorted(set(items), reverse=True), room)
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        assert sum(chosen) == best and all(chosen.count(x) <= items.count(x) for x in chosen)


def test_pieces_of_long_documents():
    ids = np.arange(5000, dtype="<u4")
    found = P.pieces_of(ids, 2048)
    assert [(a, n) for a, n, _ in found] == [(0, 904), (904, 2048), (2952, 2048)]
    assert found[1][2] == zlib.crc32(ids[904:2952].tobytes())
    assert [(a, n) for a, n, _ in P.pieces_of(ids[:4096], 2048)] == [(0, 2048), (2048, 2048)]
    assert [(a, n) for a, n, _ in P.pieces_of(ids[:2048], 2048)] == [(0, 2048)]


@pytest.mark.parametrize("group_pieces", [40, 8192])
def test_packing_places_every_piece_once(spark, group_pieces):
    rows = [*corpus(), (7, "<|endoftext|> x"), (8, None), (8, None)]
    table = documents(spark, rows).repartition(4)
    pieces = P.tokenized_pieces(table)
    packed = [r.asDict() for r in P.packed(pieces, group_pieces=group_pieces).collect()]
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(repr([r[k] for k in key]) for r in packed) == sorted(repr([r[k] for k in key]) for r in pieces.collect())
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    assert len(by_sequence) <= -(-sum(r["length"] for r in packed) // P.CAPACITY) + 1


def test_pieces_that_fill_no_sequence_are_packed_level_by_level(spark):
    rows = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1500L AS length", "id AS ids_crc32")
    packed = P.packed(rows, group_pieces=40).collect()
    assert len({r["sequence_id"] for r in packed}) == len(packed) == 500


def test_empty_table_packs_to_nothing(spark):
    assert P.packed(P.tokenized_pieces(documents(spark, []))).collect() == []


def test_rank_file_gives_the_tokenizer_files_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["", " ", "\n\n  a\tb ", "naïve 🙂 ‍ zero", "<|endoftext|>", "I'll we've 12345", "\x00\x01", "日本語のテキスト"]
    encode = P.encoding(P.VOCABULARY).encode_ordinary
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encode(text) == want.ids


def test_pieces_have_the_tokenizer_files_ids_of_special_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n z<|endoftext|", "plain", "<|endoftext|>a " * 3000]
    found = P.tokenized_pieces(documents(spark, list(enumerate(texts)))).collect()
    rows = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    want = []
    for k, ids in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        want += [(k, n, *piece) for n, piece in enumerate(P.pieces_of(np.array([*ids.ids, 0], "<u4"), P.CAPACITY))]
    assert rows == want and 50256 in tokenizer.encode(texts[0]).ids


def test_very_long_runs_have_the_tokenizer_files_ids(spark):
    """A million white-space characters in a row are more than the rank file's pattern takes."""
    long = 2_000_000
    texts = [" " * long, "\n" * long, "\t" * long + "word", "x y" + " " * long + "<|endoftext|> z", "a" * long, "!" * long, "\u3000" * 1_200_000]
    found = P.tokenized_pieces(documents(spark, list(enumerate(texts))).repartition(7)).collect()
    rows = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    want = []
    for k, text in enumerate(texts):
        ids = P.tokenizer(P.TOKENIZER_FILE).encode(text, add_special_tokens=False).ids
        want += [(k, n, *piece) for n, piece in enumerate(P.pieces_of(np.array([*ids, 0], "<u4"), P.CAPACITY))]
    assert rows == want


def test_many_equal_rows_spread_over_groups(spark):
    rows = spark.range(3000).selectExpr("7L AS doc_id", "0 AS piece", "0L AS start", "700L AS length", "5L AS ids_crc32")
    packed = P.packed(rows, group_pieces=100)
    found = [r.asDict() for r in packed.collect()]
    assert len(found) == 3000 and len({(r["sequence_id"], r["offset"]) for r in found}) == 3000
    groups = {r["sequence_id"] >> 24 for r in found}
    assert len(groups) >= 25 and len({r["sequence_id"] for r in found}) <= 3000 // 2 + 1
