"""N-gram Jaccard join (9) and components against brute force."""

from __future__ import annotations

import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import WORD, documents, prose
from tracewarden.llm import jaccard_join as J
from tracewarden.llm.components import components


def shingle_set(text):
    words = WORD.findall(text or "")
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def expected(rows):
    rows = [r for r in rows if r[0] is not None]
    sets = [shingle_set(t) for _, t in rows]
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(len(rows)):
            both = len(sets[a] & sets[b])
            if a != b and ((rows[a][1] or "") == (rows[b][1] or "") or (both and 5 * both >= 4 * len(sets[a] | sets[b]))):
                links[a].add(b)
    out = []
    for a, (i, text) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        cls = min(rows[b][0] for b in range(len(rows)) if (rows[b][1] or "") == (text or ""))
        group = min(rows[b][0] for b in seen)
        out.append((i, cls, len(links[a]), group, i == group))
    return sorted(out)


def corpus():
    rng = random.Random(8)
    base = prose(rng, 120).split()
    rows = []
    for i in range(60):  # a chain of near copies, some above and some below the threshold
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(1000)}"
        rows.append((i + 3, " ".join(words)))
    rows += [(100 + k, prose(rng, 60)) for k in range(20)]
    rows += [(200, "one two"), (201, "one  two"), (202, "one two"), (203, None), (204, ""), (205, " \n"), (None, rows[0][1])]
    rows += [(2, rows[0][1]), (206, rows[0][1]), (207, "\n".join(base)), (208, "z " * 30_000), (209, "z " * 20_000), (209, "z " * 20_000)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return documents(spark, corpus()).repartition(4).cache()


@pytest.mark.parametrize(
    "settings",
    [{}, {"block_documents": 7}, {"block_shingles": 300, "bits": 16, "tile_blocks": 1, "cell_groups": 2}, {"block_documents": 3, "tile_blocks": 2, "cell_groups": 1}],
)
def test_equal_to_brute_force(spark, table, settings):
    found = J.near_duplicates(table, **settings)
    rows = [tuple(r) for r in found.collect()]
    assert sorted(r for r in rows if r[0] is not None) == expected(corpus())
    assert [r for r in rows if r[0] is None] == [(None, None, 0, None, True)]


def test_a_hot_bucket_is_paired_in_cells_of_bounded_size(spark):
    """5,000 groups in one bucket and two in another: all pairs once, no cell with more than four times its mean."""
    met = spark.range(5_000).selectExpr("7L AS band", "id AS group").unionByName(spark.range(2).selectExpr("8L AS band", "id AS group"))
    cells = J.meeting_cells(met, 250).groupBy("band", "x", "y").agg(F.count("*").alias("n"), F.countDistinct("a", "b").alias("pairs")).collect()
    hot = [r for r in cells if r["band"] == 7]
    assert sum(r["n"] for r in hot) == sum(r["pairs"] for r in hot) == 5_000 * 5_001 // 2
    assert max(r["n"] for r in hot) <= 4 * 250 * 250 and len(hot) == 20 * 21 // 2
    assert [r["n"] for r in cells if r["band"] == 8] == [3]


def test_texts_of_one_id_share_their_links(spark):
    rng = random.Random(3)
    one, other = prose(rng, 80), prose(rng, 80)
    rows = [(1, one), (1, other), (2, one + " more"), (3, other + " more"), (4, prose(rng, 50))]
    found = {(r["doc_id"], r["n_links"], r["component_id"]) for r in J.near_duplicates(documents(spark, rows)).collect()}
    assert found == {(1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)}


def test_empty_table(spark):
    assert J.near_duplicates(documents(spark, [])).collect() == []


def test_posterior_bound():
    # With all 96 values, J = 0.8 has 76.8 matches on average; the bound must be far below, and grow.
    bounds = [J.least_matches(n, 0.8, 1e-6) for n in range(8, 97, 8)]
    assert bounds == sorted(bounds) and 45 < bounds[-1] < 66 and J.least_matches(8, 0.8, 0.5) > bounds[0]
    # Beta(1, 2) at 0.8: probability 0.04 that one miss in one value still comes from 0.8 or more.
    assert J.least_matches(1, 0.8, 0.039) == 0 and J.least_matches(1, 0.8, 0.041) == 1


@pytest.mark.parametrize("similarity, most", [(0.8, 1.1e-8), (0.81, 3.1e-9), (0.82, 9e-10)])
def test_pruning_loss_over_all_looks(similarity, most):
    alive, lost = {0: 1.0}, 0.0  # probability of each number of equal values among those compared
    for n in range(J.STEP, J.BANDS * J.BAND_ROWS + 1, J.STEP):
        reached = {}
        for m, p in alive.items():
            for k in range(J.STEP + 1):
                reached[m + k] = reached.get(m + k, 0.0) + p * comb(J.STEP, k) * similarity**k * (1 - similarity) ** (J.STEP - k)
        bound = J.least_matches(n, 0.8, J.TOLERANCE)
        lost += sum(p for m, p in reached.items() if m < bound)
        alive = {m: p for m, p in reached.items() if m >= bound}
    assert lost <= most


@pytest.mark.parametrize("changed", [0.02, 0.2, 0.6])
def test_pairs_are_pruned_alike_by_columns_and_one_by_one(changed):
    rng = np.random.default_rng(2)
    sign = np.tile(rng.integers(0, 1 << 32, 96, dtype=np.uint32), (70, 1))
    other = rng.random(sign.shape) < changed
    sign[other] = rng.integers(0, 1 << 32, other.sum(), dtype=np.uint32)
    bounds = {n: J.least_matches(n, 0.8, 1e-3) for n in range(8, 97, 8)}

    def stays(x, y):
        same = np.cumsum(x == y)
        return all(same[n - 1] >= least for n, least in bounds.items())

    for a, b, own in ((sign, sign, True), (sign[:30], sign[30:], False)):
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if (i < j or not own) and stays(a[i], b[j])]
        assert list(zip(*(x.tolist() for x in J.surviving_pairs(a, b, own, 0.8, 1e-3)))) == want


def test_both_ways_of_counting_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 900, rng.integers(1, 700)).astype(np.uint64)) for _ in range(24)]
    i, j = np.triu_indices(24, 1)
    want = [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j)]
    assert J.common_counts(sets, i, j).tolist() == want
    assert J.common_counts(sets, i[:5], j[:5]).tolist() == want[:5]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (205, 200), (200, 203), (203, 205)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 1 for k in range(2, 41)} | {k: 100 for k in range(101, 140)} | {203: 200, 205: 200}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
