"""Epsilon grid order join (2) against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import with_clashes
from tracewarden.llm import grid_join as G
from tracewarden.llm.tables import ship_library

SCHEMA = "vec_id long, embedding array<float>, label int"


def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 40)):
            rows.append([len(rows) + 5, (centre + rng.normal(size=16) * rng.choice([0.01, 0.06, 0.12])).astype(np.float32).tolist(), k % 3])
    rows += [[900 + k, rows[0][1], rows[0][2]] for k in range(60)]
    rows += [[1, rows[0][1], rows[0][2]], [2, rows[0][1], None], [3, None, 1], [4, [], 1], [960, [0.0] * 16, 1], [None, rows[0][1], 0]]
    rows += [[961, [float("nan")] + rows[0][1][1:], 0], [962, [None] + rows[0][1][1:], 0], [963, [float("inf")] * 16, 0]]
    rows += [[964, rows[0][1][:8], 0], [965, rows[0][1][:8], 0], [966, [x * 3 for x in rows[0][1]], 0], [967, [1e38] * 16, 0], [968, [1e38] * 16, 0]]
    rows += [[5, rows[0][1], rows[0][2]]]
    return rows


def expected(rows, cosine=0.98):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        return x / np.sqrt((x * x).sum())

    units = [unit(r[1]) if r[0] is not None and r[2] is not None else None for r in rows]
    links = [
        {b for b in range(len(rows)) if a != b and units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2]
         and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine}
        for a in range(len(rows))
    ]
    out = []
    for a, r in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        group = r[0] if r[0] is None else min(rows[b][0] for b in seen)
        out.append((r[0], len(links[a]), group, r[0] is None or r[0] == group))
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"block_rows": 5, "fan_out": 2, "tile_blocks": 3}, {"block_rows": 40, "leading": 2, "tile_blocks": 1}])
def test_equal_to_brute_force(spark, settings):
    ship_library(spark)
    table = with_clashes(spark.createDataFrame(corpus(), SCHEMA)).repartition(3)
    assert sorted((tuple(r) for r in G.near_duplicates(table, **settings).collect()), key=repr) == expected(corpus())


def test_distant_blocks_are_skipped(spark):
    ship_library(spark)
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=3).astype(np.float32).tolist(), 0) for k in range(3000)]
    reps = G.unit_rows(spark.createDataFrame(rows, SCHEMA)).selectExpr("label", "dim", "unit", "vec_id AS rep", "1L AS copies")
    blocks = G.numbered(G.stored(G.sequence_blocks(reps, 0.05, {}, 3, 32), "blocks"))
    n = blocks.count()
    assert G.interval_pairs(blocks, 0.05, 3, 4).count() < n * (n + 1) / 4


@pytest.mark.parametrize("kind", ["double", "smallint", "date", "boolean", "decimal(5,2)", "string", "void"])
def test_labels_of_any_type(spark, kind):
    ship_library(spark)
    rows = [r for r in corpus() if r[2] != 2]
    table = spark.createDataFrame(rows, SCHEMA)
    label = {"date": "date_add(DATE '2024-01-01', label)", "void": "CAST(NULL AS INT)"}.get(kind, f"CAST(label AS {kind})")
    found = G.near_duplicates(table.selectExpr("vec_id", "embedding", f"{label} AS label"), block_rows=32)
    want = [(r[0], r[1], None) for r in rows] if kind == "void" else rows
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(want)


def test_nan_labels_are_equal(spark):
    ship_library(spark)
    rows = [(k, [1.0, 0.0], float("nan") if k < 4 else 1.0) for k in range(6)]
    found = G.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label double")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 3, 0), (4, 1, 4), (5, 1, 4)]


def test_a_block_travels_once_per_tile(spark):
    pairs = spark.range(40).selectExpr("id AS a").join(spark.range(40).selectExpr("id AS b"), F.col("a") <= F.col("b")).withColumn("dim", F.lit(8))
    rows = G.tiled(pairs, 256, 8).collect()
    assert len(rows) == 5 * 8 + 10 * 16 and len({r.tile for r in rows}) == 15
    assert sum(len(r.partners) for r in rows) == 40 * 41 // 2


def test_empty_table(spark):
    ship_library(spark)
    assert G.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
