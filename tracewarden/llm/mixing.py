"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a number of words; every document of it should be taken
target / source size times. The whole part of that is taken outright, the rest is a
probability. Pivotal rounding pairs two undecided documents and moves
probability between them, weighted by their sizes, until one is decided; each
document's expectation stays what it was, and the source's words change only when the
last one is decided. Leaves of some thousand documents are rounded first, and their
undecided rests meet in a reduction tree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.llm.tables import read_table, stored
from tracewarden.llm.words import WORD_PATTERN

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_COPIES = 2
LEAF_ROWS = 4096
FAN_IN = 32
# A source has at most FAN_IN undecided rows in a node, so a group has about as many rows as a leaf.
GROUP_SOURCES = 128
# A probability this near to 0 or 1 counts as decided.
EXACT = 1e-12


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0, by code point, null last) to rows of one source each.

    A range-partitioned sort numbers the rows within partitions; only the count of
    each partition meets on the driver.
    """
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id())
    ordered = stored(ordered.withColumn("_part", F.shiftright("_id", 33)), "sources")
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    before, rank = 0, F.lit(0)
    offsets = []
    for row in counts:
        offsets.append((row["_part"], before))
        before += row["n"]
    if offsets:
        table = F.create_map(*[F.lit(x) for pair in offsets for x in pair])
        rank = F.element_at(table, F.col("_part")) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("rank", rank.cast("long")).drop("_id", "_part")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to rows (source, source_size).

    Sources share ``budget`` times all words by weight. One that would get more than
    ``most`` times its size gets just that, and the others share the rest anew, until
    none is above. Each round is an aggregate over the sources' table.
    """
    ranked = ranked_sources(sizes).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    ranked = stored(ranked.withColumn("cap", F.col("source_size") * float(most)), "weights")
    whole = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    per_weight, capped = 0.0, -1
    while True:
        full = F.col("weight") * per_weight > F.col("cap") if capped >= 0 else F.lit(False)
        now = ranked.agg(
            F.count(F.when(full, 1)).alias("capped"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if now["capped"] == capped:
            break
        capped = now["capped"]
        per_weight = max(budget * whole - now["used"], 0.0) / now["open"] if now["open"] else math.inf
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(per_weight)).alias("target"))


def _uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the rows' seeds and the step of the tree only."""
    x = seeds.astype(np.uint64) + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def pivotal(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rounds probabilities so that at most one stays undecided.

    The sum of size * p stays the same, and so does each p in expectation.
    """
    p = p.copy()
    p[p < EXACT], p[p > 1 - EXACT] = 0.0, 1.0
    open_at = -1
    for k in np.flatnonzero((p > 0) & (p < 1)):
        if open_at < 0:
            open_at = k
            continue
        a, b = open_at, k
        # Mass, in words, that can go from b to a, or from a to b.
        up = min((1 - p[a]) * size[a], p[b] * size[b])
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        move = up if draws[k] < down / (up + down) else -down
        p[a] += move / size[a]
        p[b] -= move / size[b]
        for j in (a, b):
            p[j] = 0.0 if p[j] < EXACT else 1.0 if p[j] > 1 - EXACT else p[j]
        undecided = [j for j in (a, b) if 0 < p[j] < 1]
        open_at = undecided[0] if undecided else -1
    return p


def _ordered(table: pd.DataFrame, more: list[str]) -> pd.DataFrame:
    """Large documents first, so that the one left undecided is a small one as a rule."""
    by = ["size", "seed", *more]
    return table.sort_values(by, ascending=[False, *[True] * (len(by) - 1)], kind="stable").reset_index(drop=True)


def _round_level(rows: DataFrame, node: Column, step: int, parts: int) -> DataFrame:
    """Rounds each source within each node of the tree; adds nothing to the columns.

    A node's sources are dealt over ``parts`` groups, so that no group grows with their number.
    """

    def rounded(table: pd.DataFrame) -> pd.DataFrame:
        table = _ordered(table, ["leaf", "row"])
        draws = _uniform(table["seed"].to_numpy(np.int64), step)
        p = table["p"].to_numpy().copy()
        for _, at in table.groupby("source", dropna=False, sort=True).indices.items():
            p[at] = pivotal(table["size"].to_numpy(float)[at], p[at], draws[at])
        return table.assign(p=p)

    part = F.pmod(F.xxhash64("source"), F.lit(parts))
    return rows.groupBy(node.alias("_node"), part.alias("_part")).applyInPandas(rounded, rows.schema)


def row_seed(keys: Sequence[str]) -> Column:
    """A hash of a row that its random numbers come from."""
    return F.xxhash64(F.lit("mix"), *keys, "source", F.coalesce(F.col("text"), F.lit("")))


def mixed(documents: DataFrame, keys: Sequence[str] = ("doc_id",), leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """How often the mix takes each document.

    Returns ``keys``, source, size, source_size, target, copies (0 to 2), taken
    (copies * size) and seed (:func:`row_seed`), one row per row of ``documents``; equal rows are decided each for
    itself. Documents without words, and sources without, take part with size 0:
    they fill no target and are taken 0 times. Null ids and sources are values like others.
    Results depend on the rows alone, not on their partitions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        documents.select(
            *keys, "source", F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"), row_seed(keys).alias("seed")
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sizes), "targets").withColumnRenamed("source", "_source")
    joined = rows.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.least(F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)), F.lit(float(MOST_COPIES)))
    rate = F.when(F.col("size") > 0, rate).otherwise(0.0)
    joined = joined.withColumns({"whole": F.floor(rate).cast("int"), "p": rate - F.floor(rate)})
    leaves = max(1, math.ceil(rows.count() / leaf_rows))
    # ``row`` tells rows apart that are equal in all else, within their leaf.
    joined = joined.withColumns({"leaf": F.pmod(F.col("seed"), F.lit(leaves)).cast("long"), "row": F.lit(0).cast("long")})
    decided = _numbered_leaves(joined)
    decided = stored(decided, "leaves")
    open_rows = decided.where("p > 0 AND p < 1").select("leaf", "row", "source", "size", "seed", "p")
    parts = max(1, math.ceil(goals.count() / GROUP_SOURCES))
    settled, step, nodes = [], 1, leaves
    while nodes > 1:
        nodes = math.ceil(nodes / FAN_IN)
        node = F.floor(F.col("leaf") / FAN_IN**step)
        level = stored(_round_level(open_rows, node, step, parts), "level")
        settled.append(level.where("p = 0 OR p = 1"))
        open_rows = level.where("p > 0 AND p < 1")
        step += 1
    # One document of a source is left at most: it is taken by its probability.
    last = open_rows.withColumn("p", (F.pmod(F.xxhash64("seed", F.lit("last")), F.lit(1 << 30)) / float(1 << 30) < F.col("p")).cast("double"))
    for level in settled:
        last = last.unionByName(level)
    fixed = last.select("leaf", "row", F.col("p").alias("_p"))
    copies = (F.col("whole") + F.coalesce(F.col("_p"), F.col("p")).cast("int")).cast("int")
    return decided.join(fixed, ["leaf", "row"], "left").select(
        *keys, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "seed"
    )


def repeated_by_mix(documents: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows (``columns``) as often as the mix takes them, up to twice each."""
    taken = mixed(documents).groupBy("seed").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    rows = documents.select(*columns, row_seed(["doc_id"]).alias("seed")).join(taken, "seed")
    # Rows that are equal in all else share their copies out among them.
    number = F.row_number().over(Window.partitionBy("seed").orderBy("_copies"))
    each = F.floor(F.col("_copies") / F.col("_rows")) + (number <= F.col("_copies") % F.col("_rows")).cast("int")
    return rows.withColumn("_times", each.cast("int")).where("_times > 0").select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_k")).select(*columns)


def _numbered_leaves(joined: DataFrame) -> DataFrame:
    """Numbers the rows of each leaf and rounds each of its sources."""

    def rounded(table: pd.DataFrame) -> pd.DataFrame:
        table = _ordered(table, [])
        table["row"] = np.arange(len(table))
        draws = _uniform(table["seed"].to_numpy(np.int64) + table["row"].to_numpy(), 0)
        p = table["p"].to_numpy().copy()
        for _, at in table.groupby("source", dropna=False, sort=True).indices.items():
            p[at] = pivotal(table["size"].to_numpy(float)[at], p[at], draws[at])
        return table.assign(p=p)

    return joined.groupBy("leaf").applyInPandas(rounded, joined.schema)


def op1_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
