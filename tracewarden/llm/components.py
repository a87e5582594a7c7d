"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.tables import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (hi, lo): links to a node's neighbours become links to its smallest one."""
    pairs = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if large:
        pairs = pairs.unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        new = joined.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        new = joined.select("u", "v", "m").select(F.explode(F.array("u", "v")).alias("hi"), F.col("m").alias("lo"))
    return new.where("hi > lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) joins to another one.

    A component's id is its smallest node. Null ends and loops count for nothing. Each round writes a
    table of at most as many rows as there are edges; the rounds grow with the logarithm of the
    longest chain. Neighbour lists are never gathered: a node's smallest neighbour is an aggregate.
    """
    now = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo"))
        .distinct(),
        "edges",
    )
    sign = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h")).first()
        if seen == sign or not seen["n"]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        sign = seen
        now = stored(_stars(_stars(now, large=True), large=False), "edges")
