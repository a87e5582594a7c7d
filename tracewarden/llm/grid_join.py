"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of c or more lie within sqrt(2 - 2c) of each other. Vectors
are sorted by label and by the grid cells of their leading principal coordinates and cut
into blocks, the intervals of that sequence. A tree over the intervals is joined with
itself from the root down: pairs of intervals whose boxes are further apart than that
distance are skipped. The block pairs that remain are gathered in square tiles, so that a
block travels once per tile; there the recursion goes on to intervals of 16 vectors, and
the vectors of the interval pairs that remain are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewarden.llm.components import components
from tracewarden.llm.tables import read_table, stored

COSINE = 0.98
LEADING = 6
BLOCK_ROWS = 256
FAN_OUT = 16
# Side of a tile in blocks, less for long vectors: a side has at most so many bytes, or one block.
TILE_BLOCKS = 32
TILE_BYTES = 32 << 20
INTERVAL_ROWS = 16
# Far above what rounding does to a distance.
SLACK = 1e-7
MOST_PARTITIONS = 20_000
# Vectors that the principal directions are taken from; they decide on speed only.
SAMPLE_ROWS = 2_000


def unit_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, unit): unit vectors as bytes of doubles, null where a vector cannot link.

    That is where it is null, empty or zero or has null or non-finite components.
    """

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
            units: list[bytes | None] = [None] * len(sizes)
            for size in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == size)
                x = values[starts[rows][:, None] + np.arange(size)]
                with np.errstate(all="ignore"):
                    largest = np.abs(x).max(1, keepdims=True)
                    x = x / largest
                    x = x / np.sqrt((x * x).sum(1, keepdims=True))
                for row, unit, good in zip(rows, x, np.isfinite(x).all(1) & np.isfinite(largest[:, 0])):
                    units[row] = unit.tobytes() if good else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(units, pa.binary())], ["vec_id", "label", "dim", "unit"]
            )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(computed, f"vec_id long, label {label}, dim int, unit binary")


def principal_directions(reps: DataFrame, leading: int = LEADING, sample_rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """Orthonormal leading directions for each vector length, from a bounded sample by hashed id."""
    sample = reps.select("dim", "unit", F.xxhash64("rep").alias("_h")).orderBy("_h").limit(sample_rows).select("dim", "unit").collect()
    by_dim: dict[int, list[np.ndarray]] = {}
    for dim, unit in sample:
        by_dim.setdefault(dim, []).append(np.frombuffer(unit))
    return {dim: np.linalg.svd(np.stack(x), full_matrices=False)[2][:leading] for dim, x in by_dim.items()}


def projected(units: np.ndarray, directions: dict[int, np.ndarray], leading: int) -> np.ndarray:
    """Coordinates along the leading directions (the first axes, where the sample had none); missing ones are 0."""
    dim = units.shape[1]
    basis = directions.get(dim)
    found = units[:, :leading] if basis is None else units @ basis.T
    return np.pad(found, ((0, 0), (0, leading - found.shape[1])))


def located(units: np.ndarray, directions: dict[int, np.ndarray], leading: int) -> np.ndarray:
    """The leading coordinates and the norm of the rest; vectors are no nearer to each other than these are."""
    found = projected(units, directions, leading)
    rest = np.sqrt(np.maximum(0.0, 1.0 - (found * found).sum(1, keepdims=True)))
    return np.concatenate([found, rest], axis=1)


def sequence_blocks(reps: DataFrame, epsilon: float, directions: dict[int, np.ndarray], leading: int, block_rows: int) -> DataFrame:
    """Blocks (part, number, label, dim, lo, hi, ids, copies, units) of the grid order of reps."""
    label = reps.schema["label"].dataType.simpleString()

    def with_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            cells = np.zeros((len(dims), leading), np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                units = np.stack([np.frombuffer(batch.column(2)[int(k)].as_py()) for k in rows])
                cells[rows] = np.floor(projected(units, directions, leading) / max(epsilon, 1e-6))
            more = [pa.array(cells[:, k]) for k in range(leading)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *order])

    order = [f"cell_{k}" for k in range(leading)]
    fields = f"label {label}, dim int, unit binary, rep long, copies long, " + ", ".join(f"{c} int" for c in order)
    cells = reps.select("label", "dim", "unit", "rep", "copies").mapInArrow(with_cells, fields)
    keys = ["label", "dim", *order, "rep"]
    ordered = cells.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*order).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, []
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(6))):
                row = [x.as_py() for x in row]
                if held and (len(held) == block_rows or held[-1][:2] != row[:2]):
                    yield block(held, number)
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield block(held, number)

    def block(rows: list, number: int) -> pa.RecordBatch:
        units = np.stack([np.frombuffer(r[2]) for r in rows])
        places = located(units, directions, leading)
        values = [[rows[0][5]], [number], [rows[0][0]], [rows[0][1]], [places.min(0)], [places.max(0)]]
        values += [[np.array([r[k] for r in rows], np.int64).tobytes()] for k in (3, 4)] + [[units.tobytes()]]
        names = ["part", "number", "label", "dim", "lo", "hi", "ids", "copies", "units"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

    types = [pa.int32(), pa.int32(), to_arrow_type(reps.schema["label"].dataType), pa.int32(), *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 3]
    return ordered.mapInArrow(
        cut,
        f"part int, number int, label {label}, dim int, lo array<double>, hi array<double>, ids binary, copies binary, units binary",
    )


def _apart(leading: int, epsilon: float) -> Column:
    """Whether the boxes of intervals a and b are provably further apart than epsilon."""
    total = F.lit(0.0)
    for k in range(leading + 1):
        gap = F.greatest(F.col("a.lo")[k] - F.col("b.hi")[k], F.col("b.lo")[k] - F.col("a.hi")[k], F.lit(0.0))
        total = total + gap * gap
    return total > (epsilon + SLACK) ** 2


def interval_pairs(blocks: DataFrame, epsilon: float, leading: int, fan_out: int) -> DataFrame:
    """Pairs (a, b, dim), a <= b, of blocks by ``seq`` that may hold vectors within epsilon of each other."""
    box = ["seq", "l0", "l1", "d0", "d1", "lo", "hi"]
    levels = [stored(blocks.select("seq", F.col("label").alias("l0"), F.col("label").alias("l1"), F.col("dim").alias("d0"), F.col("dim").alias("d1"), "lo", "hi"), "level")]
    size = blocks.count()
    while size > 1:
        below = levels[-1]
        up = below.groupBy(F.floor(F.col("seq") / fan_out).cast("long").alias("seq")).agg(
            F.min("l0").alias("l0"),
            F.max("l1").alias("l1"),
            F.min("d0").alias("d0"),
            F.max("d1").alias("d1"),
            F.array(*[F.min(F.col("lo")[k]) for k in range(leading + 1)]).alias("lo"),
            F.array(*[F.max(F.col("hi")[k]) for k in range(leading + 1)]).alias("hi"),
        )
        levels.append(stored(up.select(*box), "level"))
        size = math.ceil(size / fan_out)
    pairs = levels[-1].select(F.col("seq").alias("a"), F.col("seq").alias("b"), F.col("d0").alias("dim"))
    for nodes in reversed(levels[:-1]):
        child = nodes.withColumn("up", F.floor(F.col("seq") / fan_out).cast("long"))
        left, right = child.alias("a"), child.alias("b")
        pairs = stored(
            pairs.alias("p")
            .join(left, F.col("p.a") == F.col("a.up"))
            .join(right, (F.col("p.b") == F.col("b.up")) & (F.col("a.seq") <= F.col("b.seq")))
            .where("a.l0 <= b.l1 AND b.l0 <= a.l1 AND a.d0 <= b.d1 AND b.d0 <= a.d1")
            .where(~_apart(leading, epsilon))
            .select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), F.col("a.d0").alias("dim")),
            "pairs",
        )
    return pairs


def numbered(blocks: DataFrame) -> DataFrame:
    """Adds ``seq``, the place of a block in the whole sequence; only a count per partition meets on the driver."""
    counts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offsets, before = [], 0
    for row in counts:
        offsets += [F.lit(row["part"]), F.lit(before)]
        before += row["n"]
    seq = F.element_at(F.create_map(*offsets), F.col("part")) + F.col("number") if offsets else F.lit(0)
    return blocks.withColumn("seq", seq.cast("long"))


def tiled(pairs: DataFrame, block_rows: int, tile_blocks: int) -> DataFrame:
    """(tile, seq, partners): each block that a tile needs, once, with the blocks it is compared to there."""
    side = F.greatest(F.lit(1), F.least(F.lit(tile_blocks), F.floor(TILE_BYTES / (8 * block_rows * F.col("dim")))))
    tile = F.xxhash64("dim", F.floor(F.col("a") / side), F.floor(F.col("b") / side))
    roles = pairs.select(tile.alias("tile"), "a", "b")
    nothing = F.lit(None).cast("long")
    return (
        roles.select("tile", F.col("a").alias("seq"), "b")
        .unionByName(roles.select("tile", F.col("b").alias("seq"), nothing.alias("b")))
        .groupBy("tile", "seq")
        .agg(F.collect_set("b").alias("partners"))
    )


class Tile:
    """The blocks of a tile, their intervals and what was found about their vectors."""

    def __init__(self, rows: list[tuple], directions: dict[int, np.ndarray], leading: int, interval_rows: int):
        self.seqs, dims, self.partners, ids, copies, units = zip(*rows)
        self.ids = np.concatenate([np.frombuffer(x, np.int64) for x in ids])
        self.copies = np.concatenate([np.frombuffer(x, np.int64) for x in copies]).astype(np.float64)
        self.x = np.concatenate([np.frombuffer(x).reshape(-1, dims[0]) for x in units])
        sizes = np.array([len(x) // 8 for x in ids])
        ends = np.cumsum(sizes)
        cuts = [np.arange(end - size, end, interval_rows) for size, end in zip(sizes, ends)]
        self.first = np.concatenate([*cuts, [ends[-1]]])
        self.of_block = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
        places = located(self.x, directions, leading)
        self.lo = np.minimum.reduceat(places, self.first[:-1])
        self.hi = np.maximum.reduceat(places, self.first[:-1])
        self.links = np.zeros(len(self.ids))
        self.root = np.arange(len(self.ids))

    def compare(self, epsilon: float, cosine: float) -> None:
        at = {seq: k for k, seq in enumerate(self.seqs)}
        for block, partners in enumerate(self.partners):
            own = self.seqs[block] in partners
            others = [np.arange(self.of_block[at[b]], self.of_block[at[b] + 1]) for b in sorted(partners) if b != self.seqs[block]]
            edges = [(np.arange(len(self.root)), self.root)]
            for p in range(self.of_block[block], self.of_block[block + 1]):
                mine = [np.arange(p, self.of_block[block + 1])] if own else []
                if mine or others:
                    edges += self.compare_interval(p, np.concatenate(mine + others), epsilon, cosine)
            if len(edges) > 1:
                self.root = roots_of(len(self.root), *(np.concatenate(side) for side in zip(*edges)))

    def compare_interval(self, p: int, intervals: np.ndarray, epsilon: float, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Counts the links between interval p and others; gives pairs that join the same vectors as the links do.

        These are at most one per vector of the others and one per pair within p.
        """
        gap = np.maximum(np.maximum(self.lo[p] - self.hi[intervals], self.lo[intervals] - self.hi[p]), 0.0)
        near = intervals[(gap * gap).sum(1) <= (epsilon + SLACK) ** 2]
        if not len(near):
            return []
        sizes = self.first[near + 1] - self.first[near]
        columns = np.repeat(self.first[near] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        rows = np.arange(self.first[p], self.first[p + 1])
        hit = self.x[rows] @ self.x[columns].T >= cosine
        hit[rows[:, None] == columns] = False
        columns, hit = columns[hit.any(0)], hit[:, hit.any(0)]
        if not len(columns):
            return []
        weight = hit.astype(np.float64)
        self.links[rows] += weight @ self.copies[columns]
        outside = (columns < rows[0]) | (columns > rows[-1])
        self.links[columns[outside]] += (self.copies[rows] @ weight)[outside]
        i, j = np.nonzero(weight @ weight.T)
        return [(rows[hit.argmax(0)], columns), (rows[i], rows[j])]

    def found(self) -> pa.RecordBatch | None:
        some = np.flatnonzero(self.links)
        if not len(some):
            return None
        links = self.links[some].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.array(links), pa.array(self.ids[self.root[some]])], ["rep", "links", "root"])


def block_links(
    pairs: DataFrame,
    blocks: DataFrame,
    cosine: float,
    directions: dict[int, np.ndarray],
    leading: int,
    block_rows: int = BLOCK_ROWS,
    tile_blocks: int = TILE_BLOCKS,
    interval_rows: int = INTERVAL_ROWS,
) -> DataFrame:
    """(rep, links, root) of each vector with links within each tile.

    ``links`` counts linked vectors, copies included; ``root`` is a vector that it hangs
    together with. No pair of vectors leaves the task that compares them.
    """
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    tiles = stored(tiled(pairs, block_rows, tile_blocks), "tiles")
    size = tiles.select("tile").distinct().count()
    data = ["dim", "ids", "copies", "units"]
    # A number of partitions that follows the tiles: they are few bytes and much work.
    spread = tiles.join(blocks.select("seq", *data), "seq").select("tile", "seq", "dim", "partners", *data[1:])
    spread = spread.repartition(max(1, min(size, MOST_PARTITIONS)), "tile").sortWithinPartitions("tile", "seq")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list) -> Iterator[pa.RecordBatch]:
            if rows:
                tile = Tile(rows, directions, leading, interval_rows)
                tile.compare(epsilon, cosine)
                yield from filter(None, [tile.found()])

        now, held = None, []
        for batch in batches:
            for row in zip(*batch.columns):
                tile, *rest = (x.as_py() for x in row)
                if tile != now:
                    yield from done(held)
                    now, held = tile, []
                held.append(tuple(rest))
        yield from done(held)

    return spread.mapInArrow(compared, "rep long, links long, root long")


def roots_of(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``size`` items, the smallest item number that pairs (i, j) join it to."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    leading: int = LEADING,
    block_rows: int = BLOCK_ROWS,
    fan_out: int = FAN_OUT,
    tile_blocks: int = TILE_BLOCKS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, label, embedding).

    Vectors link when labels are equal and not null, lengths are equal and the cosine is
    ``cosine`` or more. Null, empty and zero vectors, such with null or non-finite
    components, and rows with a null vec_id link with nothing and are kept. Rows that
    repeat an id count as vectors of their own. Equal vectors are compared once and
    counted as often as they occur; ``component_id`` is the smallest id reachable by links.
    Labels may have any type that Spark can order; NaN equals NaN.
    """
    rows = stored(unit_rows(vectors).withColumn("key", F.sha2("unit", 256)), "units")
    able = rows.where("unit IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    reps = stored(able.groupBy("label", "dim", "unit", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    directions = principal_directions(reps, leading)
    blocks = stored(sequence_blocks(reps, epsilon, directions, leading, block_rows), "blocks")
    blocks = numbered(blocks)
    pairs = interval_pairs(blocks, epsilon, leading, fan_out)
    links = stored(block_links(pairs, blocks, cosine, directions, leading, block_rows, tile_blocks), "links")
    linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    found = (
        reps.select("label", "dim", "key", "rep", "copies")
        .join(linked, "rep", "left")
        .join(joined, "rep", "left")
        .select(
            F.col("label").alias("_label"),
            F.col("dim").alias("_dim"),
            F.col("key").alias("_key"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    same = (F.col("key") == F.col("_key")) & (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & F.col("vec_id").isNotNull()
    return rows.select("vec_id", "label", "dim", "key").join(found, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def op2_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of the whole table."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS e
    FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
      AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x for x in embedding if x <> 0]) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
found AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM found
"""
