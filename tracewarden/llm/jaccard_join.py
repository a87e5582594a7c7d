"""Near-duplicate documents by the Jaccard similarity of their five-word shingles.

MinHash bands bring candidates together. Candidates that share a bucket with a common
smallest document are cut into blocks, and a few blocks with the same smallest document
make a group. Groups that share a bucket meet in a tile, so that a text travels once per
tile, and only its blocks that share a bucket are compared. Within a pair of blocks
MinHash values are compared eight at a time; a pair of
documents is dropped once the posterior probability that it reaches the threshold falls
below a tolerance, and what is left is verified on whole shingle sets. Counts
and group roots leave the task, pairs do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.bitmaps import bit_places, bitmap_of, has_bit
from tracewarden.llm.components import components
from tracewarden.llm.grid_join import roots_of
from tracewarden.llm.tables import read_table, stored
from tracewarden.llm.words import RangeHashes, Texts, chunks, mixed

SHINGLE = 5
# The threshold as a fraction of whole numbers, so that no rounding decides.
SIMILARITY = (4, 5)
# A pair at the threshold shares no band with probability (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, BAND_ROWS = 24, 4
STEP = 8
# Bounds the posterior at each look; over all 12 looks a pair at the threshold is pruned with probability 1.0e-8.
TOLERANCE = 1e-9
BLOCK_DOCUMENTS = 512
BLOCK_SHINGLES = 500_000
# Blocks of a group. A tile compares at most the square of this number of pairs of blocks, and n texts
# of one group of near copies travel n / (16 * 512) times each.
TILE_BLOCKS = 16
SETS_KEPT = 1 << 23  # shingles of unpacked texts that a tile holds on to
# Groups of a bucket are dealt over a square whose cells pair about this many with as many others.
CELL_GROUPS = 128
FILTER_BITS = 26

_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(0, 1 << 31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _rng.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)


def shingles(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle, repeats included; a shorter text's words are its one shingle."""
    hashes = RangeHashes(texts.word_hashes())
    at = texts.windows(size)
    short = np.flatnonzero((texts.counts > 0) & (texts.counts < size))
    owner = np.concatenate([texts.text_of[at], short])
    value = np.concatenate([hashes.of(at, at + size), hashes.of(texts.first[short], texts.first[short + 1])])
    order = np.argsort(owner, kind="stable")
    return owner[order], value[order]


def signatures(texts: Texts) -> np.ndarray:
    """MinHash values of each text; those of a text without words mean nothing."""
    owner, value = shingles(texts)
    out = np.zeros((len(texts.counts), BANDS * BAND_ROWS), np.uint32)
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        low = (value >> np.uint64(32)).astype(np.uint32)
        for k in range(BANDS * BAND_ROWS):
            out[owner[first], k] = np.minimum.reduceat(low * _FACTORS[k] + _OFFSETS[k], first)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One hash per text and band."""
    parts = signature.reshape(len(signature), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


@cache
def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values of ``compared`` for which the threshold is still likely enough.

    With a uniform prior, the similarity given m equal values of n is Beta(m + 1, n - m + 1), and
    it exceeds t with the probability that a binomial of n + 1 trials at t is at most m.
    """
    total = 0.0
    for m in range(compared + 2):
        total += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared + 1


def surviving_pairs(a: np.ndarray, b: np.ndarray, own: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature tables (of one with itself, if ``own``) that are not pruned.

    As long as many pairs are left, a look compares whole columns; afterwards only the values of those left.
    """
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    columns = np.ascontiguousarray(b.T)
    rows = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), rows):
        part = np.ascontiguousarray(a[at : at + rows].T)
        alive = np.arange(at, at + part.shape[1])[:, None] < np.arange(len(b)) if own else np.ones((part.shape[1], len(b)), bool)
        equal = np.zeros(alive.shape, np.int16)
        k = 0
        while k < len(columns) and 8 * np.count_nonzero(alive) > alive.size:
            for c in range(k, k + STEP):
                equal += part[c][:, None] == columns[c]
            k += STEP
            alive &= equal >= least_matches(k, threshold, tolerance)
        i, j = np.nonzero(alive)
        equal = equal[i, j]
        while k < len(columns) and len(i):
            equal = equal + (a[at + i, k : k + STEP] == b[j, k : k + STEP]).sum(1, dtype=np.int16)
            k += STEP
            left = equal >= least_matches(k, threshold, tolerance)
            i, j, equal = i[left], j[left], equal[left]
        found_i.append(at + i)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets i and j.

    Few pairs are intersected one by one; for many, membership of the shingles that
    occur in more than one set is multiplied out, a bounded number of them at a time.
    """
    used = np.unique(np.concatenate([i, j]))
    if len(i) < 4 * len(used):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    value, number, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    rank = np.full(len(value), -1)
    rank[times > 1] = np.arange((times > 1).sum())
    column = rank[number]
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0) :]
    column, owner = column[order], owner[order]
    left, i = np.unique(i, return_inverse=True)
    right, j = np.unique(j, return_inverse=True)
    upper, lower = np.searchsorted(used, left), np.searchsorted(used, right)
    both = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for at in range(0, int((times > 1).sum()), step):
        part = slice(*np.searchsorted(column, [at, at + step]))
        member = np.zeros((len(used), step), np.float32)
        member[owner[part], column[part] - at] = 1
        both += member[upper] @ member[lower].T
    return both[i, j].astype(np.int64)


class Tile:
    """The texts of one or two groups of blocks, each text once, ordered by side and block."""

    def __init__(self, rows: pa.Table):
        side, part, value = (rows.column(k).to_numpy() for k in ("side", "part", "value"))
        _, one = np.unique(value, return_index=True)  # rows that repeat an id and its text are one text here
        one = one[np.lexsort((value[one], part[one], side[one]))]
        side, part = side[one], part[one]
        self.rep, self.copies = (rows.column(k).to_numpy()[one] for k in ("rep", "copies"))
        self.sign = np.stack([np.frombuffer(x, np.uint32) for x in rows.column("signature").take(one).to_pylist()])
        self.packed = rows.column("packed").take(one).to_pylist()
        cuts = np.flatnonzero((side[1:] != side[:-1]) | (part[1:] != part[:-1])) + 1
        self.first = np.concatenate([[0], cuts, [len(side)]])
        self.side = side[self.first[:-1]]
        self.sets: dict[int, np.ndarray] = {}
        self.kept = 0

    def block_pairs(self) -> list[tuple[int, int]]:
        """Pairs of blocks, one of each side (or of the only side), that share a bucket."""
        keys = [np.unique(band_keys(self.sign[at:end])) for at, end in zip(self.first[:-1], self.first[1:])]
        two = self.side[-1] != self.side[0]
        pairs = [(x, y) for x in range(len(keys)) for y in range(x, len(keys)) if not two or self.side[x] != self.side[y]]
        return [(x, y) for x, y in pairs if x == y or len(np.intersect1d(keys[x], keys[y], assume_unique=True))]

    def shingles_of(self, k: int) -> np.ndarray:
        if k not in self.sets:
            text = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed[k]), np.uint8)
            self.sets[k] = np.unique(shingles(Texts(text, np.array([0, len(text)])))[1])
            self.kept += len(self.sets[k])
        return self.sets[k]

    def links_of_blocks(self, x: int, y: int, similarity: tuple[int, int], tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j) of linked texts of blocks x and y."""
        a, b = slice(*self.first[x : x + 2]), slice(*self.first[y : y + 2])
        i, j = surviving_pairs(self.sign[a], self.sign[b], x == y, similarity[0] / similarity[1], tolerance)
        i, j = i + a.start, j + b.start
        if not len(i):
            return i, j
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        if self.kept > SETS_KEPT:
            self.sets, self.kept = {}, 0
        sets = [self.shingles_of(k) for k in used.tolist()]
        size = np.array([len(s) for s in sets])
        left, right = place[: len(i)], place[len(i) :]
        common = common_counts(sets, left, right)
        near = similarity[1] * common >= similarity[0] * (size[left] + size[right] - common)
        return i[near], j[near]


def linked_in_tile(rows: pa.Table, similarity: tuple[int, int], tolerance: float) -> pa.RecordBatch | None:
    """(rep, links, root) of a tile: columns side, part, value, rep, copies, signature, packed."""
    tile = Tile(rows)
    size = len(tile.rep)
    links, edges = np.zeros(size), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for x, y in tile.block_pairs():
        i, j = tile.links_of_blocks(x, y, similarity, tolerance)
        if len(i):
            links += np.bincount(i, weights=tile.copies[j], minlength=size) + np.bincount(j, weights=tile.copies[i], minlength=size)
            root = roots_of(size, i, j)
            moved = np.flatnonzero(root != np.arange(size))  # at most one edge per text leaves a pair of blocks
            edges.append((moved, root[moved]))
    some = np.flatnonzero(links)
    if not len(some):
        return None
    root = roots_of(size, *(np.concatenate(ends) for ends in zip(*edges)))
    return pa.RecordBatch.from_arrays([pa.array(tile.rep[some]), pa.array(links[some].astype(np.int64)), pa.array(tile.rep[root[some]])], ["rep", "links", "root"])


def meeting_cells(met: DataFrame, cell_groups: int) -> DataFrame:
    """(band, x, y, a, b): pairs of groups that share a bucket, by the cell of the bucket's square that makes them.

    The groups of a bucket are dealt over so many places that about ``cell_groups`` share one; a group
    is sent to the cells of its place's row and column, so no cell holds a whole large bucket.
    """
    counts = met.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / cell_groups).cast("int").alias("places"))
    dealt = met.join(counts, "band").withColumn("place", F.pmod(F.xxhash64("group", F.lit("cell")), "places").cast("int"))
    rows = dealt.select("band", F.col("place").alias("x"), F.explode(F.sequence("place", F.col("places") - 1)).alias("y"), F.col("group").alias("a"))
    columns = dealt.select("band", F.explode(F.sequence(F.lit(0), "place")).alias("x"), F.col("place").alias("y"), F.col("group").alias("b"))
    return rows.join(columns, ["band", "x", "y"]).where("x < y OR a <= b")


def signature_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, key, n, signature) of every document with an id; ``key`` stands for its whole text."""
    rows = documents.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("key"), "text"
    )

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch.column(2)):
                n = np.where(texts.counts > 0, np.maximum(texts.counts - SHINGLE + 1, 1), 0)
                sign = pa.array([row.tobytes() for row in signatures(texts)], pa.binary())
                columns = [batch.column(k).slice(part.start, part.stop - part.start) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n), sign], ["doc_id", "key", "n", "signature"])

    return rows.mapInArrow(signed, "doc_id long, key string, n long, signature binary")


def band_rows(reps: DataFrame) -> DataFrame:
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sign = np.stack([np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()])
                rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(band_keys(sign).ravel())], ["rep", "band"])

    return reps.where("n > 0").select("rep", "signature").mapInArrow(banded, "rep long, band long")


def candidate_texts(documents: DataFrame, wanted: bytes, bits: int) -> DataFrame:
    """(rep, key, packed): compressed texts of the documents whose key may be wanted."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("rep"), F.md5("text").alias("key"), "text"
    )
    rows = rows.withColumn("value", F.xxhash64("rep", "key"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, pack = np.frombuffer(wanted, np.uint8), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            # Texts that are not wanted go before any is turned into a Python object.
            value = batch.column(3).to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.flatnonzero(has_bit(bitmap, bit_places(value, bits)))))
            data = pa.array([pack(x.encode()) for x in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], ["rep", "key", "packed"])

    return rows.mapInArrow(packed, "rep long, key string, packed binary")


def near_duplicates(
    documents: DataFrame,
    similarity: tuple[int, int] = SIMILARITY,
    tolerance: float = TOLERANCE,
    block_documents: int = BLOCK_DOCUMENTS,
    block_shingles: int = BLOCK_SHINGLES,
    bits: int = FILTER_BITS,
    tile_blocks: int = TILE_BLOCKS,
    cell_groups: int = CELL_GROUPS,
) -> DataFrame:
    """(doc_id, class_id, n_links, component_id, kept), one row per document.

    Documents link when their texts are equal (null is empty) or the Jaccard similarity of their
    shingle sets is ``similarity`` or more. A text of one to four words has its words as its only
    shingle, one without words has none. ``class_id`` is the smallest id with that text, ``n_links``
    counts the other documents linked directly, ``component_id`` is the smallest id reachable.
    Rows with a null id link with nothing and are kept. Rows that repeat an id count each; with
    different texts they share their links. Each text is compared once.
    """
    signed = stored(signature_rows(documents), "signatures")
    reps = stored(
        signed.groupBy("key").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("signature").alias("signature")
        ),
        "reps",
    )
    bands = stored(band_rows(reps), "bands")
    buckets = bands.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    members = stored(bands.join(buckets.select("band", "first"), "band"), "members")
    # A candidate's anchor is the smallest document that it or a text in one of its buckets shares a bucket with.
    # Without this second step a large group of near copies has dozens of anchors, whose groups all meet.
    near = stored(members.groupBy("rep").agg(F.min("first").alias("anchor")), "anchors")
    least = members.join(near, "rep").groupBy("band").agg(F.min("anchor").alias("least"))
    anchored = members.join(least, "band").groupBy("rep").agg(F.min("least").alias("anchor"))
    candidates = stored(anchored.join(reps, "rep"), "candidates")
    sizes = candidates.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_shingles"))
    parts = F.greatest(F.ceil(F.col("_n") / block_documents), F.ceil(F.col("_shingles") / block_shingles))
    part = F.pmod(F.xxhash64("rep"), parts).cast("long")
    blocked = stored(
        candidates.join(sizes, "anchor")
        .withColumn("part", part)
        .withColumn("group", F.xxhash64("anchor", F.floor(F.col("part") / tile_blocks)))
        .drop("_n", "_shingles", "anchor"),
        "blocked",
    )
    met = stored(members.join(blocked.select("rep", "group"), "rep").select("band", "group").distinct(), "met")
    pairs = meeting_cells(met, cell_groups).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tile = F.xxhash64("a", "b").alias("tile")
    sides = pairs.select(tile, F.col("a").alias("group"), F.lit(0).alias("side")).unionByName(
        pairs.where("a < b").select(tile, F.col("b").alias("group"), F.lit(1).alias("side"))
    )
    wanted = bitmap_of(blocked.select(F.xxhash64("rep", "key").alias("value")), bits)
    texts = stored(blocked.join(candidate_texts(documents, wanted, bits), ["rep", "key"]).withColumn("value", F.xxhash64("rep", "key")).drop("key", "n"), "texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
            for at, end in zip(cuts[:-1], cuts[1:]):
                if held and held[-1].column(0)[0].as_py() != number[at]:
                    yield from filter(None, [linked_in_tile(pa.Table.from_batches(held), similarity, tolerance)])
                    held = []
                if end > at:
                    held.append(batch.slice(at, end - at))
        if held:
            yield from filter(None, [linked_in_tile(pa.Table.from_batches(held), similarity, tolerance)])

    joined = sides.join(texts, "group").select("tile", "side", "part", "value", "rep", "copies", "signature", "packed")
    links = stored(joined.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "rep long, links long, root long"), "links")
    linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    classes = reps.select("key", "rep", "copies").join(linked, "rep", "left").join(groups, "rep", "left")
    found = signed.select("doc_id", "key").join(classes, "key").select(
        "doc_id",
        F.col("rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    found = found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nothing = F.lit(None).cast("long")
    without_id = documents.where("doc_id IS NULL").select(
        nothing.alias("doc_id"), nothing.alias("class_id"), F.lit(0).cast("long").alias("n_links"), nothing.alias("component_id"), F.lit(True).alias("kept")
    )
    return found.unionByName(without_id)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents of the whole table."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


# Needs a relation ``docs`` (doc_id, text).
ORACLE_RELATIONS = """
jw AS (
    SELECT doc_id, coalesce(text, '') AS text, [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w
    FROM docs
),
shingled AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM jw WHERE len(w) > 0)
),
jsize AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
jboth AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
jlinks AS (
    SELECT j.a, j.b FROM jboth j JOIN jsize x ON x.doc_id = j.a JOIN jsize y ON y.doc_id = j.b WHERE 5 * j.n >= 4 * (x.n + y.n - j.n)
    UNION
    SELECT x.doc_id, y.doc_id FROM jw x JOIN jw y ON x.text = y.text AND x.doc_id <> y.doc_id
),
jreach(a, b) AS (
    SELECT doc_id, doc_id FROM jw
    UNION
    SELECT jreach.a, jlinks.b FROM jreach JOIN jlinks ON jreach.b = jlinks.a
),
jgroups AS (SELECT a AS doc_id, min(b) AS component_id FROM jreach GROUP BY a)
"""

ORACLE = f"""
WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {ORACLE_RELATIONS},
counts AS (SELECT a AS doc_id, count(*) AS n FROM jlinks GROUP BY a)
SELECT jw.doc_id, min(jw.doc_id) OVER (PARTITION BY jw.text) AS class_id, coalesce(counts.n, 0) AS n_links,
       component_id, jw.doc_id = component_id AS kept
FROM jw JOIN jgroups USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
