"""Exact removal of repeated 13-word windows by super-k-mer partitioning.

A window's minimiser is the smallest hash among its runs of three words. Consecutive
windows that share a minimiser overlap in all but one word, so they travel as one
packed string (a super-k-mer) to the bucket of their minimiser. Equal windows have equal
minimisers and meet there, where sorting finds the first document of each.

There are as many buckets as the counted windows need, and minimisers are spread over them by a
hash, so buckets are even at every size of the corpus. Only a single minimiser can be too frequent
for a bucket. Its windows are dealt by a second one of seven words, and travel packed all the same. What
is still too frequent then (one passage in very many documents) is reduced to the first
document per window before the shuffle and joined with that, which Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.tables import read_table, stored
from tracewarden.llm.words import RangeHashes, Texts, chunks, gathered, large_text, mixed, row_ranges

WINDOW = 13
MINIMISER_WORDS = 3
LONGER_WORDS = 7
BUCKET_WINDOWS = 1_500_000
# Most minimisers that are dealt by their longer ones; those beyond only make buckets larger.
MOST_FREQUENT = 1 << 20
# Counters that a task keeps while it looks for frequent minimisers.
COUNTERS = 1 << 17
# Buckets beyond that share partitions, one after the other.
MOST_PARTITIONS = 100_000
_SECOND = np.uint64(0xA24BAED4963EE407)


def minimisers(texts: Texts, hashes: np.ndarray, window: int, size: int = MINIMISER_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The words at which windows start, and the smallest hash of ``size`` words within each."""
    at = texts.windows(window)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    grams = np.arange(len(hashes) - size + 1)
    low = RangeHashes(hashes).of(grams, grams + size)
    need, have = window - size + 1, 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return at, low[at]


def runs_of(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (in ``at``) of runs of consecutive windows that share a value."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero((values[1:] != values[:-1]) | (np.diff(at) != 1)) + 1
    return np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]])


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values a sorted array has."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


@dataclass(frozen=True)
class Plan:
    """How windows are dealt: the number of buckets, minimisers dealt by longer ones, and longer ones that are too frequent."""

    buckets: int
    frequent: np.ndarray
    too_frequent: np.ndarray

    def keys(self, texts: Texts, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words at which windows start, the value that each is dealt by, and whether it does not travel."""
        at, low = minimisers(texts, hashes, window)
        key, stays = mixed(low), np.zeros(len(at), bool)
        often = among(low, self.frequent)
        if often.any():
            longer = minimisers(texts, hashes, window, min(LONGER_WORDS, window))[1]
            key = np.where(often, mixed(longer ^ _SECOND), key)
            stays = often & among(longer, self.too_frequent)
        return at, key, stays


class FrequentValues:
    """Counts of the values that come most often, too low by no more than ``lost`` (a mergeable summary)."""

    def __init__(self, counters: int):
        self.counters, self.lost = counters, 0
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        new, n = np.unique(values, return_counts=True)
        self.values, back = np.unique(np.concatenate([self.values, new]), return_inverse=True)
        self.counts = np.bincount(back, weights=np.concatenate([self.counts, n]), minlength=len(self.values)).astype(np.int64)
        if len(self.values) > self.counters:
            cut = int(np.partition(self.counts, -self.counters - 1)[-self.counters - 1])
            self.lost += cut
            keep = self.counts > cut
            self.values, self.counts = self.values[keep], self.counts[keep] - cut


def frequent_values(
    rows: DataFrame, window: int, bucket_windows: int, expected: int, plan: Plan | None = None
) -> tuple[np.ndarray, int]:
    """Minimisers of half a bucket of windows or more, and the number of all windows.

    With a ``plan`` longer minimisers of the windows of its frequent ones are counted. Each task
    reports what might matter: a value that it leaves out is so rare there that all tasks together leave out an
    eighth of a bucket (by the ``expected`` number of windows).
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = FrequentValues(COUNTERS), 0
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                hashes = texts.word_hashes()
                low = minimisers(texts, hashes, window)[1]
                total += len(low)
                if plan is not None:
                    often = among(low, plan.frequent)
                    low = minimisers(texts, hashes, window, min(LONGER_WORDS, window))[1][often] if often.any() else low[:0]
                found.add(low)
        least = max(1, total * bucket_windows // (8 * max(expected, 1)))
        keep = found.counts >= least
        value = np.concatenate([found.values[keep].view(np.int64), [0]])
        columns = [pa.array(value, mask=np.arange(len(value)) == len(value) - 1), pa.array(np.concatenate([found.counts[keep], [total]]))]
        yield pa.RecordBatch.from_arrays(columns, ["value", "n"])

    counts = rows.select("text").mapInArrow(counted, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    often = F.col("value").isNull() | (F.col("n") >= max(bucket_windows // 2, 1))
    # Bounded by MOST_FREQUENT whatever the corpus; the row of null has all windows.
    listed = counts.where(often).orderBy(F.col("value").isNotNull(), F.col("n").desc(), "value").limit(MOST_FREQUENT + 1).toPandas()
    windows = int(listed["n"][listed["value"].isna()].sum())
    values = listed["value"][listed["value"].notna()].astype("int64").to_numpy()
    return np.sort(values.view(np.uint64)), windows


def plan_of(rows: DataFrame, window: int, bucket_windows: int) -> Plan:
    """Buckets for all windows of ``rows`` (text), and what is too frequent for one."""
    # Words with the space behind them have some six bytes, windows start at nearly every word.
    expected = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    none = np.zeros(0, np.uint64)
    frequent, windows = frequent_values(rows, window, bucket_windows, expected)
    plan = Plan(max(1, -(-windows // bucket_windows)), frequent, none)
    if len(frequent):
        plan = replace(plan, too_frequent=frequent_values(rows, window, bucket_windows, expected, plan)[0])
    return plan


def packed_super_kmers(rows: DataFrame, plan: Plan, window: int) -> DataFrame:
    """Per batch and bucket one row: documents, places and compressed strings of its super-k-mers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            held: dict[int, list] = {}
            for part, texts in chunks(batch.column(2)):
                at, value, stays = plan.keys(texts, texts.word_hashes(), window)
                at, value = at[~stays], value[~stays]
                first, end = runs_of(at, value)
                if not len(first):
                    continue
                bucket = (value[first] % np.uint64(plan.buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                first, end, bucket = first[order], end[order], bucket[order]
                owner = texts.text_of[at[first]]
                data, places = gathered(texts.data, texts.starts[at[first]], texts.ends[at[end - 1] + window - 1])
                where = np.stack([ids[part][owner], keys[part][owner], at[first] - texts.first[owner], np.diff(places)])
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                for a, b in zip(cuts[:-1], cuts[1:]):
                    held.setdefault(int(bucket[a]), []).append((where[:, a:b], data[places[a] : places[b]]))
            for number, parts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([packer.compress(np.hstack([w for w, _ in parts]).tobytes())]),
                        pa.array([packer.compress(np.concatenate([d for _, d in parts]).tobytes())]),
                    ],
                    ["bucket", "places", "packed"],
                )

    return rows.select("doc_id", "key", "text").mapInArrow(pack, "bucket long, places binary, packed binary")


def opened(table: pa.Table) -> Iterator[tuple[np.ndarray, Texts]]:
    """Places and texts of the super-k-mers of each packed row, one row at a time."""
    unpacker = zstandard.ZstdDecompressor()
    for places, packed in zip(table.column("places"), table.column("packed")):
        where = np.frombuffer(unpacker.decompress(places.as_py()), np.int64).reshape(4, -1)
        offsets = np.concatenate([[0], np.cumsum(where[3])])
        yield where, Texts(np.frombuffer(unpacker.decompress(packed.as_py()), np.uint8), offsets)


def repeated_in_bucket(table: pa.Table, window: int) -> pa.Table:
    """(doc_id, key, start, n): runs of windows whose words also start in a smaller document.

    Sorting hashes shows which windows may repeat; only their words are unpacked again, and compared.
    """
    values, docs, kmers, starts, wheres, sizes = [], [], [], [], [], []
    seen = 0
    for where, texts in opened(table):
        at = texts.windows(window)
        owner = texts.text_of[at]
        values.append(RangeHashes(texts.word_hashes()).of(at, at + window))
        docs.append(where[0][owner])
        kmers.append(owner + seen)
        starts.append((where[2][owner] + at - texts.first[owner]).astype(np.int64))
        wheres.append(where)
        sizes.append(len(at))
        seen += where.shape[1]
    value, doc, kmer, start = (np.concatenate(x) for x in (values, docs, kmers, starts))
    del values, docs, kmers, starts
    order = np.argsort(value, kind="stable")
    alike = value[order][1:] == value[order][:-1]
    again = np.sort(order[np.concatenate([[False], alike]) | np.concatenate([alike, [False]])])
    del value, order, alike
    if not len(again):
        return pa.table({name: np.zeros(0, np.int64) for name in ("doc_id", "key", "start", "n")})
    before = np.concatenate([[0], np.cumsum(sizes)])
    bounds = np.searchsorted(again, before)
    words = []
    for number, (_, texts) in enumerate(opened(table)):
        mine = again[bounds[number] : bounds[number + 1]] - before[number]
        if len(mine):
            texts = texts.single_spaced()
            at = texts.windows(window)[mine]
            words.append(large_text(*gathered(texts.data, texts.starts[at], texts.ends[at + window - 1]), pa.large_binary()))
    # Equal numbers for equal words.
    group = np.concatenate([c.indices.to_numpy() for c in pa.chunked_array(words).dictionary_encode().chunks])
    del words
    smallest = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, doc[again])
    hit = again[doc[again] > smallest[group]]
    where = np.hstack(wheres)
    first, end = runs_of(start[hit], kmer[hit])
    owner = kmer[hit[first]]
    return pa.table({"doc_id": where[0][owner], "key": where[1][owner], "start": start[hit[first]], "n": end - first})


def hot_repeats(rows: DataFrame, plan: Plan, window: int) -> DataFrame:
    """The same for windows that do not travel, one row each."""

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for part, texts in chunks(batch.column(2)):
                hashes = texts.word_hashes()
                at, _, stays = plan.keys(texts, hashes, window)
                at = at[stays]
                owner = texts.text_of[at]
                value = RangeHashes(hashes).of(at, at + window).view(np.int64)
                columns = [value, ids[part][owner], keys[part][owner], at - texts.first[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["value", "doc_id", "key", "start"])

    windows = rows.select("doc_id", "key", "text").mapInArrow(hot, "value long, doc_id long, key long, start long")
    # Stored, so that the join knows its size and can split hot windows between tasks.
    firsts = stored(
        windows.groupBy("value")
        .agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("last"))
        .where("smallest < last")
        .drop("last"),
        "firsts",
    )
    return windows.join(firsts, "value").where("doc_id > smallest").select("doc_id", "key", "start", F.lit(1).cast("long").alias("n"))


def repeated_windows(documents: DataFrame, window: int = WINDOW, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """(doc_id, key, start, n): runs of n windows from word ``start`` that occur in a document with a smaller id.

    ``key`` is the hash of the text, which tells rows apart that share an id. Rows with a
    null id or text have no windows. Words are compared, but for windows that do not travel (by 64-bit hashes).
    """
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text"
    )
    plan = plan_of(rows, window, bucket_windows)
    found = (
        packed_super_kmers(rows, plan, window)
        .repartition(min(plan.buckets, MOST_PARTITIONS), "bucket")
        .groupBy("bucket")
        .applyInArrow(lambda table: repeated_in_bucket(table, window), "doc_id long, key long, start long, n long")
    )
    if len(plan.too_frequent):
        found = found.unionByName(hot_repeats(rows, plan, window))
    return found


def without_repeats(documents: DataFrame, repeats: DataFrame, window: int, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, text, n_words, n_removed and kept_text of every row.

    Words covered by a repeated window are gone from ``kept_text``, where words are
    joined by single spaces; a null text has none. ``text`` is as it was.
    """
    lists = (
        repeats.groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("start", "n")).alias("_runs"))
        .select(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key"), F.col("_runs.start").alias("_starts"), F.col("_runs.n").alias("_counts"))
    )
    rows = documents.select(*keep, "text")
    same = (F.col("doc_id") == F.col("_doc_id")) & (F.xxhash64("text") == F.col("_key"))
    joined = rows.join(lists, same, "left").select(*keep, "text", "_starts", "_counts")
    width = len(keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (row, end) in ((b, part) for b in batches for part in row_ranges(b.column(width))):
            batch = batch.slice(row, end - row)
            sizes, removed, kept = [], [], []
            for text, starts, counts in zip(*(batch.column(width + k) for k in range(3))):
                words = (text.as_py() or "").encode().split()  # bytes split at ASCII spaces only
                stay = words
                if starts.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    first, n = starts.values.to_numpy(), counts.values.to_numpy()
                    np.add.at(edges, first, 1)
                    np.add.at(edges, first + n + window - 1, -1)
                    stay = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                sizes.append(len(words))
                removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay).decode())
            columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], *columns], [*keep, "text", "n_words", "n_removed", "kept_text"])

    added = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return joined.mapInArrow(cut, T.StructType(rows.schema.fields + added.fields))


def op5_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that an earlier document has."""
    documents = read_table(spark, sf_dir, "documents")
    kept = without_repeats(documents, repeated_windows(documents), WINDOW)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_STATEMENT = """
WITH d AS (
    SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w
    FROM documents
),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - {last})) AS i FROM d WHERE len(w) > {last}),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {last}], ' ') AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (
    SELECT DISTINCT doc_id, i + k AS i
    FROM (SELECT w.doc_id, w.i FROM windows w JOIN firsts f ON w.s = f.s AND w.doc_id > f.first), generate_series(0, {last}) g(k)
),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
kept AS (
    SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS text
    FROM words WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = words.doc_id AND g.i = words.i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def repeats_oracle(window: int) -> str:
    """DuckDB SQL for the words that repeated windows of this size cover."""
    return _STATEMENT.format(last=window - 1)


ORACLE = repeats_oracle(WINDOW)
