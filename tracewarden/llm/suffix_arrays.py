"""Removal of long passages that an earlier document has, by sparse suffix arrays.

Of every 50-word window the smallest hash of eight consecutive words selects a position,
the same in every text that has the window; only suffixes at such positions are kept,
about one in 22. Equal passages of 50 words or more therefore meet at a kept suffix.
Suffixes whose first eight words occur in one document only are left out after
a first pass; the others are sorted, neighbours are compared, and matches are extended
to the left and right until they reach 50 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.bitmaps import bit_places, bitmap_of, has_bit
from tracewarden.llm.super_kmers import repeats_oracle, runs_of, without_repeats
from tracewarden.llm.tables import read_table, stored
from tracewarden.llm.words import RangeHashes, Texts, chunks, gathered, large_text, mixed, utf8

PASSAGE = 50
ANCHOR_WORDS = 8
# The bitmap that tells which anchors are shared has 16 positions for each, between these powers of two (8 KB and
# 32 MB). A fuller one lets lonely anchors through, and loses none.
FILTER_BITS = (16, 28)
LARGEST_GROUP = 20_000
TASK_ROWS = 20_000


class Suffixes:
    """The suffixes of some texts that are kept: ``at`` (word), ``low`` to ``high`` (windows that selected it)."""

    def __init__(self, texts: Texts, passage: int, anchor: int):
        self.texts, self.hashes = texts, texts.word_hashes()
        windows = texts.windows(passage)
        self.at = self.low = self.high = np.zeros(0, np.int64)
        self.value = np.zeros(0, np.int64)
        if not len(windows):
            return
        grams = np.arange(len(self.hashes) - anchor + 1)
        value = RangeHashes(self.hashes).of(grams, grams + anchor)
        place, have, need = grams, 1, passage - anchor + 1
        low = value
        while have < need:  # the leftmost of the smallest
            step = min(have, need - have)
            left = low[:-step] <= low[step:]
            place = np.where(left, place[:-step], place[step:])
            low = np.where(left, low[:-step], low[step:])
            have += step
        chosen = place[windows]
        first, end = runs_of(windows, chosen)
        self.at, self.low, self.high = chosen[first], windows[first], windows[end - 1]
        # Selected hashes are small ones: mixed, they spread over all bits (equal ones stay equal).
        self.value = mixed(value[self.at]).view(np.int64)

    def owner(self) -> np.ndarray:
        return self.texts.text_of[self.at]


def anchors(rows: DataFrame, passage: int, anchor: int) -> DataFrame:
    """(value, first, last, n) of every anchor: its documents' smallest and largest id, and its suffixes."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part, texts in chunks(batch.column(1)):
                found = Suffixes(texts, passage, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(found.value), pa.array(ids[part][found.owner()])], ["value", "doc_id"])

    values = rows.select("doc_id", "text").mapInArrow(listed, "value long, doc_id long")
    return values.groupBy("value").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))


def shared_suffixes(rows: DataFrame, shared: bytes, hot: bytes, passage: int, anchor: int, bits: int) -> DataFrame:
    """Shared suffixes that are not hot, each with its windows' words before and from its anchor."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, apart = np.frombuffer(shared, np.uint8), np.frombuffer(hot, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for part, texts in chunks(batch.column(2)):
                texts = texts.single_spaced()
                found = Suffixes(texts, passage, anchor)
                place = bit_places(found.value, bits)
                k = np.flatnonzero(has_bit(wanted, place) & ~has_bit(apart, place))
                at, low, high, owner = found.at[k], found.low[k], found.high[k], found.owner()[k]
                before = gathered(texts.data, texts.starts[low], texts.starts[at])
                behind = gathered(texts.data, texts.starts[at], texts.ends[high + passage - 1])
                columns = [pa.array(x) for x in (found.value[k], ids[part][owner], keys[part][owner], low - texts.first[owner], high - low + 1)]
                columns += [large_text(*x, pa.string()) for x in (before, behind)]
                yield pa.RecordBatch.from_arrays(columns, ["value", "doc_id", "key", "start", "n", "before", "behind"])

    schema = "value long, doc_id long, key long, start long, n long, before string, behind string"
    return rows.mapInArrow(listed, schema)


def matched(batch: pa.Table, passage: int) -> pa.RecordBatch:
    """Runs of windows that an earlier document has, among suffixes sorted by (value, behind).

    Holds whole groups of equal ``value``. Neighbours give the length of each common
    beginning; for every number of words to the left of the anchor, the suffixes that
    share enough words to the right are one segment, and those of it that share the
    words to the left match.
    """
    value, doc, key, start, n = (batch.column(k).to_numpy().astype(np.int64) for k in range(5))
    left = Texts(*utf8(batch.column(5)))
    right = Texts(*utf8(batch.column(6)))
    left_hash, right_hash = RangeHashes(left.word_hashes()), right.word_hashes()
    size, depth = len(value), right.counts
    padded = np.concatenate([right_hash, np.zeros(passage, np.uint64)])
    common = np.zeros(size, np.int64)  # words shared with the suffix above
    going = np.concatenate([[False], value[1:] == value[:-1]])
    for k in range(passage):
        rows = np.flatnonzero(going)
        if not len(rows):
            break
        same = (depth[rows] > k) & (depth[rows - 1] > k)
        same &= padded[right.first[rows] + k] == padded[right.first[rows - 1] + k]
        common[rows] += same
        going[rows[~same]] = False
    hits_row, hits_left = [], []
    for words in range(passage):
        # The window that starts so many words before the anchor.
        valid = (left.counts >= words) & (left.counts - words < n)
        segment = np.cumsum((common < passage - words) | np.concatenate([[True], value[1:] != value[:-1]]))
        rows = np.flatnonzero(valid)
        if not len(rows):
            continue
        end = left.first[rows + 1]
        context = left_hash.of(end - words, end)
        order = np.lexsort((doc[rows], context, segment[rows]))
        a, c, d = segment[rows][order], context[order], doc[rows][order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        smallest = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        again = rows[order[d > smallest]]
        hits_row.append(again)
        hits_left.append(np.full(len(again), words))
    row = np.concatenate([np.zeros(0, np.int64), *hits_row])
    window = left.counts[row] - np.concatenate([np.zeros(0, np.int64), *hits_left])  # within its suffix' windows
    order = np.lexsort((window, row))
    first, end = runs_of(window[order], row[order])
    owner = row[order][first]
    columns = [doc[owner], key[owner], start[owner] + window[order][first], end - first]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "key", "start", "n"])


def hot_windows(rows: DataFrame, hot: bytes, passage: int, anchor: int, bits: int) -> DataFrame:
    """Repeats at anchors with too many suffixes for one group: first documents per window, then a join."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(hot, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for part, texts in chunks(batch.column(2)):
                found = Suffixes(texts, passage, anchor)
                k = np.flatnonzero(has_bit(wanted, bit_places(found.value, bits)))
                count = found.high[k] - found.low[k] + 1
                at = np.repeat(found.low[k] - np.cumsum(count) + count, count) + np.arange(count.sum())
                owner = texts.text_of[at] if len(at) else at
                value = RangeHashes(found.hashes).of(at, at + passage).view(np.int64)
                columns = [value, ids[part][owner], keys[part][owner], at - texts.first[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["value", "doc_id", "key", "start"])

    windows = rows.mapInArrow(listed, "value long, doc_id long, key long, start long")
    # Stored, so that the join knows its size and can split hot windows between tasks.
    firsts = stored(
        windows.groupBy("value")
        .agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("last"))
        .where("smallest < last")
        .drop("last"),
        "firsts",
    )
    return windows.join(firsts, "value").where("doc_id > smallest").select("doc_id", "key", "start", F.lit(1).cast("long").alias("n"))


def repeated_passages(
    documents: DataFrame,
    passage: int = PASSAGE,
    anchor: int = ANCHOR_WORDS,
    bits: int | None = None,
    largest_group: int = LARGEST_GROUP,
) -> DataFrame:
    """(doc_id, key, start, n): n windows of ``passage`` words from ``start`` that a document with a smaller id has.

    ``key`` is the hash of the text. Rows with a null id or text have no windows. The
    bitmaps only leave out what cannot match; two anchors that share a bit are compared.
    """
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text"
    )
    common = stored(anchors(rows, passage, anchor).where("first < last").select("value", "n"), "anchors")
    if bits is None:
        bits = int(np.clip((16 * common.count()).bit_length(), *FILTER_BITS))
    shared = bitmap_of(common, bits)
    hot = bitmap_of(common.where(F.col("n") > largest_group), bits)
    suffixes = shared_suffixes(rows, shared, hot, passage, anchor, bits)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < TASK_ROWS:
                continue
            table = pa.Table.from_batches(held)
            value = table.column(0).to_numpy()
            cut = int(np.searchsorted(value, value[-1]))  # the last group may go on
            if cut:
                yield matched(table.slice(0, cut), passage)
            held = table.slice(cut).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield matched(pa.Table.from_batches(held), passage)

    found = suffixes.repartition("value").sortWithinPartitions("value", F.concat("behind", F.lit(" "))).mapInArrow(compare, "doc_id long, key long, start long, n long")
    if any(hot):
        found = found.unionByName(hot_windows(rows, hot, passage, anchor, bits))
    return found


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words or more that an earlier document has."""
    documents = read_table(spark, sf_dir, "documents")
    kept = without_repeats(documents, repeated_passages(documents), PASSAGE)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = repeats_oracle(PASSAGE)
