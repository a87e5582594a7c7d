"""Runs of periodically repeated words within a document, by maximal pairs.

A maximal pair is two equal stretches of words that differ in the word before and in the
word behind. If the distance q of its places is no more than its length, the words from the
first stretch's begin to the second's end have period q and go on to neither side: a run.

The pairs come from the suffixes of a document's words. Suffixes in order, with the common
lengths of neighbours, form a tree of LCP intervals, walked bottom-up: each interval lists
the places where its common beginning occurs, each with its left word as class. Places of
different children have different words behind, those of different classes different words
before. Of all such pairs only neighbours in place are looked at: where a stretch of at
least q words occurs at i and i + q and in between as well, q is a multiple of a smaller
period, and the pair is no run of its own. So no pair has to be extended or filtered.

Suffixes whose first words occur only once cannot take part. Most documents have no others, which
one sort of hashed windows tells for a whole chunk of texts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.tables import read_table
from tracewarden.llm.words import RangeHashes, Texts, chunks, row_ranges

MIN_LENGTH = 12
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def repetitive(texts: Texts, hashes: np.ndarray, window: int) -> np.ndarray:
    """The texts in which some ``window`` consecutive words occur twice."""
    at = texts.windows(window)
    owner = texts.text_of[at]
    value = RangeHashes(hashes).of(at, at + window) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(value)
    again = value[order][1:] == value[order][:-1]
    return np.unique(owner[order[1:][again]])


def sorted_suffixes(words: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order of their words (by hash), a suffix before those that go on behind it.

    Ranks of one word are doubled to 2, 4, 8 ... words; only ties are sorted again.
    """
    n = len(words)
    _, rank, size = np.unique(words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[rank]  # of equal ones, the place of the first
    tied, step = np.arange(n), 1
    while len(tied):
        behind = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)], -1)
        order = np.lexsort((behind, rank[tied]))
        tied, behind = tied[order], behind[order]
        old = rank[tied]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        new = group | np.concatenate([[True], behind[1:] != behind[:-1]])
        place = np.flatnonzero(new)[np.cumsum(new) - 1] - np.flatnonzero(group)[np.cumsum(group) - 1]
        rank[tied] = old + place
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    return np.argsort(rank)


def common_lengths(ranges: RangeHashes, order: np.ndarray, n: int) -> np.ndarray:
    """Words that each suffix of ``order`` shares with the one before it; 0 for the first."""
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), np.int64)
    step = 1 << max(n.bit_length() - 1, 0)
    while step:
        rows = np.flatnonzero(np.maximum(a, b) + shared + step <= n)
        x, y = a[rows] + shared[rows], b[rows] + shared[rows]
        shared[rows[ranges.of(x, x + step) == ranges.of(y, y + step)]] += step
        step >>= 1
    return np.concatenate([[0], shared])


def maximal_runs(words: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``min_length`` words and two periods, by start and period."""
    n, window = len(words), max(1, -(-min_length // 2))
    if n < max(min_length, 2):
        return []
    order = sorted_suffixes(words)
    shared = common_lengths(RangeHashes(words), order, n)
    shared[shared < window] = 0
    inner = np.flatnonzero((shared > 0) | np.concatenate([shared[1:] > 0, [False]]))
    word = [None, *words.tolist(), None]  # word[k + 1] is word k; there is none before and behind
    found: set[tuple[int, int, int]] = set()

    def pair(i: int, j: int, length: int) -> None:
        period = j - i
        if period <= length and length + period >= min_length:
            # Other classes (left words) and other children (right words)?
            differ = i == 0 or word[i] != word[j]
            if differ and (j + length == n or word[i + length + 1] != word[j + length + 1]):
                found.add((i, length + period, period))

    def interval(length: int, children: list[list[int]]) -> list[int]:
        """The interval's places in order; its pairs are between places of different children."""
        largest = max(children, key=len)
        joined = [place for child in children if child is not largest for place in child]
        if len(joined) * 8 > len(largest):
            places = sorted(largest + joined)
        else:
            places = largest
            for place in joined:
                insort(places, place)
        for place in joined:
            k = bisect_left(places, place)
            if k:
                pair(places[k - 1], place, length)
            if k + 1 < len(places):
                pair(place, places[k + 1], length)
        return places

    stack: list[tuple[int, list[list[int]]]] = []  # open intervals, each within the one before it
    last: list[int] = []  # the leaf or closed interval just passed

    def close_above(length: int, last: list[int]) -> list[int]:
        while stack and stack[-1][0] > length:
            top, children = stack.pop()
            last = interval(top, [*children, last])
        return last

    for place, length in zip(order[inner].tolist(), shared[inner].tolist()):
        last = close_above(length, last)
        if length and stack and stack[-1][0] == length:
            stack[-1][1].append(last)
        elif length:
            stack.append((length, [last]))
        last = [place]
    close_above(0, last)
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run has behind its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def periodic_runs(documents: DataFrame, keep: Sequence[str] = ("doc_id",), min_length: int = MIN_LENGTH) -> DataFrame:
    """Columns ``keep``, n_words, runs and collapsed of every row of ``documents``.

    ``runs`` has (start, length, period) in words of each stretch with smallest period q and
    at least ``min_length`` and 2 q words that no neighbouring word extends, by start and period.
    ``collapsed`` has the words that no run holds behind its first q, joined by single
    spaces. A null text has no words; its row has no runs and an empty text. Rows that repeat an id
    are each judged alone. Words are compared by 64-bit hashes. ``keep`` must not name a result.
    """
    width = len(keep)
    rows = documents.select(*keep, F.col("text").alias("_text"))
    added = T.StructType().add("n_words", "long").add("runs", T.DataType.fromDDL(RUNS)).add("collapsed", "string")
    schema = T.StructType(rows.schema.fields[:width] + added.fields)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def found_in(batch: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        hashes = texts.word_hashes()
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts.counts]
        for k in repetitive(texts, hashes, max(1, -(-min_length // 2))).tolist():
            runs[k] = maximal_runs(hashes[texts.first[k] : texts.first[k + 1]], min_length)
        data, left = texts.data.tobytes(), []
        for a, b, found in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), runs):
            words = data[a:b].split()  # bytes are split at ASCII white space only
            left.append(b" ".join(collapsed(words, found) if found else words))
        counts = [len(r) for r in runs]
        flat = np.array([run for r in runs for run in r], np.int64).reshape(-1, 3)
        values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.int32()), values)
        columns = [pa.array(texts.counts, pa.int64()), lists.cast(kind), pa.array(left, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], schema.names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch.column(width)):
                yield found_in(batch.slice(part.start, part.stop - part.start), texts)

    return rows.mapInArrow(find, schema)


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by crc32 of the id, end in a repetition of some of their words.

    Texts of null are left alone; a null id counts as one without digits.
    """

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end in row_ranges(batch.column(1)):
                texts = batch.column(1).slice(row, end - row).cast(pa.binary()).to_pylist()
                for k, doc_id in enumerate(batch.column(0).slice(row, end - row).to_pylist()):
                    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
                    words = (texts[k] or b"").split() if h % 10 == 0 else []
                    if words:
                        n, g = len(words), h // 10
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        texts[k] = b" ".join(words[i if i < a else a + (i - a) % p] for i in range(n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(plant, rows.schema)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document (a tenth of them with planted ones), and its text without the repeated words."""
    found = periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("below"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_run"), F.array_join(lines, "").alias("_lines"), "collapsed")
    length, period = -F.col("_run.below"), F.col("_run.period")
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("_run.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.col("_lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# A run has q <= 6 and six equal words at its start and q words on, or q > 6 and more. So all
# (place, q) with six equal words, joined to stretches, hold every run.
ORACLE = r"""
WITH ids AS (
    SELECT DISTINCT doc_id,
           list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
               lambda s, b: list_reduce(list_concat([xor(s, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS c
    FROM documents
),
raw AS (
    SELECT d.doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w0,
           xor(c, 4294967295::BIGINT) AS h
    FROM documents d JOIN ids USING (doc_id)
),
cuts AS (SELECT doc_id, w0, len(w0) AS n, h % 10 = 0 AND len(w0) > 0 AS planted, h // 10 AS g, (h // 10) % greatest(len(w0), 1) AS a FROM raw),
d AS (
    SELECT doc_id, n, CASE WHEN planted THEN
               list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
           ELSE w0 END AS w
    FROM cuts
),
places AS (SELECT doc_id, n, w, unnest(range(n - 5)) AS i FROM d WHERE n >= 12),
windows AS (SELECT doc_id, n, i, hash(array_to_string(w[i + 1:i + 6], ' ')) AS s FROM places),
often AS (SELECT * FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
pairs AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM often x JOIN often y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i
    WHERE 2 * (y.i - x.i) <= x.n
),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
stretches AS (
    SELECT doc_id, q, min(i) AS first, max(i) - min(i) + 6 AS m FROM islands GROUP BY doc_id, q, k HAVING max(i) - min(i) + 6 >= greatest(12 - q, q)
),
runs AS (SELECT doc_id, first AS start, m + q AS length, min(q) AS period FROM stretches GROUP BY doc_id, first, m + q),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
digests AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY doc_id
),
gone AS (SELECT doc_id, start + period AS low, start + length AS high FROM runs),
lost AS (SELECT doc_id, list(DISTINCT i) AS places FROM (SELECT doc_id, unnest(range(low, high)) AS i FROM gone) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM d),
cut AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(places) AS i FROM lost)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length,
       CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best b USING (doc_id) LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
