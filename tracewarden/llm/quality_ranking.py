"""Quality scores learned from preference pairs (Bradley-Terry), cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.bitmaps import bit_places, bitmap_of, has_bit
from tracewarden.llm.tables import fold, read_table, share, stored
from tracewarden.llm.words import RangeHashes, Texts, chunks

ROWS_PER_CLASS = 2_000
HASHED = 256
# Where the cut lies on the score's scale.
CUT_SCORE = 0.3
# Bins of each histogram that narrows the cut down.
CUT_BINS = 4096
FILTER_BITS = 26
EPOCHS = 12
BATCH = 256

_CLASSES = {
    "upper": [*range(0x41, 0x5B)],
    "digit": [*range(0x30, 0x3A)],
    "symbol": [ord(c) for c in "#*$%&|<>=_~^\\{}[]@+/"],
    "stop": [ord(c) for c in ".,;:"],
    "mark": [ord(c) for c in "!?"],
    "other": [*range(0x80, 0x100)],
}


def _means(values: np.ndarray, groups: np.ndarray, size: int, total: np.ndarray) -> np.ndarray:
    return np.bincount(groups, weights=values, minlength=size) / np.maximum(total, 1)


def features(texts: Texts) -> np.ndarray:
    """One row per text: shape of words and lines, repetition, character classes, hashed words."""
    n, counts, owner = len(texts.counts), texts.counts, texts.text_of
    length = (texts.ends - texts.starts).astype(float)
    byte_of = np.repeat(np.arange(n), np.diff(texts.offsets))
    size = np.diff(texts.offsets)
    hashes = texts.word_hashes()
    columns = [np.log1p(counts)]
    mean = _means(length, owner, n, counts)
    columns += [mean, np.sqrt(_means((length - mean[owner]) ** 2, owner, n, counts))]
    lone, last = np.zeros(len(owner)), np.zeros(len(owner))
    marked = np.zeros(len(owner))
    for members in _CLASSES.values():
        table = np.zeros(256)
        table[members] = 1
        hit = table[texts.data]
        columns.append(_means(hit, byte_of, n, size))
        sums = np.concatenate([[0], np.cumsum(hit)])
        within = sums[texts.ends] - sums[texts.starts]
        marked = np.maximum(marked, (within >= 2).astype(float)) if members[0] != 0x80 else marked
        lone = np.maximum(lone, ((within == 1) & (length == 1)).astype(float))
        last = last + (table[texts.data[texts.ends - 1]] if len(owner) else 0)
    columns += [_means(x, owner, n, counts) for x in (lone, last, marked)]
    before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]]) if len(hashes) else hashes
    same = (hashes == before) & (owner == np.concatenate([[-1], owner[:-1]])) if len(hashes) else np.zeros(0, bool)
    columns.append(np.sqrt(_means(same.astype(float), owner, n, counts)))
    runs = np.cumsum(~same)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, np.bincount(runs)[runs] if len(runs) else 0.0)
    columns.append(np.log1p(longest))
    for words in (1, 3):
        at = texts.windows(words)
        value = RangeHashes(hashes).of(at, at + words)
        order = np.lexsort((value, owner[at]))
        repeat = np.zeros(len(at))
        if len(at) > 1:
            a, b = order[1:], order[:-1]
            repeat[a] = (value[a] == value[b]) & (owner[at[a]] == owner[at[b]])
        columns.append(_means(repeat, owner[at], n, counts))
    newline = (texts.data == 0x0A).astype(float)
    columns.append(np.log1p(np.bincount(byte_of, weights=newline, minlength=n)))
    columns.append(_means(newline, byte_of, n, counts))
    hashed = np.bincount(owner * HASHED + (hashes & np.uint64(HASHED - 1)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    # Words of short texts say little: smoothing keeps their hashed part near zero.
    return np.hstack([np.stack(columns, 1), hashed / (counts + 50.0)[:, None]])


@dataclass
class RankingModel:
    """A text's utility is ``weights`` times its standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Utility as a number from 0 to 1 that is ``CUT_SCORE`` at the cut."""
        offset = np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(self.utility(x) - self.cut + offset, -500, 500)))


def quantile_cut(values: DataFrame) -> float | None:
    """Midway between the values around the place below which the share of label 0 lies.

    ``values`` has label and utility, one row per labelled text. Histograms, each of the bin of the
    one before that has the place, find the exact value; a few thousand counts reach the driver.
    """
    u = F.col("utility")
    whole = values.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("below"), F.min(u).alias("low"), F.max(u).alias("high")
    ).first()
    if not 0 < whole["below"] < whole["n"]:
        return None

    def ranked(rank: int) -> float:
        low, high = whole["low"], whole["high"]
        while low < high:
            place = F.least(F.floor((u - low) / (high - low) * CUT_BINS), F.lit(CUT_BINS - 1)).alias("bin")
            bins = values.where(u.between(low, high)).groupBy(place)
            for part in sorted(bins.agg(F.count(F.lit(1)).alias("n"), F.min(u).alias("low"), F.max(u).alias("high")).collect()):
                if rank < part["n"]:
                    low, high = part["low"], part["high"]
                    break
                rank -= part["n"]
        return low

    return (ranked(whole["below"] - 1) + ranked(whole["below"])) / 2


def train(x: np.ndarray, label: np.ndarray, seed: int = 11) -> RankingModel:
    """Bradley-Terry by stochastic gradient descent on pairs of a preferred and another text.

    The cut is left at 0. Without both labels all utilities are 0 and every score is ``CUT_SCORE``.
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    if not len(x):
        return RankingModel(np.zeros(width), np.ones(width), np.zeros(width))
    model = RankingModel(x.mean(0), np.maximum(x.std(0), 1e-3), np.zeros(width))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return model
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    first, second = np.zeros(width), np.zeros(width)  # moments of the gradient
    steps = 0
    for epoch in range(EPOCHS):
        pairs = max(len(good), len(bad))
        a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
        for at in range(0, pairs, BATCH):
            difference = z[a[at : at + BATCH]] - z[b[at : at + BATCH]]
            lost = 1 / (1 + np.exp(np.clip(difference @ model.weights, -500, 500)))
            gradient = -(difference * lost[:, None]).mean(0) + 1e-3 * model.weights
            steps += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            rate = 0.05 * (1 - epoch / EPOCHS)
            model.weights -= rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.99**steps)) + 1e-8)
    return model


def text_features(rows: DataFrame) -> DataFrame:
    """(label, x) of rows (label, text)."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch.column(1)):
                x = pa.array(list(features(texts)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), x], ["label", "x"])

    return rows.select("label", "text").mapInArrow(computed, "label int, x array<double>")


def learn(documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> RankingModel:
    """A model fitted on about ``rows_per_class`` labelled documents of either label, chosen by hashed id.

    ``labels`` has doc_id and quality; null qualities and ids do not count. The
    sample (at most four times ``rows_per_class`` rows) is what reaches the driver, as
    feature rows. Only the fit rests on it: the cut is the quantile, at the share of label 0, of
    the utilities of all labelled documents.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for value, n in totals.items():
        rate = F.when(F.col("label") == value, min(1.0, rows_per_class / n)).otherwise(rate)
    chosen = known.where(share("quality sample", F.col("doc_id")) < rate).limit(4 * rows_per_class)
    # At most 4 * rows_per_class rows of two numbers, so it is small enough to send to every executor.
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").limit(4 * rows_per_class)
    rows = text_features(sample).toPandas()
    width = features(Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))).shape[1]
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), width)
    order = np.lexsort((*x.T[:6], rows["label"].to_numpy(int)))  # reruns meet the rows in one order
    model = train(x[order], rows["label"].to_numpy(int)[order])
    if model.weights.any():
        wanted = bitmap_of(known.select(F.xxhash64(F.col("doc_id").cast("long")).alias("value")), FILTER_BITS)
        utilities = wanted_utilities(documents, model, wanted).join(known.select(F.col("doc_id").cast("long").alias("doc_id"), "label"), "doc_id")
        model.cut = quantile_cut(stored(utilities.select("label", "utility"), "utilities")) or 0.0
    return model


def wanted_utilities(documents: DataFrame, model: RankingModel, wanted: bytes) -> DataFrame:
    """(doc_id, utility) of the documents whose id may be wanted; texts stay where they are read."""
    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("value", F.xxhash64("doc_id"))

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            value = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.flatnonzero(has_bit(bitmap, bit_places(value, FILTER_BITS)))))
            for part, texts in chunks(batch.column(1)):
                utility = pa.array(model.utility(features(texts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), utility], ["doc_id", "utility"])

    return rows.mapInArrow(computed, "doc_id long, utility double")


def scored(documents: DataFrame, model: RankingModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the score of each text; a null text is scored as an empty one."""
    rows = documents.select(*keep, F.col("text").alias("_scored"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(features(texts)) for _, texts in chunks(batch.column(len(keep)))]
            score = pa.array(np.concatenate([np.zeros(0), *scores]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], score], [*keep, "score"])

    return rows.mapInArrow(computed, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(fold(F.col("doc_id")) != 0)


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels outside fold 0."""
    documents = read_table(spark, sf_dir, "documents")
    model = learn(documents, training_labels(read_table(spark, sf_dir, "labels")))
    return scored(documents, model).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"),
    )
