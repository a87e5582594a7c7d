"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.tables import fold, read_table, share
from tracewarden.llm.words import row_ranges

BUCKETS = 1 << 15
DIMENSIONS = 16
ORDERS = (2, 3, 4)
EPOCHS = 4
ROWS_PER_LANGUAGE = 800
MAX_ROWS = 20_000
CHUNK_CHARS = 1 << 18
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; built once per process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of each subword of each text, some hundred thousand at a time.

    Subwords are runs of two to four code points of a lower-cased word, its edges
    marked; a subword never spans two words. Long texts come in several pieces that
    overlap, so that no subword is lost or counted twice.
    """
    chars = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    rows = np.repeat(np.arange(len(chars)), [len(c) + 1 for c in chars])
    gap = np.zeros(1, np.uint32)
    codes = np.concatenate([gap, *[x for c in chars for x in (c, gap)], np.zeros(max(ORDERS), np.uint32)])
    rows = np.concatenate([rows[:1], rows]) if len(rows) else rows
    letter = letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    total = len(rows)
    for at in range(0, total, CHUNK_CHARS):
        end = min(total, at + CHUNK_CHARS)
        value = codes[at:end].copy()
        inner = np.ones(end - at, bool)  # all but the first and last are letters
        some = letter[at:end].copy()
        for order in range(2, max(ORDERS) + 1):
            if order > 2:
                inner &= letter[at + order - 2 : end + order - 2]
            value = value * np.uint64(1_000_003) + codes[at + order - 1 : end + order - 1]
            some |= letter[at + order - 1 : end + order - 1]
            if order in ORDERS:
                keep = np.flatnonzero(inner & some)
                mix = (value[keep] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
                owner = rows[at + keep]
                # A subword that starts at a gap belongs to the text behind the gap.
                owner = np.where(letter[at + keep], owner, rows[np.minimum(at + keep + 1, total - 1)])
                yield owner, (mix >> np.uint64(64 - 15)).astype(np.int64)


@dataclass
class LanguageModel:
    """``table`` has a row per subword bucket, ``head`` and ``bias`` turn means into class scores."""

    languages: list[str]
    table: np.ndarray
    head: np.ndarray | None
    bias: np.ndarray
    temperature: float = 1.0
    accept_from: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class scores of each text and the number of its subwords."""
        sums = np.zeros((len(texts), self.table.shape[1]))
        counts = np.zeros(len(texts), np.int64)
        for rows, buckets in subwords(texts):
            counts += np.bincount(rows, minlength=len(texts))
            vectors = self.table[buckets]
            for k in range(sums.shape[1]):
                sums[:, k] += np.bincount(rows, weights=vectors[:, k], minlength=len(texts))
        return self.class_scores(sums / np.maximum(counts, 1)[:, None]), counts

    def class_scores(self, means: np.ndarray) -> np.ndarray:
        return (means if self.head is None else means @ self.head) + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and whether that is too low to be trusted."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, counts = self.logits(texts)
        probability = softmax(logits / self.temperature)
        best = probability.argmax(1)
        score = np.where(counts > 0, probability.max(1), 0.0)
        names = [self.languages[k] if n else UNKNOWN for k, n in zip(best, counts)]
        return names, score, score < np.maximum(self.accept_from, 1e-12)


def _mean(table: np.ndarray, counts: SparseCounts) -> np.ndarray:
    buckets, n = counts
    return (n / max(n.sum(), 1)) @ table[buckets].astype(float)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


SparseCounts = tuple[np.ndarray, np.ndarray]  # buckets in order, and how often each comes


def counted(text: str) -> SparseCounts:
    """The subword buckets of a text with their numbers, however long it is at most ``BUCKETS`` of them."""
    total = np.zeros(BUCKETS, np.int64)
    for _, buckets in subwords([text]):
        total += np.bincount(buckets, minlength=BUCKETS)
    present = np.flatnonzero(total)
    return present, total[present]


def train(texts: list[str], langs: list[str], seed: int = 7, precision: float = 0.99) -> LanguageModel:
    """:func:`train_on_counts` of texts at hand."""
    return train_on_counts([counted(t) for t in texts], langs, seed, precision)


def train_on_counts(
    texts: Sequence[SparseCounts], langs: Sequence[str], seed: int = 7, precision: float = 0.99
) -> LanguageModel:
    """Stochastic gradient descent over single texts; a tenth calibrates and is not learned from.

    The temperature minimises the log loss of the calibration texts, and scores below
    the smallest one from which ``precision`` of them are right are rejected.
    No texts give a model that answers ``und``; one language is always answered.
    """
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), None, np.zeros(1))
    number = {name: k for k, name in enumerate(languages)}
    target = np.array([number[x] for x in langs])
    order = rng.permutation(len(texts))
    held, learned = order[: len(texts) // 10], order[len(texts) // 10 :]
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    head = np.zeros((DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    steps, total = 0, EPOCHS * len(learned)
    for _ in range(EPOCHS):
        for k in rng.permutation(learned):
            buckets, count = texts[k]
            rate = 0.5 * (1 - steps / max(total, 1)) + 0.01
            steps += 1
            if not len(buckets):
                continue
            weight = (count / count.sum()).astype(np.float32)
            mean = weight @ embed[buckets]
            error = softmax((mean @ head + bias)[None])[0]
            error[target[k]] -= 1
            back = head @ error
            head -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            embed[buckets] -= (rate * 20 * weight[:, None] * back).astype(np.float32)
    if len(languages) <= DIMENSIONS:  # the head is linear, so it can go into the table
        model = LanguageModel(languages, (embed @ head).astype(np.float32), None, bias)
    else:
        model = LanguageModel(languages, embed, head, bias)
    if len(held):
        logits = model.class_scores(np.array([_mean(model.table, texts[k]) for k in held]))
        truth = target[held]
        doubt = 1 / (len(held) + 2)  # so that few calibration texts, all right, do not give certainty

        def loss(t: float) -> float:
            logp = np.log(softmax(logits / t) + 1e-12)
            return float(-(1 - doubt) * logp[np.arange(len(held)), truth].mean() - doubt * logp.mean())

        losses = {t: loss(t) for t in np.geomspace(0.02, 5, 40)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(logits / model.temperature)
        order = np.argsort(-p.max(1), kind="stable")
        right = np.cumsum((p.argmax(1) == truth)[order]) / np.arange(1, len(held) + 1)
        enough = np.flatnonzero(right >= precision)
        model.accept_from = float(p.max(1)[order[enough[-1]]]) if len(enough) else 1.0
    return model


def training_sample(
    rows: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, max_rows: int = MAX_ROWS
) -> DataFrame:
    """About ``rows_per_language`` labelled rows of each language, ``max_rows`` at most in all."""
    labelled = rows.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    known = labelled.select("doc_id", "lang")
    rate = known.groupBy("lang").agg((F.lit(float(rows_per_language)) / F.count(F.lit(1))).alias("_rate"))
    chosen = (
        known.join(rate, "lang")
        .where(share("language sample", F.col("doc_id")) < F.col("_rate"))
        .orderBy(F.xxhash64(F.lit("order"), "doc_id"), "doc_id", "lang")
        .limit(max_rows)
        .select("doc_id")
        .distinct()
    )
    # At most max_rows ids, so they can go to every executor and the texts stay where they are.
    sample = labelled.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    return sample.orderBy("doc_id", "lang", F.xxhash64("text")).limit(max_rows).select("text", "lang")


def counted_sample(sample: DataFrame) -> tuple[list[SparseCounts], list[str]]:
    """Counts and languages of rows (text, lang) in their order.

    Executors count; what reaches the driver grows with the rows and not with the length of their texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            for at, end in row_ranges(batch.column(0)):
                found = [counted(t or "") for t in batch.column(0).slice(at, end - at).to_pylist()]
                columns = [pa.array([f[k] for f in found], kind) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, end - at), *columns], ["lang", "buckets", "counts"])

    rows = sample.select("text", "lang").mapInArrow(count, "lang string, buckets array<int>, counts array<int>").toPandas()
    pairs = [(np.asarray(b, np.int64), np.asarray(n, np.int64)) for b, n in zip(rows["buckets"], rows["counts"])]
    return pairs, rows["lang"].tolist()


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected`` by the whole text.

    A null text, or one without a letter, is ``und`` with score 0. Columns of
    these names that were there are replaced.
    """
    rest = documents.drop("lang_pred", "score", "rejected")
    columns = [c for c in rest.columns if c != "text"]
    added = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    schema = T.StructType(rest.schema.fields + added.fields)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            names, scores, rejected = [], [], []
            for at, end in row_ranges(texts):
                a, b, c = model.predict([t or "" for t in texts.slice(at, end - at).to_pylist()])
                names += a
                scores.append(b)
                rejected.append(c)
            extra = [pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores])), pa.array(np.concatenate([np.zeros(0, bool), *rejected]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return rest.mapInArrow(predicted, schema).select(*columns, "text", "lang_pred", "score", "rejected")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside fold 0."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_on_counts(*counted_sample(training_sample(documents.where(fold(F.col("doc_id")) != 0))))
    found = identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")
