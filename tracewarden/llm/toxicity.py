"""Toxicity by gradient-boosted trees over a few dense features, calibrated by isotonic regression.

Features of a text: densities of two lexicons (general insults, and terms learned from labelled
texts), how near their hits stand to words of the second person, capitals, punctuation, and
disguised words. Spark ML fits trees and calibration; features come from Arrow batches.

A learned term is a whole word or the beginning of longer ones, whose share among toxic texts
is far above its share among others, sampling noise taken off. To keep the trees from trusting
terms more than they deserve, each learned text is seen through a lexicon of the other
half of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.tables import fold, read_table, share, stored
from tracewarden.llm.words import _BYTE_VALUES, RangeHashes, Texts, row_ranges, utf8

# Common insults and words of the second person in the four languages.
INSULTS = {
    "en": "idiot moron imbecile stupid dumb fool loser scum trash garbage pathetic worthless disgusting clown jerk creep coward liar freak ugly",
    "de": "idiot trottel depp dummkopf blödmann versager abschaum drecksack widerlich erbärmlich wertlos feigling lügner hässlich",
    "fr": "idiot imbécile crétin abruti connard ordure minable pathétique dégoûtant lâche menteur raté moche",
    "es": "idiota imbécil estúpido tonto basura escoria patético asqueroso inútil cobarde mentiroso payaso feo",
}
SECOND_PERSON = {
    "en": "you your yours yourself yourselves u ur",
    "de": "du dich dir dein deine deinen deiner ihr euch euer eure",
    "fr": "tu te toi ton ta tes vous votre vos",
    "es": "tú te ti tu tus usted ustedes vosotros vuestro vuestra",
}
# Digits and signs that stand for letters in disguised words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

ROWS_PER_CLASS = 4_000
# Bytes of a term's beginning that are looked up in longer words.
PREFIX_BYTES = range(3, 13)
NEAR_WORDS = 8
MIN_TEXTS = 4
MIN_EVIDENCE = 2.0
MAX_TERMS = 50_000
TREES, DEPTH = 30, 4
PREDICTED_FROM = 0.3

_PREFIX_KEY = np.uint64(0x5851F42D4C957F2D)
_FILTER_BITS = 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKALIKES]] = True
_MARK = np.zeros(256, bool)
_MARK[[0x21, 0x3F]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:\"'()-_/*#%&+=<>|~^[]{}\\`"]] = True

_PLAIN = bytes.maketrans("".join(LOOKALIKES).encode(), "".join(LOOKALIKES.values()).encode())
_NO_LETTER = bytes(k for k in range(128) if not 0x61 <= k <= 0x7A)
_STRETCHED = re.compile(rb"(.)\1{2,}", re.S)


def keys_of(forms: Sequence[bytes]) -> np.ndarray:
    """The hash of each form."""
    places = np.concatenate([[0], np.cumsum([len(f) for f in forms], dtype=np.int64)])
    return RangeHashes(_BYTE_VALUES[np.frombuffer(b"".join(forms), np.uint8)]).of(places[:-1], places[1:])


class Lexicon:
    """Weights of terms by hash."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The weight of each key, 0 for one that is no term."""
        found = np.zeros(len(keys))
        maybe = np.flatnonzero(self.filter[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            found[maybe] = np.where(self.keys[at] == keys[maybe], self.weights[at], 0)
        return found


def words_as_lexicon(words: dict[str, str]) -> Lexicon:
    keys = np.unique(keys_of([w.encode() for line in words.values() for w in line.split()]))
    return Lexicon(keys, np.ones(len(keys)))


_INSULTS, _SECOND_PERSON = words_as_lexicon(INSULTS), words_as_lexicon(SECOND_PERSON)


class Forms:
    """Words of lower-cased texts as they are looked up: letters only, beginnings, and without disguise."""

    def __init__(self, texts: Texts):
        self.texts = texts
        data = texts.data
        letter = _LETTER[data]
        places = np.zeros(len(data) + 1, np.int64)
        np.cumsum(letter, out=places[1:])
        self._letters = data[letter]
        self._starts, self._ends = places[texts.starts], places[texts.ends]
        self.sizes = self._ends - self._starts
        self._ranges = RangeHashes(_BYTE_VALUES[self._letters])
        self.keys = self._ranges.of(self._starts, self._ends)
        self._disguised(letter)

    def _disguised(self, letter: np.ndarray) -> None:
        """Words with signs among or letters stretched out, and letters that stand alone in a row, with their plain form."""
        texts, data = self.texts, self.texts.data
        follows = np.zeros(len(data), bool)
        follows[:-1] = _SIGN[data[:-1]] & (letter[1:] | _SIGN[data[1:]] & (data[1:] != data[:-1]))
        signs = np.concatenate([[0], np.cumsum(follows)])
        self.signed = (signs[texts.ends - 1] > signs[texts.starts]) & (self.sizes > 0)
        alike = np.zeros(len(data), bool)
        alike[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & (data[2:] < 0x80)
        stretched = np.concatenate([[0], np.cumsum(alike)])
        self.stretched = stretched[texts.ends] > stretched[np.minimum(texts.starts + 2, texts.ends)]
        word = np.flatnonzero(self.signed | self.stretched)
        forms = []
        for k in word.tolist():
            text = data[texts.starts[k] : texts.ends[k]].tobytes().rstrip(b"!?.,;:$")
            forms.append(_STRETCHED.sub(rb"\1", text.translate(_PLAIN).translate(None, _NO_LETTER)))
        # Four or more words of one letter each in a row.
        lone = (self.sizes == 1) & (texts.ends - texts.starts == 1)
        owner = texts.text_of
        edge = np.flatnonzero(np.diff(np.concatenate([[0], lone.astype(np.int8), [0]])))
        first, end = edge[::2], edge[1::2]
        row = (end - first >= 4) & (owner[first] == owner[np.maximum(end - 1, 0)]) if len(first) else np.zeros(0, bool)
        first, end = first[row], end[row]
        self.spaced = np.bincount(owner[first], weights=end - first, minlength=len(texts.counts))
        joined = self._ranges.of(self._starts[first], self._ends[end - 1]) if len(first) else np.zeros(0, np.uint64)
        self.plain_word = np.concatenate([word, first])
        self.plain_keys = np.concatenate([keys_of(forms), joined])

    def beginnings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of the words that are longer than each number of bytes; no character is cut."""
        for size in PREFIX_BYTES:
            word = np.flatnonzero(self.sizes > size)
            end = self._starts[word] + size
            whole = (self._letters[end] & 0xC0) != 0x80
            word, end = word[whole], end[whole]
            yield word, self._ranges.of(end - size, end) ^ _PREFIX_KEY

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, key) of every distinct term of each text, plain forms included."""
        words = [np.flatnonzero(self.sizes > 1), self.plain_word]
        keys = [self.keys[words[0]], self.plain_keys]
        for word, key in self.beginnings():
            words.append(word)
            keys.append(key)
        owner, key = self.texts.text_of[np.concatenate(words)], np.concatenate(keys)
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])[: len(key)]
        return owner[new], key[new]

    def weights(self, lexicon: Lexicon) -> np.ndarray:
        """The largest weight among the forms of each word."""
        found = lexicon.of(self.keys)
        np.maximum.at(found, self.plain_word, lexicon.of(self.plain_keys))
        for word, key in self.beginnings():
            found[word] = np.maximum(found[word], lexicon.of(key))
        return found


FEATURES = (
    "words", "insults", "insult_density", "terms", "term_density", "term_weight", "strongest_term", "second_person_density",
    "hits_near_second_person", "share_near_second_person", "capitals", "capital_words", "marks", "repeated_marks", "punctuation",
    "signed_words", "disguised_hits", "stretched_words", "spaced_letters",
)


def features(texts: Texts, lowered: Texts, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` per text; ``lowered`` has the same words in lower case."""
    n, counts, owner = len(texts.counts), texts.counts, lowered.text_of
    forms = Forms(lowered)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=n)

    general = _INSULTS.of(forms.keys)
    np.maximum.at(general, forms.plain_word, _INSULTS.of(forms.plain_keys))
    weight = forms.weights(lexicon)
    hit = ((general > 0) | (weight > 0)).astype(float)
    person = _SECOND_PERSON.of(forms.keys)
    before = np.concatenate([[0], np.cumsum(person)])
    at = np.arange(len(owner))
    low, high = np.maximum(at - NEAR_WORDS, lowered.first[owner]), np.minimum(at + NEAR_WORDS + 1, lowered.first[owner + 1])
    near = hit * (before[high] > before[low])
    plain = np.zeros(len(owner))
    np.maximum.at(plain, forms.plain_word, np.maximum(_INSULTS.of(forms.plain_keys), lexicon.of(forms.plain_keys)))
    strongest = np.zeros(n)
    np.maximum.at(strongest, owner, weight)

    byte_of = np.repeat(np.arange(n), np.diff(texts.offsets))
    data = texts.data
    # Capitals: ASCII, and the second byte of Latin-1 ones.
    capital = (data >= 0x41) & (data <= 0x5A)
    capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    small = (data >= 0x61) & (data <= 0x7A)
    capitals, smalls = (np.concatenate([[0], np.cumsum(x)]) for x in (capital, small))
    shout = (capitals[texts.ends] - capitals[texts.starts] >= 2) & (smalls[texts.ends] == smalls[texts.starts])

    def per_byte(values: np.ndarray) -> np.ndarray:
        return np.bincount(byte_of, weights=values, minlength=n)

    mark = _MARK[data]
    again = mark.copy()
    again[1:] &= mark[:-1]
    again[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = False
    total = counts + 10.0
    hits = per_text(hit)
    columns = [
        np.log1p(counts),
        np.log1p(per_text(general)),
        per_text(general) / total,
        np.log1p(per_text(weight > 0)),
        per_text(weight > 0) / total,
        per_text(weight),
        strongest,
        per_text(person) / total,
        np.log1p(per_text(near)),
        per_text(near) / np.maximum(hits, 1),
        per_byte(capital) / (per_byte(capital) + per_byte(small) + 20.0),
        np.bincount(texts.text_of, weights=shout, minlength=n) / total,
        per_byte(mark) / total,
        per_byte(again) / total,
        per_byte(_PUNCTUATION[data]) / total,
        per_text(forms.signed) / total,
        np.log1p(per_text(plain > 0)),
        per_text(forms.stretched) / total,
        forms.spaced / total,
    ]
    return np.stack(columns, 1)


def text_pairs(column: pa.Array) -> Iterator[tuple[slice, Texts, Texts]]:
    """Consecutive rows with their words as they are and in lower case; nulls are empty."""
    for row, end in row_ranges(column):
        part = column.slice(row, end - row).fill_null("")
        yield slice(row, end), Texts(*utf8(part)), Texts(*utf8(pc.utf8_lower(part)))


def term_counts(sample: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(key, half, n): texts of each half of ``sample`` with each term, of ``among`` if that is given."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(0).to_numpy()
            for part, _, lowered in text_pairs(batch.column(1)):
                owner, key = Forms(lowered).terms()
                if among is not None:
                    at = np.minimum(np.searchsorted(among, key), max(len(among) - 1, 0))
                    known = among[at] == key if len(among) else np.zeros(len(key), bool)
                    owner, key = owner[known], key[known]
                which = half[part][owner]
                for number in (0, 1):
                    keys, n = np.unique(key[which == number], return_counts=True)
                    columns = [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), number, np.int32)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "half", "n"])

    found = sample.select("half", "text").mapInArrow(counted, "key long, half int, n long")
    return found.groupBy("key").agg(*[F.sum(F.when(F.col("half") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in (0, 1)])


def evidence(toxic: np.ndarray, n_toxic: int, other: np.ndarray, n_other: int) -> np.ndarray:
    """Log ratio of a term's shares among toxic and other texts, less one and a half standard errors."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    return ratio - 1.5 * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


def learned_lexicons(sample: DataFrame) -> list[Lexicon]:
    """Lexicons of the texts of half 0, of half 1 and of all; at most ``MAX_TERMS`` candidate terms reach the driver."""
    totals = np.zeros((2, 2), np.int64)
    for r in sample.groupBy("label", "half").agg(F.count(F.lit(1)).alias("n")).collect():
        totals[r["label"], r["half"]] = r["n"]
    often = term_counts(sample.where("label = 1")).where(F.col("n_0") + F.col("n_1") >= MIN_TEXTS)
    often = often.orderBy((F.col("n_0") + F.col("n_1")).desc(), "key").limit(MAX_TERMS).toPandas().sort_values("key")
    keys = np.sort(often["key"].to_numpy(np.int64).view(np.uint64))
    toxic = np.zeros((len(keys), 2), np.int64)
    at = np.searchsorted(keys, often["key"].to_numpy(np.int64).view(np.uint64))
    toxic[at] = often[["n_0", "n_1"]].to_numpy(np.int64)
    rest = term_counts(sample.where("label = 0"), keys).toPandas()
    other = np.zeros((len(keys), 2), np.int64)
    other[np.searchsorted(keys, rest["key"].to_numpy(np.int64).view(np.uint64))] = rest[["n_0", "n_1"]].to_numpy(np.int64)
    lexicons = []
    for halves in ([0], [1], [0, 1]):
        t = toxic[:, halves].sum(1)
        weight = evidence(t, totals[1, halves].sum(), other[:, halves].sum(1), totals[0, halves].sum())
        strong = (weight >= MIN_EVIDENCE) & (t >= MIN_TEXTS)
        lexicons.append(Lexicon(keys[strong], weight[strong]))
    return lexicons


@dataclass
class ToxicityModel:
    """``trees`` and ``calibration`` are None if the labels were all alike; then every score is 0."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def text_features(rows: DataFrame, lexicons: Sequence[Lexicon], keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` and ``_x``, the features of column ``text`` through the lexicon that ``_lexicon`` numbers."""
    width = len(keep)
    rows = rows.select(*keep, F.col("_lexicon").cast("int"), F.col("text").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:width], T.StructField("_x", T.ArrayType(T.DoubleType()))])

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(width).to_numpy()
            for part, texts, lowered in text_pairs(batch.column(width + 1)):
                used = np.unique(which[part])
                x = features(texts, lowered, lexicons[used[0]])
                for number in used[1:]:
                    rows = which[part] == number
                    x[rows] = features(texts, lowered, lexicons[number])[rows]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                kept = batch.slice(part.start, part.stop - part.start).columns[:width]
                yield pa.RecordBatch.from_arrays([*kept, values], schema.names)

    return rows.mapInArrow(computed, schema)


def labelled_sample(documents: DataFrame, labels: DataFrame, rows_per_class: int) -> DataFrame:
    """(label, half, part, weight, text) of about ``rows_per_class`` labelled texts of either label, by hashed id.

    ``weight`` is how many labelled texts a row stands for. Equal texts with equal labels count
    once; null labels and ids do not count. At most four times ``rows_per_class`` rows.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("label"))
    weight = F.lit(1.0)
    for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect():
        weight = F.when(F.col("label") == r["label"], max(1.0, r["n"] / rows_per_class)).otherwise(weight)
    chosen = (
        known.withColumn("weight", weight)
        .where(share("toxicity sample", F.col("doc_id")) * F.col("weight") < 1)
        .limit(4 * rows_per_class)
    )
    # At most 4 * rows_per_class rows of three numbers, so it is small enough to send to every executor.
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").limit(4 * rows_per_class)
    text = F.coalesce("text", F.lit(""))
    one = sample.groupBy("label", text.alias("text")).agg(F.max("weight").alias("weight"))
    return one.select(
        "label",
        (share("toxicity half", F.col("text")) < 0.5).cast("int").alias("half"),
        (share("toxicity part", F.col("text")) < 0.75).alias("learned"),
        "weight",
        "text",
    )


def learn(documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> ToxicityModel:
    """A model of ``labels`` (doc_id, toxic), fitted on a bounded sample; a quarter of it only calibrates."""
    sample = stored(labelled_sample(documents, labels, rows_per_class), "toxicity_sample")
    lexicons = learned_lexicons(sample)
    model = ToxicityModel(lexicons[2])
    seen = sample.withColumn("_lexicon", 1 - F.col("half"))
    x = stored(text_features(seen, lexicons, ["label", "weight", "learned"]), "toxicity_features")
    # Reruns meet the rows in one order.
    x = x.orderBy("_x", "label").select(F.col("label").cast("double").alias("label"), "weight", "learned", array_to_vector("_x").alias("features")).coalesce(1)
    fitted, apart = x.where("learned"), x.where("NOT learned")
    if fitted.select("label").distinct().count() < 2:
        return model
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, minInstancesPerNode=5, weightCol="weight", maxMemoryInMB=64)
    model.trees = trees.fit(fitted)
    margins = model.trees.transform(apart).select("label", "weight", vector_to_array("probability")[1].alias("features"))
    if apart.select("label").distinct().count() == 2:
        model.calibration = IsotonicRegression(weightCol="weight").fit(margins)
    return model


def scored(documents: DataFrame, model: ToxicityModel, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the score, from 0 to 1, of each text; a null text is scored as an empty one.

    The score is the calibrated share of toxic texts; within a step of the calibration it goes
    on to order texts by the trees, by less than a hundredth in all. ``keep`` must not name it.
    """
    rows = documents.select(*keep, "text") if "text" not in keep else documents.select(*keep)
    if model.trees is None:
        return rows.select(*keep, F.lit(0.0).alias("score"))
    x = text_features(rows.withColumn("_lexicon", F.lit(0)), [model.lexicon], keep)
    named = x.withColumn("_vector", array_to_vector("_x"))
    trees = model.trees.copy()
    trees.setFeaturesCol("_vector").setRawPredictionCol("_raw").setProbabilityCol("_probability").setPredictionCol("_tree")
    found = trees.transform(named).withColumn("_margin", vector_to_array("_probability")[1])
    if model.calibration is None:
        return found.select(*keep, F.col("_margin").alias("score"))
    steps = model.calibration.copy().setFeaturesCol("_margin").setPredictionCol("_step")
    return steps.transform(found).select(*keep, (0.99 * F.col("_step") + 0.01 * F.col("_margin")).alias("score"))


def held_out(doc_id):
    return fold(doc_id, 4) == 2


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside fold 2 of 4."""
    documents = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    model = learn(documents, labels.where(~held_out(F.col("doc_id"))))
    return scored(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted")
    )
