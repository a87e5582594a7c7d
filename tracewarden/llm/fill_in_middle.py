"""Fill-in-the-middle transformation of whole texts, and its exact reversal.

Texts are cut as bytes. A sparse index over a chunk of texts holds only its multibyte
characters: where each starts and how many bytes all of them up to it have beyond one. A
binary search in it turns byte places into code-point places and back; between its entries
the difference is constant, so spans of ASCII need no entry and no scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.tables import read_table
from tracewarden.llm.words import Texts, chunks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
# Percent of the texts that are transformed, and of these that have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 50, 80


class MultibyteIndex:
    """Code-point and byte places of UTF-8 text, by its multibyte characters alone."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)  # a first byte of two or more
        first = data[self.at]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.excess = np.zeros(len(self.at) + 1, np.int64)  # bytes beyond one of the characters before
        np.cumsum(excess, out=self.excess[1:])

    def chars(self, places: np.ndarray) -> np.ndarray:
        """Code points before each byte place; a place lies between two characters."""
        return places - self.excess[np.searchsorted(self.at, places)]

    def bytes(self, chars: np.ndarray) -> np.ndarray:
        """The byte place behind so many code points."""
        return chars + self.excess[np.searchsorted(self.at - self.excess[:-1], chars)]


def token_counts(texts: Texts) -> np.ndarray:
    """Tokens of each text: words with the white space before them, and white space at its end."""
    end_of_words = texts.offsets[:-1].copy()
    some = texts.counts > 0
    end_of_words[some] = texts.ends[texts.first[1:][some] - 1]
    return texts.counts + (end_of_words < texts.offsets[1:])


def byte_cuts(texts: Texts, index: MultibyteIndex, unit: str, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and the byte places (one row per draw) behind ``draw % (units + 1)`` units."""
    start, end = texts.offsets[:-1], texts.offsets[1:]
    if unit == "chars":
        base = index.chars(start)
        n = index.chars(end) - base
        return n, index.bytes(base + draws % (n + 1))
    n = token_counts(texts)
    k = draws % (n + 1)
    cuts = np.where(k == 0, start, end)  # behind no token, or behind white space at the end
    word = (k > 0) & (k <= texts.counts)
    cuts[word] = texts.ends[(texts.first[:-1] + k - 1)[word]]
    return n, cuts


def draws_of(doc_id, seed: int = SEED):
    """Four numbers from the first 32 hexadecimal digits of sha256 of ``seed:doc_id``; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(
    documents: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    unit: str = "words",
    seed: int = SEED,
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Columns ``keep``, n, form, prefix_chars, middle_chars and output of every row of ``documents``.

    Two cuts per text, drawn by hash of ``seed`` and doc_id, lie behind whole tokens
    (``unit`` "words") or code points ("chars"), ``n`` of which the text has. ``form`` is ``psm``
    (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``: texts that are not
    drawn, are empty or null (output: empty) or hold a marker. The lengths are
    in code points, null for plain. Rows that repeat an id are cut alike if their texts are
    alike. ``keep`` must not name a result.
    """
    if unit not in ("words", "chars"):
        raise ValueError(f"unit {unit!r} is neither words nor chars")
    width = len(keep)
    rows = documents.select(*keep, draws_of(F.col("doc_id"), seed).alias("_draws"), F.col("text").alias("_text"))
    added = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    schema = T.StructType(rows.schema.fields[:width] + added.fields)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = batch.column(width).flatten().to_numpy().reshape(-1, 4).T
            for part, texts in chunks(batch.column(width + 1)):
                yield transformed_chunk(batch.slice(part.start, part.stop - part.start), texts, drawn[:, part])

    def transformed_chunk(batch: pa.RecordBatch, texts: Texts, drawn: np.ndarray) -> pa.RecordBatch:
        index = MultibyteIndex(texts.data)
        n, cuts = byte_cuts(texts, index, unit, drawn[:2])
        low, high = cuts.min(0), cuts.max(0)
        before, between = index.chars(low) - index.chars(texts.offsets[:-1]), index.chars(high) - index.chars(low)
        data = texts.data.tobytes()
        forms, outputs = [], []
        wanted = (drawn[2] % 100 < transformed).tolist()
        suffix = (drawn[3] % 100 < suffix_first).tolist()
        for a, b, c, d, use, spm in zip(texts.offsets[:-1].tolist(), low.tolist(), high.tolist(), texts.offsets[1:].tolist(), wanted, suffix):
            text = data[a:d]
            if not use or not text or PREFIX in text or SUFFIX in text or MIDDLE in text:
                forms.append("plain")
                outputs.append(text)
            elif spm:
                forms.append("spm")
                outputs.append(b"".join((SUFFIX, data[c:d], PREFIX, data[a:b], MIDDLE, data[b:c])))
            else:
                forms.append("psm")
                outputs.append(b"".join((PREFIX, data[a:b], SUFFIX, data[c:d], MIDDLE, data[b:c])))
        plain = np.array([f == "plain" for f in forms], bool)
        columns = [pa.array(n, pa.int64()), pa.array(forms, pa.string())]
        columns += [pa.array(x, pa.int64(), mask=plain) for x in (before, between)]
        columns.append(pa.array(outputs, pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], schema.names)

    return rows.mapInArrow(transform, schema)


def rebuilt(output: bytes, form: str) -> bytes:
    """The text of an output. No marker is part of the text, so the first of each kind is the one put in."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, middle = output.partition(MIDDLE)
    one, _, two = head[len(first) :].partition(second)
    return one + middle + two if form == "psm" else two + middle + one


def restored(rows: DataFrame) -> DataFrame:
    """Adds column ``restored``, the text rebuilt from ``output`` and ``form`` alone (null if one of them is null).

    A column of that name that was there is replaced.
    """
    rest = rows.drop("restored")
    schema = T.StructType(rest.schema.fields + [T.StructField("restored", T.StringType())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output = batch.column(batch.schema.get_field_index("output")).cast(pa.binary()).to_pylist()
            form = batch.column(batch.schema.get_field_index("form")).to_pylist()
            texts = [None if o is None or f is None else rebuilt(o, f) for o, f in zip(output, form)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], schema.names)

    return rest.mapInArrow(rebuild, schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, with digests of the output and of the text rebuilt from it."""
    found = restored(fill_in_middle(read_table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS s,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
    FROM documents
),
h AS (
    SELECT *, len(w) AS n, CAST('0x' || s[1:8] AS BIGINT) % (len(w) + 1) AS c1, CAST('0x' || s[9:16] AS BIGINT) % (len(w) + 1) AS c2,
           CAST('0x' || s[17:24] AS BIGINT) % 100 AS c3, CAST('0x' || s[25:32] AS BIGINT) % 100 AS c4
    FROM d
),
parts AS (
    SELECT doc_id, n, t,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 50 THEN 'plain'
                WHEN c4 < 80 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(w[1:least(c1, c2)], '') AS p,
           array_to_string(w[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
           array_to_string(w[greatest(c1, c2) + 1:], '') AS s
    FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
