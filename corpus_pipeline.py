"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

Every stage works on all rows that the one before kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import jaccard_join, mixing, packing, quality_ranking, suffix_arrays
from tracewarden.llm.super_kmers import without_repeats
from tracewarden.llm.tables import read_table, ship_library, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score at or above the cut; learned from labels outside fold 0."""
    ship_library(spark)
    labels = quality_ranking.training_labels(read_table(spark, sf_dir, "labels"))
    model = quality_ranking.learn(docs, labels)
    return quality_ranking.scored(docs, model, COLUMNS).where(F.col("score") >= quality_ranking.CUT_SCORE).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Rows that repeat an id and a text count once; rows without an id stay.
    """
    ship_library(spark)
    kept = jaccard_join.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    one = rows.join(kept, "doc_id").dropDuplicates(["doc_id", "_text"])
    return one.unionByName(rows.where("doc_id IS NULL")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that one with a smaller id has.

    A text that loses nothing stays as it is; what is left of others is joined by single spaces.
    """
    ship_library(spark)
    keep = [c for c in COLUMNS if c != "text"]
    found = without_repeats(docs, suffix_arrays.repeated_passages(docs), suffix_arrays.PASSAGE, keep)
    changed = F.col("n_removed") > 0
    return found.select(
        "doc_id",
        F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship_library(spark)
    return mixing.repeated_by_mix(docs, COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    ship_library(spark)
    pieces = packing.packed(packing.tokenized_pieces(docs))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

# The classifier and the random rounding of the mix cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
