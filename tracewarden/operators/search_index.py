"""A stored search index: documents, texts and postings as Parquet by bucket.

Documents with equal texts share one row of ``texts`` and its postings (``text_id``, a 64-bit
hash), so logs that say the same again and again add narrow document rows only. The words of a
text are counted within its row; postings travel once, to their buckets.

Each change writes the tables into a new folder below ``path`` and then replaces the one
row of ``current``, which names the folder and holds the statistics. A search reads that row
once, so it sees a change whole or not at all, and a change that breaks off leaves nothing
behind that counts. The folder before the current one stays for searches that still read
it; older ones go. One writer at a time.

A change rewrites the index and cuts only new texts into words; let a batch gather what an
hour or a day brings.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.functions.columns import ascending, computed_once
from tracewarden.functions.text import tokens
from tracewarden.operators.search import (
    SCORE_DIGITS,
    TERM_BUCKETS,
    inverse_document_frequency,
    matching,
    query_terms,
    term_score,
)

DOCUMENT_BUCKETS = 64
CURRENT = "folder string, before string, term_buckets int, documents bigint, words bigint, schema string, text_column string"
POSTINGS = "text_id bigint, text_length bigint, term string, frequency bigint, term_bucket bigint"
TEXTS = "text_id bigint, text string, text_length bigint, text_bucket bigint"


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets))


def _file(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> T.Row | None:
    """The row that names the index's folder, if there is an index at ``path``."""
    file, system = _file(spark, f"{path}/current")
    return spark.read.schema(CURRENT).json(f"{path}/current").first() if system.exists(file) else None


def _switch(spark: SparkSession, path: str, row: dict) -> None:
    """Replaces the row in one step: written beside it, then renamed over it."""
    new, system = _file(spark, f"{path}/next-{uuid.uuid4().hex}")
    out = system.create(new, True)
    out.write(json.dumps(row).encode())
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    over[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(new, _file(spark, f"{path}/current")[0], over)


def documents_of(spark: SparkSession, now: T.Row) -> DataFrame:
    """The documents of an index without their texts, each id once, with ``text_id`` and ``doc_bucket``."""
    fields = [f for f in T.StructType.fromJson(json.loads(now["schema"])).fields if f.name != now["text_column"]]
    schema = T.StructType(fields).add("text_id", T.LongType()).add("doc_bucket", T.LongType())
    return spark.read.schema(schema).parquet(f"{now['folder']}/documents")


def texts_of(spark: SparkSession, now: T.Row) -> DataFrame:
    return spark.read.schema(TEXTS).parquet(f"{now['folder']}/texts")


def postings_of(spark: SparkSession, now: T.Row, terms: Sequence[str] | None = None) -> DataFrame:
    """All postings, or those of the terms, from the buckets that can hold them."""
    rows = spark.read.schema(POSTINGS).parquet(f"{now['folder']}/postings")
    if terms is None:
        return rows
    in_buckets = F.lit(False)
    for term in terms:
        in_buckets = in_buckets | (F.col("term_bucket") == _bucket(F.lit(term), now["term_buckets"]))
    return rows.where(in_buckets & F.col("term").isin(list(terms)))


def _write(rows: DataFrame, path: str, bucket: str, *order: str) -> None:
    """By bucket, each file in order, so that a search for few values skips row groups.

    Rebalancing splits the bucket of a term that a third of the documents have.
    """
    rows.hint("rebalance", bucket).sortWithinPartitions(bucket, *order).write.partitionBy(bucket).parquet(path)


def _postings(texts: DataFrame, term_buckets: int) -> DataFrame:
    """A row per text and different word, counted in the text's sorted words without a shuffle."""
    words = computed_once(texts.select("text_id", "text"), F.sort_array(F.coalesce(tokens(F.col("text")), F.array())).alias("_words"))

    def first(word: Column, place: Column) -> Column:
        new = (place == 0) | (word != F.get("_words", place - 1))
        return F.when(new, F.struct(word.alias("term"), place.alias("place")))

    found = computed_once(
        words.select("text_id", "_words"),
        F.array_size("_words").cast("bigint").alias("text_length"),
        F.array_compact(F.transform("_words", first)).alias("_firsts"),
    ).drop("_words")

    def counted(word: Column, number: Column) -> Column:
        end = F.coalesce(F.get("_firsts", number + 1)["place"].cast("bigint"), F.col("text_length"))
        return F.struct(word["term"].alias("term"), (end - word["place"]).alias("frequency"))

    rows = found.select("text_id", "text_length", F.inline(F.transform("_firsts", counted)))
    return rows.withColumn("term_bucket", _bucket(F.col("term"), term_buckets))


def index_documents(corpus: DataFrame, text_column: str, path: str, buckets: int = TERM_BUCKETS, withdrawn: DataFrame | None = None) -> None:
    """Put documents (string ``doc_id``) into the index, which is begun if it is not there.

    They replace documents with the same id, and those of ``withdrawn`` are taken out. Of
    rows that repeat an id one stays, the one with the largest text hash. Doing a batch again
    changes nothing. ``buckets`` counts for a new index only; it is stored.
    """
    spark = corpus.sparkSession
    now = current(spark, path)
    term_buckets = now["term_buckets"] if now else buckets
    fields = [f for f in corpus.schema.fields if f.name != "doc_id"]
    if now:  # Later batches take the columns of the index.
        fields = T.StructType.fromJson(json.loads(now["schema"])).fields[1:]
    names = [f.name for f in fields if f.name != text_column]
    folder = f"{path}/{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField("doc_id", T.StringType()), *fields])
    row = {"folder": folder, "before": now["folder"] if now else None, "term_buckets": term_buckets, "schema": schema.json(), "text_column": text_column}
    written = T.Row(**row)
    # The batch is computed once; what follows reads narrow rows or texts of it.
    given = corpus.select(
        F.col("doc_id").cast("string").alias("doc_id"), *names, F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_id")
    )
    given.write.parquet(f"{folder}/batch")
    batch = spark.read.schema(given.schema).parquet(f"{folder}/batch")
    # Dealt out by id first, so that tasks sort parts of a bounded size.
    documents = (
        batch.drop("text")
        .repartition("doc_id")
        .groupBy("doc_id")
        .agg(F.max_by(F.struct(*names, "text_id"), "text_id").alias("_row"))
        .select("doc_id", "_row.*")
        .withColumn("doc_bucket", _bucket(F.col("doc_id"), DOCUMENT_BUCKETS))
    )
    texts = batch.select("text_id", "text").distinct()
    if now:
        gone = batch.select("doc_id")
        if withdrawn is not None:
            gone = gone.union(withdrawn.select(F.col("doc_id").cast("string")))
        documents = documents_of(spark, now).join(gone, "doc_id", "left_anti").unionByName(documents)
        texts = texts.join(texts_of(spark, now).select("text_id"), "text_id", "left_anti")
    _write(documents, f"{folder}/documents", "doc_bucket", "doc_id")
    documents = documents_of(spark, written)
    length = F.array_size(F.coalesce(tokens(F.col("text")), F.array())).cast("bigint")
    texts = texts.select("*", length.alias("text_length"), _bucket(F.col("text_id"), DOCUMENT_BUCKETS).alias("text_bucket"))
    if now:
        # New texts are set apart, as their words alone are counted; texts that no document has any more go.
        texts.write.parquet(f"{folder}/new")
        new = spark.read.schema(TEXTS).parquet(f"{folder}/new")
        texts_of(spark, now).select("text_id").join(documents, "text_id", "left_anti").write.parquet(f"{folder}/dead")
        dead = spark.read.schema("text_id bigint").parquet(f"{folder}/dead")
        _write(texts_of(spark, now).join(dead, "text_id", "left_anti").unionByName(new), f"{folder}/texts", "text_bucket", "text_id")
        postings = postings_of(spark, now).join(dead, "text_id", "left_anti").unionByName(_postings(new, term_buckets))
    else:
        _write(texts, f"{folder}/texts", "text_bucket", "text_id")
        postings = _postings(texts_of(spark, written), term_buckets)
    _write(postings, f"{folder}/postings", "term_bucket", "term", "text_id")
    totals = documents.groupBy("text_id").agg(F.count(F.lit(1)).alias("copies")).join(texts_of(spark, written).select("text_id", "text_length"), "text_id")
    row["documents"], row["words"] = totals.agg(
        F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("copies") * F.col("text_length")), F.lit(0))
    ).first()
    _switch(spark, path, row)
    for old in [f"{folder}/batch", f"{folder}/new", f"{folder}/dead", now["before"] if now else None]:
        if old:
            file, system = _file(spark, old)
            system.delete(file, True)


def found_documents(spark: SparkSession, now: T.Row, best: list, columns: Sequence[str]) -> DataFrame:
    """Texts and attributes of the few best documents, read from their buckets only."""
    scores = spark.createDataFrame([(r["doc_id"], r["score"]) for r in best], "doc_id string, score double")
    rows = documents_of(spark, now).where(
        F.col("doc_bucket").isin(sorted({r["doc_bucket"] for r in best})) & F.col("doc_id").isin([r["doc_id"] for r in best])
    )
    if now["text_column"] in columns:
        texts = texts_of(spark, now).where(
            F.col("text_bucket").isin(sorted({r["text_bucket"] for r in best})) & F.col("text_id").isin(sorted({r["text_id"] for r in best}))
        )
        rows = rows.join(texts.select("text_id", F.col("text").alias(now["text_column"])), "text_id")
    # The ``limit`` best rows are broadcast.
    return rows.join(F.broadcast(scores), "doc_id").select("doc_id", *columns, "score")


def search_index(
    spark: SparkSession,
    path: str,
    query: str,
    columns: Sequence[str],
    filter: Mapping[str, object] | None = None,
    limit: int = 10,
) -> DataFrame:
    """The same rows as a search by scan, from the postings of the query's terms.

    The best ``limit`` ids are found first and come to the driver; their texts and
    attributes are then read from the partitions that hold them.
    """
    terms = query_terms(query)
    if not terms:
        raise ValueError("the query has no searchable term")
    now = current(spark, path)
    if now is None:
        raise ValueError(f"no index at {path}")
    frequencies = {f"_tf{n}": F.sum(F.when(F.col("term") == term, F.col("frequency")).otherwise(0)) for n, term in enumerate(terms)}
    matched = postings_of(spark, now, terms).groupBy("text_id").agg(
        F.max("text_length").alias("text_length"), *[value.alias(name) for name, value in frequencies.items()]
    )
    rows = documents_of(spark, now)
    # A term is contained in a text as often as documents have the text. One row comes back, a number per term.
    copies = rows.groupBy("text_id").agg(F.count(F.lit(1)).alias("copies"))
    containing = matched.join(copies, "text_id").agg(
        *[F.coalesce(F.sum(F.when(F.col(name) > 0, F.col("copies"))), F.lit(0)).alias(name) for name in frequencies]
    ).first()
    mean_length = F.lit(now["words"] / now["documents"] if now["documents"] else 1.0)
    score = F.lit(0.0)
    for name in frequencies:
        idf = inverse_document_frequency(F.lit(now["documents"]), F.lit(containing[name]))
        score = score + term_score(idf, F.col(name), F.col("text_length"), mean_length)
    scores = matched.select("text_id", F.round(score, SCORE_DIGITS).alias("score"))
    if filter and now["text_column"] in filter:
        rows = rows.join(texts_of(spark, now).select("text_id", F.col("text").alias(now["text_column"])), "text_id")
    ranking = [F.col("score").desc(), ascending("doc_id")]
    ranked = rows.where(matching(filter)).select("doc_id", "doc_bucket", "text_id").join(scores, "text_id")
    ranked = ranked.withColumn("text_bucket", _bucket(F.col("text_id"), DOCUMENT_BUCKETS))
    best = ranked.orderBy(*ranking).limit(limit).collect()
    return found_documents(spark, now, best, columns).orderBy(*ranking)
