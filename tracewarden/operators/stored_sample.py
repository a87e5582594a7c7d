"""Samples of evaluation candidates kept per day, of which the sample of a sliding week is merged.

The sample of a set of responses is its first rows in hash order. The first rows of a union are
among the first rows of its parts, so ``sample_size`` rows a day are enough for
every window of whole days, and rows that come late can be merged in.
"""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.functions.clock import dates_before, today
from tracewarden.operators.evaluation import MIN_QUERY_CHARS, SAMPLE_SIZE, evaluation_dataset, long_enough, sample_order

_ORDER = ("_sample_hash", "_sample_key")


def _first_of_each_day(rows: DataFrame, sample_size: int) -> DataFrame:
    """Spark limits each partition's share of a day before it shuffles, so a busy day does not travel whole."""
    rank = F.row_number().over(W.partitionBy("event_date").orderBy(*_ORDER))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= sample_size).drop("_rank")


def add_to_samples(
    conversations: DataFrame,
    path: str,
    sample_size: int = SAMPLE_SIZE,
    min_query_chars: int | None = MIN_QUERY_CHARS,
    seed: str = "",
) -> None:
    """Merge responses into the stored samples of their days; only these days are rewritten.

    A response that comes again (same key) is one row. Sample size, least length and seed must stay the same for a path.
    """
    spark = conversations.sparkSession
    hashed, key = sample_order(seed)
    new = conversations.where(long_enough(min_query_chars)).select("*", hashed.alias(_ORDER[0]), key.alias(_ORDER[1]))
    new.limit(0).write.mode("append").partitionBy("event_date").parquet(path)  # so that there is something to read
    stored = spark.read.schema(new.schema).parquet(path)
    # Few dates: a delivery's.
    dates = [r[0] for r in new.select("event_date").distinct().collect()]
    kept = stored.where(F.col("event_date").isin(dates)).select(*new.columns)
    merged = _first_of_each_day(new.unionByName(kept).dropDuplicates(["event_date", *_ORDER]), sample_size)
    writer = merged.write.mode("overwrite").partitionBy("event_date")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def sample_of_days(
    spark: SparkSession, path: str, as_of: datetime, days: int = 7, sample_size: int = SAMPLE_SIZE, current: DataFrame | None = None
) -> DataFrame:
    """What ``evaluation_dataset`` would draw from all responses, out of the stored rows of its days.

    The day of ``as_of`` has not ended, and its stored sample may hold what came after: its
    responses are drawn from ``current`` (conversations) instead, where it is given. Without it they are left out.
    """
    rows = spark.read.parquet(path)
    whole = rows.where((F.col("event_date") >= dates_before(as_of, days)) & (F.col("event_date") < today(as_of)))
    if current is not None:
        started = datetime.combine(as_of.date(), time())
        fresh = evaluation_dataset(current.where(F.col("event_timestamp") >= F.lit(started).cast("timestamp_ntz")), as_of, 0, sample_size)
        hashed, key = sample_order()
        whole = whole.unionByName(fresh.select("*", hashed.alias(_ORDER[0]), key.alias(_ORDER[1])))
    return whole.orderBy(*_ORDER).limit(sample_size).drop(*_ORDER)
