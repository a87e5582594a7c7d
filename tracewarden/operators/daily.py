"""Stored days of agent events, which reports over any window add up instead of reading events.

Per day there are additive partials, one row per combination of a few dimensions, and sets of the
distinct threads and users of each agent. A set is a bitmap over numbers: every value gets
one when it first arrives, from a stored dictionary, so sets of different days can be united and
counted exactly. Values that arrive together have neighbouring numbers, which keeps a day's bitmaps
few: one of 4 KB for each 32,768 numbers that it touches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.session import new_folder

DIMENSIONS = ("agent_name", "event_type", "tool_used", "feedback_sentiment")
SETS = {"threads": "thread_id", "users": "user_name"}
IDS = "value string, number bigint, kind string"


@dataclass(frozen=True)
class StoredDays:
    """``partials`` has event_date, ``DIMENSIONS``, events, durations and duration_sum; ``sets`` event_date,
    agent_name, kind, bucket and members."""

    partials: DataFrame
    sets: DataFrame


def _write_days(rows: DataFrame, path: str) -> None:
    writer = rows.write.mode("overwrite").partitionBy("event_date")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def known_values(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary: (value, number, kind). Numbers of a kind count from 1 and are never given twice."""
    spark.createDataFrame([], IDS).write.mode("append").partitionBy("kind").parquet(f"{path}/ids")  # so that it exists
    return spark.read.schema(IDS).parquet(f"{path}/ids")


def number_new_values(values: DataFrame, path: str) -> None:
    """Gives the (kind, value) rows that the dictionary lacks the next numbers of their kind.

    Each partition numbers its own values behind those of the partitions before it, so no
    task sees all of them; what reaches the driver is a count per kind and partition. One writer at a time.
    """
    spark = values.sparkSession
    known = known_values(spark, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    new = values.join(known, ["kind", "value"], "left_anti").withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts)))
    folder = new_folder(spark, "new-values")
    new.write.parquet(folder)
    new = spark.read.schema(new.schema).parquet(folder)
    reached = {r["kind"]: r["last"] for r in known.groupBy("kind").agg(F.max("number").alias("last")).collect()}
    offsets = []
    for row in new.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "part").collect():
        offsets.append((row["kind"], row["part"], reached.get(row["kind"], 0)))
        reached[row["kind"]] = reached.get(row["kind"], 0) + row["n"]
    if not offsets:
        return
    before = spark.createDataFrame(offsets, "kind string, part bigint, before bigint")
    place = F.row_number().over(W.partitionBy("kind", "part").orderBy("value"))
    # At most a row per kind and partition is broadcast.
    numbered = new.withColumn("place", place).join(F.broadcast(before), ["kind", "part"])
    numbered = numbered.select("value", (F.col("before") + F.col("place")).alias("number"), "kind")
    numbered.write.mode("append").partitionBy("kind").parquet(f"{path}/ids")


def refresh_days(events: DataFrame, path: str) -> None:
    """Store the days of ``events``, all of whose events these must be, in place of what was stored of them.

    Other days are not touched. A run that failed can be repeated: numbers that it gave stay.
    """
    spark = events.sparkSession
    # The events are computed once, cut down to what is counted.
    folder = new_folder(spark, "day-events")
    used = events.select("event_date", *DIMENSIONS, "span_duration_ms", *SETS.values())
    used.write.parquet(folder)
    events = spark.read.schema(used.schema).parquet(folder)
    partials = events.groupBy("event_date", *DIMENSIONS).agg(
        F.count(F.lit(1)).alias("events"),
        F.count("span_duration_ms").alias("durations"),
        F.sum(F.col("span_duration_ms").cast("decimal(38,0)")).cast("decimal(38,0)").alias("duration_sum"),
    )
    _write_days(partials, f"{path}/partials")
    pairs = [F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value")) for kind, column in SETS.items()]
    members = events.select("event_date", "agent_name", F.inline(F.array(*pairs))).where("value IS NOT NULL").distinct()
    folder = new_folder(spark, "members")
    members.write.parquet(folder)
    members = spark.read.schema(members.schema).parquet(folder)
    number_new_values(members.select("kind", "value").distinct(), path)
    sets = (
        members.join(known_values(spark, path), ["kind", "value"])
        .groupBy("event_date", "agent_name", "kind", F.bitmap_bucket_number("number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("members"))
    )
    _write_days(sets, f"{path}/sets")


def read_days(spark: SparkSession, path: str) -> StoredDays:
    return StoredDays(spark.read.parquet(f"{path}/partials"), spark.read.parquet(f"{path}/sets"))


def distinct_counts(sets: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """How many different values of each kind the united sets of a group hold: a column per kind."""
    united = sets.groupBy(*keys, "kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("members")).alias("n"))
    names = [c for c in united.columns if c not in ("kind", "bucket", "n")]
    counts = [F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind) for kind in SETS]
    return united.groupBy(*names).agg(*counts)


def counts_and_sums(days: StoredDays, window: Column, keys: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Distinct threads and users of each group, and ``sums`` of its partials, for the days in ``window``."""
    distinct = distinct_counts(days.sets.where(window), keys)
    names = distinct.columns[: -len(SETS)]
    added = days.partials.where(window).groupBy(*keys).agg(*[value.alias(name) for name, value in sums.items()])
    rows = distinct.unionByName(added, allowMissingColumns=True)
    return rows.groupBy(*names).agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in (*SETS, *sums)])
