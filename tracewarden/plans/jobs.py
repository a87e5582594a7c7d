"""Scheduled batch jobs over stored results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden import schemas
from tracewarden.operators.evaluation import SAMPLE_SIZE, evaluation_dataset, evaluation_results
from tracewarden.operators.judges import Scorer


def run_evaluation(
    conversations: DataFrame,
    as_of: datetime,
    scorer: Scorer,
    path: str,
    sample_size: int = SAMPLE_SIZE,
    seed: str = "",
) -> None:
    """Judge a sample of the last seven days and store it under its run date.

    Earlier runs stay as history. A rerun replaces its own date only, so it can
    be repeated after a failure. The sample of a refresh has no minimum query
    length, unlike the first build of the dataset.
    """
    dataset = evaluation_dataset(
        conversations, as_of, sample_size=sample_size, min_query_chars=None, seed=seed
    )
    results = evaluation_results(dataset, scorer, as_of).withColumn("run_date", F.lit(as_of.date()))
    writer = results.write.mode("overwrite").partitionBy("run_date")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def evaluation_runs(spark: SparkSession, path: str) -> DataFrame:
    """All stored results, with their run date."""
    dated = T.StructType(schemas.EVALUATION_RESULTS.fields + [T.StructField("run_date", T.DateType())])
    return spark.read.schema(dated).parquet(path)


def latest_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Results of the newest run."""
    runs = evaluation_runs(spark, path)
    return runs.where(F.col("run_date") == runs.agg(F.max("run_date")).scalar()).drop("run_date")


def evaluation_history(spark: SparkSession, path: str) -> DataFrame:
    """Results of all runs before the newest."""
    runs = evaluation_runs(spark, path)
    return runs.where(F.col("run_date") < runs.agg(F.max("run_date")).scalar())
