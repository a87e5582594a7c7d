"""Verdicts of an external judge, bought once per prompt and kept.

Calls cost money and answers differ from call to call, so no answer may depend on how often Spark
computes a row. Prompts that the store lacks are asked in rounds, each a job of its own whose
answers are stored when it ends. Rounds are small, and no more than ``MOST_ROUNDS`` however many prompts there are. Everything after that reads the store: a partition that is computed anew, a second
run and a run after a failure ask only what no round has stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators.judges import JUDGES, Scorer, answered, error_column, prompt, raw_column
from tracewarden.session import new_folder

MOST_ROUNDS = 64
ANSWERS = "prompt_key string, answer string, error string, stored boolean"


def _key(text: Column) -> Column:
    return F.sha2(text, 256)


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_key, answer, error, stored): answers, and failed calls with the reason (``stored`` false)."""
    spark.createDataFrame([], ANSWERS).write.mode("append").partitionBy("stored").parquet(path)  # so that it exists
    return spark.read.schema(ANSWERS).parquet(path)


def buy_verdicts(
    prompts: DataFrame,
    complete: Callable[[list[str]], Sequence[str | None]],
    path: str,
    partitions: int,
    chunk_rows: int = 32,
    chunks_per_round: int = 1,
) -> int:
    """Ask each different prompt (column ``prompt``) that has no stored answer; returns how many were asked.

    A round has about ``partitions`` times ``chunks_per_round`` chunks, or a part in ``MOST_ROUNDS`` of all
    prompts where that is more, and reads only its own prompts. A task that is lost has its
    prompts asked again, as their answers are gone with it; what other rounds stored is not. Calls that fail are stored
    with their reason and asked again by the next run. One writer at a time.
    """
    spark = prompts.sparkSession
    wanted = prompts.where("prompt IS NOT NULL").select(_key(F.col("prompt")).alias("prompt_key"), "prompt").dropDuplicates(["prompt_key"])
    missing = wanted.join(stored_answers(spark, path).where("stored"), "prompt_key", "left_anti")
    missing = missing.withColumn("slot", F.pmod(F.xxhash64("prompt_key"), F.lit(MOST_ROUNDS)))
    folder = new_folder(spark, "prompts")
    missing.hint("rebalance", "slot").write.partitionBy("slot").parquet(folder)
    missing = spark.read.schema(missing.schema).parquet(folder)
    count = missing.count()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), chunk_rows):
                chunk = batch.iloc[at : at + chunk_rows]
                answers, errors = answered(complete, list(chunk["prompt"]))
                known = [e is None and a is not None for a, e in zip(answers, errors)]
                yield pd.DataFrame({"prompt_key": list(chunk["prompt_key"]), "answer": list(answers), "error": errors, "stored": known})

    rounds = min(math.ceil(count / (partitions * chunk_rows * chunks_per_round)), MOST_ROUNDS)
    for number in range(rounds):
        turn = missing.where(F.col("slot").isin(list(range(number, MOST_ROUNDS, rounds))))
        asked = turn.drop("slot").repartition(partitions, "prompt_key").mapInPandas(ask, ANSWERS)
        asked.write.mode("append").partitionBy("stored").parquet(path)
    return count


def stored_scorer(
    complete: Callable[[list[str]], Sequence[str | None]], path: str, partitions: int, chunk_rows: int = 32
) -> Scorer:
    """Scorer that buys what the store at ``path`` lacks and reads every verdict from it.

    A prompt without an answer gives a NULL verdict; the reason of its last failed call is in the judge's error column.
    """

    def score(dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        query, response = F.col("_query"), F.col("_response")
        texts = {judge: prompt(judge, query, response) for judge in JUDGES}
        # Responses repeat: prompts are made, asked and looked up once per pair of query and response.
        folder = new_folder(spark, "pairs")
        pairs = dataset.select(F.col("user_query").alias("_query"), F.col("agent_response").alias("_response")).distinct()
        pairs.write.parquet(folder)
        pairs = spark.read.schema(pairs.schema).parquet(folder)
        buy_verdicts(pairs.select(F.explode(F.array(*texts.values())).alias("prompt")), complete, path, partitions, chunk_rows)
        answers = stored_answers(spark, path)
        one = answers.groupBy("prompt_key").agg(
            F.max("answer").alias("answer"), F.max(F.when(F.col("answer").isNull(), F.col("error"))).alias("error")
        )
        verdicts, names = pairs, []
        for judge, text in texts.items():
            found = one.select(
                F.col("prompt_key").alias("_key"),
                F.col("answer").alias(raw_column(judge)),
                F.when(F.col("answer").isNull(), F.col("error")).alias(error_column(judge)),
            )
            verdicts = verdicts.join(found, _key(text) == F.col("_key"), "left").drop("_key")
            names += [raw_column(judge), error_column(judge)]
        same = F.col("user_query").eqNullSafe(query) & F.col("agent_response").eqNullSafe(response)
        return dataset.join(verdicts, same, "left").select(*dataset.columns, *names)

    return score
