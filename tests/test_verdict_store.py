"""Verdicts that are bought once."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter

import pytest

from tracewarden.operators import judges as J
from tracewarden.operators import verdict_store as VS
from tracewarden.session import new_folder


def counting(folder, fails_on=None, dies_on=None):
    """Answers prompts and leaves a file for each one asked, which tests on one machine can count."""
    folder = str(folder)

    def complete(prompts):
        if fails_on and any(fails_on in p for p in prompts):
            raise RuntimeError("no answer")
        if dies_on and any(dies_on in p for p in prompts) and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)  # the worker is gone, as with a lost executor
        for p in prompts:
            with open(f"{folder}/{uuid.uuid4().hex}.json", "w") as out:
                json.dump(p, out)
        return [json.dumps({"score": 0.5, "reasoning": str(len(p))}) for p in prompts]

    return complete


def asked(folder):
    return Counter(json.load(open(f"{folder}/{f}")) for f in os.listdir(folder) if f.endswith(".json"))


def dataset(spark, numbers):
    rows = [(f"TR{n}", f"question {n % 30}", f"answer {n % 30}") for n in numbers]
    return spark.createDataFrame([*rows, ("none", None, "a")], "trace_id string, user_query string, agent_response string")


def test_each_different_prompt_is_asked_once_over_runs_and_uses(spark, tmp_path):
    stub, path = counting(tmp_path), new_folder(spark, "verdicts")
    scorer = VS.stored_scorer(stub, path, partitions=2, chunk_rows=3)
    first = scorer(dataset(spark, range(20)))
    assert first.count() == 21 and first.collect() and first.repartition(3).count() == 21
    rows = {r.trace_id: r for r in scorer(dataset(spark, range(60))).collect()}
    assert len(rows) == 61 and set(asked(tmp_path).values()) == {1} and len(asked(tmp_path)) == 30 * len(J.JUDGES)
    assert all(json.loads(rows["TR3"][J.raw_column(j)])["score"] == 0.5 for j in J.JUDGES)
    assert all(rows["none"][J.raw_column(j)] is None and rows["none"][J.error_column(j)] is None for j in J.JUDGES)


def test_a_run_that_broke_off_goes_on_where_it_stopped(spark, tmp_path):
    path = new_folder(spark, "verdicts")
    stub = counting(tmp_path, dies_on="question 17")
    data = dataset(spark, range(30))
    prompts = data.select(J.prompt("safety", data.user_query, data.agent_response).alias("prompt"))
    with pytest.raises(Exception, match="worker|crash|EOF|exited"):
        VS.buy_verdicts(prompts, stub, path, partitions=2, chunk_rows=2)
    kept = VS.stored_answers(spark, path).where("stored").count()
    assert VS.buy_verdicts(prompts, stub, path, partitions=2, chunk_rows=2) == 30 - kept
    calls = asked(tmp_path)
    assert len(calls) == 30 and sum(calls.values()) <= 30 + 2 * 2 * 4  # at most the broken round again
    assert VS.buy_verdicts(prompts, stub, path, partitions=2) == 0 and asked(tmp_path) == calls


def test_failed_calls_give_reasons_and_are_asked_again(spark, tmp_path):
    path = new_folder(spark, "verdicts")
    data = dataset(spark, range(6))
    broken = VS.stored_scorer(counting(tmp_path, fails_on="question 4"), path, partitions=1, chunk_rows=1)
    rows = {r.trace_id: r for r in broken(data).collect()}
    assert rows["TR4"].safety_raw is None and rows["TR4"].safety_error == "RuntimeError: no answer"
    assert rows["TR3"].safety_raw is not None and rows["TR3"].safety_error is None
    mended = VS.stored_scorer(counting(tmp_path), path, partitions=1, chunk_rows=1)
    again = {r.trace_id: r for r in mended(data).collect()}
    assert again["TR4"].safety_raw is not None and again["TR4"].safety_error is None
    assert again["TR3"].safety_raw == rows["TR3"].safety_raw and set(asked(tmp_path).values()) == {1}


def test_no_rows_ask_nothing(spark, tmp_path):
    path = new_folder(spark, "verdicts")
    stub = counting(tmp_path)
    assert VS.stored_scorer(stub, path, partitions=2)(dataset(spark, range(1)).where("false")).collect() == []
    assert not asked(tmp_path)


def test_rounds_are_bounded_and_read_only_their_own_prompts(spark, monkeypatch):
    """Every round is a job; as many as there are chunks would each read all prompts again."""
    path, turns, frames = new_folder(spark, "verdicts"), [], type(spark.range(1))
    map_in_pandas = frames.mapInPandas

    def watched(self, *args, **kwargs):
        turns.append(self._jdf.queryExecution().toString())
        return map_in_pandas(self, *args, **kwargs)

    monkeypatch.setattr(frames, "mapInPandas", watched)
    monkeypatch.setattr(VS, "MOST_ROUNDS", 8)
    prompts = spark.range(200).selectExpr("concat('prompt ', id) AS prompt")
    assert VS.buy_verdicts(prompts, lambda texts: texts, path, partitions=1, chunk_rows=1) == 200
    assert len(turns) <= VS.MOST_ROUNDS and all(re.search(r"PartitionFilters: \[[^\]]*slot", plan) for plan in turns)
    assert VS.stored_answers(spark, path).where("stored").count() == 200


def test_repeated_responses_travel_to_the_judges_once(spark, tmp_path, monkeypatch):
    """Prompts are made per different pair of query and response, not per response."""
    given, buy = [], VS.buy_verdicts

    def watched(prompts, *args):
        given.append(prompts.count())
        return buy(prompts, *args)

    monkeypatch.setattr(VS, "buy_verdicts", watched)
    scorer = VS.stored_scorer(counting(tmp_path), new_folder(spark, "verdicts"), partitions=2)
    assert scorer(dataset(spark, range(60))).count() == 61
    assert given == [31 * len(J.JUDGES)]
