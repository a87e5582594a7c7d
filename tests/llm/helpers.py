from __future__ import annotations

import re

from tracewarden.llm.tables import ship_library

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """A table of documents from (doc_id, text) or longer tuples; columns that operators use inside are extra."""
    ship_library(spark)
    full = [(*r, *(None,) * (4 - len(r))) for r in rows]
    table = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in full], DOCUMENTS)
    return with_clashes(table)


def with_clashes(table):
    """Extra columns whose names operators use for their own."""
    for name in ("key", "value", "score", "rep", "n", "size", "seed", "sequence_id", "n_words", "_doc_id", "label", "grp", "rank"):
        if name not in table.columns:
            table = table.selectExpr("*", f"'x' AS {name}")
    return table


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))
