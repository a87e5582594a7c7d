from __future__ import annotations

import math
import re

import pytest

from tracewarden.operators import search as S
from tracewarden.operators import search_index as SX
from tracewarden.session import new_folder

DOCUMENTS = {
    "d1": "Access to data is denied. Access!",
    "d2": "Data about data, and security of data",
    "d3": "Nothing to see",
    "d4": "ACCESS to SECURITY data",
    "d5": "accessible datasets only",
    "d6": "",
    "d7": "Access to data is denied. Access!",
}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, v, "even" if int(k[1]) % 2 == 0 else "odd") for k, v in DOCUMENTS.items()]
    return spark.createDataFrame(rows, "doc_id string, body string, parity string")


def brute_force(query, keep=lambda doc_id: True):
    words = {k: re.findall(r"[^\W_]+", v.lower()) for k, v in DOCUMENTS.items()}
    mean = sum(map(len, words.values())) / len(words)
    scores = {}
    for doc_id, tokens in words.items():
        total = 0.0
        for term in dict.fromkeys(query.lower().split()):
            containing = sum(term in w for w in words.values())
            tf = tokens.count(term)
            idf = math.log(1 + (len(words) - containing + 0.5) / (containing + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / mean))
        if total > 0 and keep(doc_id):
            scores[doc_id] = round(total, 6)
    return sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))


def found(rows):
    return [(r.doc_id, r.score) for r in rows.collect()]


@pytest.mark.parametrize("query", ["data access security", "denied", "data", "unknown access", "Data DATA data"])
def test_scores_agree_with_brute_force(corpus, query):
    assert found(S.search(corpus, "body", query, [], limit=10)) == brute_force(query)


def test_limit_and_ties(corpus):
    assert [d for d, _ in found(S.search(corpus, "body", "denied access", [], limit=1))] == ["d1"]


def test_filter_changes_the_documents_but_not_their_scores(corpus):
    rows = S.search(corpus, "body", "data access", ["parity"], {"parity": "even"}, limit=10)
    assert found(rows) == brute_force("data access", lambda d: int(d[1]) % 2 == 0)
    assert {r.parity for r in rows.collect()} == {"even"}


def test_parts_of_words_do_not_count(corpus):
    assert "d5" not in dict(found(S.search(corpus, "body", "access data", [], limit=10)))


def test_query_without_terms(corpus):
    with pytest.raises(ValueError):
        S.search(corpus, "body", "?!", [])


def test_index_gives_the_same_ranking(spark, corpus):
    path = new_folder(spark, "index")
    # Two batches, the second of which is written twice; its number of buckets is not asked for again.
    SX.index_documents(corpus.where("parity = 'odd'"), "body", path, buckets=4)
    for _ in range(2):
        SX.index_documents(corpus.where("parity = 'even'"), "body", path)
    for query in ("data access security", "denied", "unknown access", "nowhere"):
        assert found(SX.search_index(spark, path, query, [], limit=10)) == brute_force(query)
    even = SX.search_index(spark, path, "data access", ["parity"], {"parity": "even"}, 10)
    assert found(even) == brute_force("data access", lambda d: int(d[1]) % 2 == 0)


def test_index_follows_redelivered_changed_and_withdrawn_documents(spark, corpus):
    path = new_folder(spark, "index")
    early = corpus.selectExpr("doc_id", "if(doc_id IN ('d1', 'd3'), 'access denied, denied', body) AS body", "parity")
    gone = spark.createDataFrame([("d9", "data data denied", "odd")], corpus.schema)
    SX.index_documents(early.union(gone), "body", path, buckets=4)
    changed = corpus.where("doc_id IN ('d1', 'd3', 'd4')")
    SX.index_documents(changed.union(changed), "body", path, withdrawn=gone)
    SX.index_documents(corpus.where("doc_id = 'd1'"), "body", path)
    for query in ("data access security", "denied"):
        assert found(SX.search_index(spark, path, query, [], limit=10)) == brute_force(query)


def test_a_change_that_breaks_off_is_not_seen(spark, corpus, monkeypatch):
    path = new_folder(spark, "index")
    SX.index_documents(corpus, "body", path)
    other = corpus.selectExpr("concat(doc_id, 'x') AS doc_id", "body", "parity")

    def lost(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(SX, "_switch", lost)
    with pytest.raises(RuntimeError):
        SX.index_documents(other, "body", path)
    assert found(SX.search_index(spark, path, "data access", [], limit=10)) == brute_force("data access")
    monkeypatch.undo()
    SX.index_documents(other, "body", path)
    assert SX.current(spark, path)["documents"] == 2 * len(DOCUMENTS)


def test_a_search_under_way_keeps_its_folder(spark, corpus):
    path = new_folder(spark, "index")
    SX.index_documents(corpus, "body", path)
    first = SX.current(spark, path)
    rows = SX.search_index(spark, path, "data access", [], limit=10)
    SX.index_documents(corpus.limit(1), "body", path)
    assert found(rows) == brute_force("data access")
    SX.index_documents(corpus.limit(1), "body", path)
    file, system = SX._file(spark, first["folder"])
    assert not system.exists(file)


def test_empty_index(spark, corpus):
    path = new_folder(spark, "index")
    for _ in range(2):
        SX.index_documents(corpus.limit(0), "body", path)
        assert found(SX.search_index(spark, path, "data", [])) == []
    SX.index_documents(corpus, "body", path)
    assert found(SX.search_index(spark, path, "data", [])) == brute_force("data")


def test_index_reads_only_the_buckets_it_needs(spark, corpus):
    path = new_folder(spark, "index")
    SX.index_documents(corpus, "body", path, buckets=64)
    now = SX.current(spark, path)
    assert now["term_buckets"] == 64
    plan = SX.postings_of(spark, now, ["denied"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*term_bucket", plan)
    plan = SX.search_index(spark, path, "denied", [])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*doc_bucket", plan)


def test_search_neither_shuffles_nor_pairs_documents(corpus):
    plan = S.search(corpus, "body", "data access", [], limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    for operator in ("hashpartitioning", "rangepartitioning", "NestedLoop", "CartesianProduct"):
        assert operator not in plan


def test_terms_are_cut_like_tokens(spark):
    text = "Ünder_score ÉTÉ 42x ١٢ a-b"
    row = spark.createDataFrame([(text,)], "t string").select(S.tokens(S.F.col("t"))).head()[0]
    assert S.query_terms(text) == list(dict.fromkeys(row))


def test_stored_index_is_built_again_once_its_table_changes(spark, tmp_path):
    from tracewarden import catalog

    def corpus(spark, sf_dir):
        return spark.read.parquet(f"{sf_dir}/texts.parquet")

    index = catalog._index("changing-index", corpus, "body")
    for text in ("old words", "new words, and more"):
        rows = spark.createDataFrame([("d1", text)], "doc_id string, body string")
        rows.write.mode("overwrite").parquet(f"{tmp_path}/texts.parquet")
        path = index(spark, str(tmp_path))
        assert index(spark, str(tmp_path)) == path
        assert [r.body for r in SX.search_index(spark, path, "words", ["body"]).collect()] == [text]

def test_copies_of_a_text_share_their_postings(spark, corpus):
    """Logs repeat texts: words are kept once per text, and counts and scores are those of all documents."""
    path = new_folder(spark, "index")
    SX.index_documents(corpus, "body", path, buckets=4)
    now = SX.current(spark, path)
    postings = SX.postings_of(spark, now)
    assert postings.where("term = 'access'").count() == 2  # d1 and d7 are equal
    assert (now["documents"], now["words"]) == (7, sum(len(re.findall(r"[^\W_]+", v)) for v in DOCUMENTS.values()))
    # A text stays as long as one document has it.
    for gone, left in (("d1", 1), ("d7", 0)):
        SX.index_documents(corpus.limit(0), "body", path, withdrawn=corpus.where(f"doc_id = '{gone}'"))
        assert SX.postings_of(spark, SX.current(spark, path)).where("term = 'denied'").count() == left


def test_words_are_counted_without_a_shuffle(spark, corpus):
    texts = corpus.selectExpr("xxhash64(body) AS text_id", "body AS text")
    plan = SX._postings(texts, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    counted = {(r.term, r.frequency) for r in SX._postings(texts.where("text LIKE 'Data about%'"), 4).collect()}
    assert counted == {("data", 3), ("about", 1), ("and", 1), ("security", 1), ("of", 1)}


def test_notes_of_a_changed_index_are_made_once(spark, as_of, monkeypatch):
    from tracewarden import catalog
    from tracewarden.sources import sample_logs

    folder, made, seen = "/root/testdata/sf0.001", sample_logs.notes, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(sample_logs, "notes", lambda *given: (rows := made(*given)).mapInArrow(counted, rows.schema))
    catalog.QUERIES["search_notes_changed"](spark, folder)
    assert seen.value == made(spark, folder, as_of).count()
