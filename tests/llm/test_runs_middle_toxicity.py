"""Periodic runs (11), fill in the middle (12) and toxicity (13)."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import SF, WORD, by_id, documents, prose, rows_of
from tracewarden.llm import fill_in_middle as FM
from tracewarden.llm import periodic_runs as R
from tracewarden.llm import toxicity as X
from tracewarden.llm.words import Texts, utf8

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "a"), (904, "a " * 50_000), (905, "é" * 70_000), (None, "some words here"), (1, "again"), (1, "again")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts_of(*texts):
    return Texts(*utf8(pa.array(texts, pa.string())))


# --- Periodic runs ------------------------------------------------------------------


def brute_runs(words, min_length=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, 2 * q):
                found.setdefault((i, j - i + q), q)  # smaller periods come first
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 9), st.integers(0, 39), st.sampled_from([2, 5, 12]))
def test_maximal_runs_equal_brute_force(words, period, start, least):
    words = [w if i < start else words[start + (i - start) % period] if start + period <= len(words) else w for i, w in enumerate(words)]
    assert R.maximal_runs(np.array(words, np.uint64) * np.uint64(7919), least) == brute_runs(words, least)


def test_runs_of_long_texts_take_little_time():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 30_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    runs = R.maximal_runs(np.array(fibonacci[-1], np.uint64))
    assert len(runs) > 4_000 and all(length >= max(12, 2 * q) for _, length, q in runs)
    assert R.maximal_runs(np.ones(200_000, np.uint64)) == [(0, 200_000, 1)]


def run_texts():
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for k in range(120)]
    rows += [(200 + k, f"{prose(rng, 9)} {(prose(rng, 1 + k) + chr(10)) * rng.randrange(1, 9)} {prose(rng, 5)}") for k in range(30)]
    return [*rows, *ODD, (906, "x\x1fy " * 20), (907, "x\x0by\x0c" * 20), (908, prose(rng, 30_000, 5))]


def test_runs_of_documents_equal_brute_force(spark):
    rows = run_texts()
    found = R.periodic_runs(documents(spark, rows).repartition(3)).collect()
    expected = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        runs = brute_runs(words) if len(words) < 5_000 else None
        gone = {k for s, length, q in runs or [] for k in range(s + q, s + length)}
        expected.append((doc_id, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found]
    long = {904, 908}
    assert sorted((r for r in got if r[0] not in long), key=repr) == sorted((r for r in expected if r[0] not in long), key=repr)
    by = {r[0]: r for r in got}
    assert by[904][2:] == ([(0, 50_000, 1)], "a")
    assert all(r in set(by[908][2]) for r in brute_runs(WORD.findall(dict(rows)[908])[:300])[:5])


def test_planted_runs_and_their_digests(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randrange(0, 90))) for k in range(150)] + [(900, None), (901, ""), (None, prose(rng, 40))]

    def planted(doc_id, words):
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 or not n:
            return words
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [words[i if i < a else a + (i - a) % p] for i in range(n)]

    table = R.with_planted_runs(documents(spark, rows))
    got = {r["doc_id"]: WORD.findall(r["text"] or "") for r in table.collect()}
    assert got == {i: planted(i, WORD.findall(t or "")) for i, t in rows}
    assert sum(bool(brute_runs(w)) for w in got.values()) > 3


def test_a_document_has_one_row_and_reruns_agree(spark):
    first = rows_of(R.op11_periodic_runs(spark, SF))
    assert len(first) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert first == rows_of(R.op11_periodic_runs(spark, SF))
    assert R.periodic_runs(documents(spark, [])).collect() == []


# --- Fill in the middle -----------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def transformed(doc_id, text, unit="words"):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = TOKEN.findall(text) if unit == "words" else list(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def middle_texts():
    rng = random.Random(9)
    pieces = ["a", "word", "é", "ß", "日本", "🙂", "🙂🙂x", " ", "\n", "\t\x0b", " ", "\x1f", "<", "<P", ">", "<S", "é"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for k in range(400)]
    return [*rows, *[r for r in ODD if r[0] != 1], (910, "has <M> in it"), (911, "<P>"), (912, "🙂 " * 300_000), (913, " " * 500_000)]


@pytest.mark.parametrize("unit", ["words", "chars"])
def test_transformation_equals_plain_python_and_is_undone(spark, unit):
    rows = middle_texts()
    found = FM.restored(FM.fill_in_middle(documents(spark, rows).repartition(3), unit=unit))
    got = by_id(found, "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    assert len(got) == len(rows)
    for doc_id, text in rows:
        assert got[doc_id] == (*transformed(doc_id, text, unit), text or ""), doc_id
    assert {f for _, f, *_ in got.values()} == {"plain", "psm", "spm"}


def test_chunks_of_texts_do_not_change_the_cuts(spark, monkeypatch):
    table = documents(spark, middle_texts()).coalesce(1)
    whole = rows_of(FM.fill_in_middle(table))
    monkeypatch.setattr("tracewarden.llm.words.CHUNK_BYTES", 1)
    batch = table.select("text").toArrow().column(0)
    assert sum(len(t.counts) for _, t in FM.chunks(batch, 1)) == table.count()
    assert whole == rows_of(FM.fill_in_middle(table.repartition(5)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé日🙂 \n", max_size=60))
def test_index_turns_places_both_ways(text):
    data = np.frombuffer(text.encode(), np.uint8)
    index = FM.MultibyteIndex(data)
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:k].encode()) for k in chars])
    assert index.bytes(chars).tolist() == places.tolist() and index.chars(places).tolist() == chars.tolist()
    assert len(index.at) == sum(ord(c) > 127 for c in text)


def test_middle_of_an_empty_table_repeated_rows_and_wrong_units(spark):
    assert FM.restored(FM.fill_in_middle(documents(spark, []))).collect() == []
    twice = FM.fill_in_middle(documents(spark, [(1, "b c d e"), (1, "b c d e"), (1, "x")]), keep=("doc_id", "label", "rank")).collect()
    assert len(twice) == 3 and len({r["output"] for r in twice}) == 2 and {r["label"] for r in twice} == {"x"}
    with pytest.raises(ValueError):
        FM.fill_in_middle(documents(spark, []), unit="lines")
    nothing = spark.createDataFrame([("plain", None), (None, "x")], "form string, output string")
    assert [r["restored"] for r in FM.restored(nothing).collect()] == [None, None]


def test_query_digests(spark):
    source = by_id(spark.read.parquet(f"{SF}/documents.parquet"), "text")
    found = by_id(FM.op12_fill_in_middle(spark, SF), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    for doc_id, (text,) in source.items():
        *front, output = transformed(doc_id, text)
        assert found[doc_id] == (*front, sha(output), sha(text or ""))


# --- Toxicity -----------------------------------------------------------------------------


def plain_features(text, terms):
    """The features of a text, word by word; ``terms`` has the weight of each whole word."""
    insults = {w for line in X.INSULTS.values() for w in line.split()}
    persons = {w for line in X.SECOND_PERSON.values() for w in line.split()}
    words = WORD.findall(text)
    n = len(words)
    plain = ["".join(c for c in w.lower() if c.isalpha() or ord(c) > 127) for w in words]
    weight = [terms.get(p, 0.0) for p in plain]
    general = [p in insults for p in plain]
    hit = [g or w > 0 for g, w in zip(general, weight)]
    person = [p in persons for p in plain]
    near = [h and any(person[max(0, k - X.NEAR_WORDS) : k + X.NEAR_WORDS + 1]) for k, h in enumerate(hit)]
    upper, lower = sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in text), sum("a" <= c <= "z" for c in text)
    shout = sum(sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in w) >= 2 and not any("a" <= c <= "z" for c in w) for w in words)
    return {
        "words": np.log1p(n),
        "insults": np.log1p(sum(general)),
        "insult_density": sum(general) / (n + 10),
        "terms": np.log1p(sum(w > 0 for w in weight)),
        "term_weight": sum(weight),
        "strongest_term": max(weight, default=0),
        "second_person_density": sum(person) / (n + 10),
        "hits_near_second_person": np.log1p(sum(near)),
        "share_near_second_person": sum(near) / max(sum(hit), 1),
        "capitals": upper / (upper + lower + 20),
        "capital_words": shout / (n + 10),
        "marks": sum(c in "!?" for c in text) / (n + 10),
        "repeated_marks": sum(a in "!?" and b in "!?" for a, b in zip(text, text[1:])) / (n + 10),
    }


def test_features_equal_plain_python():
    rng = random.Random(3)
    vocabulary = ["you", "Idiot!", "DU", "bist", "Trottel", "fine", "ÉTÉ", "tu", "zap.", "a", "loser??", "OK", "B", "Ünder", "\n", "!!", "vous,", "zapp"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(80)] + ["", "you", "zap"]
    lexicon = X.Lexicon(X.keys_of([b"zap", b"fine"]), np.array([3.5, 2.25]))
    x = X.features(texts_of(*texts), texts_of(*[t.lower() for t in texts]), lexicon)
    assert x.shape == (len(texts), len(X.FEATURES))
    for row, text in zip(x, texts):
        found = dict(zip(X.FEATURES, row))
        for name, value in plain_features(text, {"zap": 3.5, "fine": 2.25}).items():
            assert found[name] == pytest.approx(value), (name, text)


def test_disguised_words_are_found():
    texts = ["1d10t", "stup!d", "$tupid", "l.o.s.e.r", "i d i o t", "stuuuupid", "m0r0n!!", "idi*t", "of$$$ the%%%", "clown", "a b"]
    pair = texts_of(*texts)
    x = X.features(pair, pair, X.Lexicon(np.zeros(0, np.uint64), np.zeros(0)))
    hits = dict(zip(texts, x[:, X.FEATURES.index("insults")] > 0))
    assert [t for t in texts if hits[t]] == ["1d10t", "stup!d", "$tupid", "l.o.s.e.r", "i d i o t", "stuuuupid", "m0r0n!!", "clown"]
    assert x[texts.index("of$$$ the%%%"), X.FEATURES.index("signed_words")] == 0


def test_terms_are_words_and_beginnings_of_longer_ones():
    pair = texts_of("Achlichver éèx".lower())
    _, keys = X.Forms(pair).terms()
    begin = [b"achlichver"[:k] for k in X.PREFIX_BYTES if k < 10] + ["éè".encode()]
    assert set(keys.tolist()) == {*X.keys_of([b"achlichver", "éèx".encode()]).tolist(), *(X.keys_of(begin) ^ X._PREFIX_KEY).tolist()}


def corpus(rng, n):
    """Clean prose and texts with invented insults that no list has."""
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = prose(rng, rng.randrange(30, 120), 3000).split()
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorbag", "blorpface", "grimmelk" + rng.choice("abcdefgh")]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_terms_of_labelled_texts_are_learned_and_generalise(spark):
    rng = random.Random(2)
    rows, labels = corpus(rng, 800)
    model = X.learn(documents(spark, rows), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int"))
    fresh = [(5_000 + k, t) for k, (_, t) in enumerate(corpus(rng, 200)[0])]
    fresh += [(9_000, "what a ZORBAG, you"), (9_001, "grimmelkqqq " + prose(rng, 60, 3000)), *ODD]
    score = {r["doc_id"]: r["score"] for r in X.scored(documents(spark, fresh), model, ("doc_id", "label")).collect()}
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == len(fresh) - 1
    wrong = [k for k in range(200) if (score[5_000 + k] >= 0.3) != (k % 4 == 0)]
    assert len(wrong) <= 6 and score[9_001] >= 0.3
    assert score[900] == score[901]


def test_labels_of_one_kind_or_none_give_scores_of_zero(spark):
    rows, labels = corpus(random.Random(1), 40)
    table = documents(spark, [*rows, *ODD])
    for known in ([], [(k, 0) for k, _ in labels]):
        model = X.learn(table, spark.createDataFrame(known, "doc_id long, toxic int"))
        assert {r["score"] for r in X.scored(table, model).collect()} == {0.0}
    assert X.scored(documents(spark, []), model).collect() == []


def test_toxicity_of_held_out_documents(spark):
    source = "/root/testdata/sf0.1"
    found = by_id(X.op13_toxicity(spark, source), "held_out", "score", "predicted")
    assert len(found) == 10_000
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= s <= 1 and p == int(s >= 0.3) for i, (h, s, p) in found.items())
    truth = by_id(spark.read.parquet(f"{source}/labels.parquet"), "toxic")
    apart = [(t, found[i][2]) for i, (t,) in truth.items() if found[i][0]]
    assert sum(t == p for t, p in apart) >= 0.97 * len(apart)
    toxic = [p for t, p in apart if t == 1]
    assert sum(toxic) >= 0.88 * len(toxic)
