"""Quality ranking (6), quality rules (8) and language identification (10)."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tests.llm.helpers import SF, WORD, by_id, documents, prose
from tracewarden.llm import language_id as L
from tracewarden.llm import outliers as O
from tracewarden.llm import quality_ranking as Q
from tracewarden.llm.words import Texts

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "a"), (904, "a " * 50_000), (905, "é" * 70_000), (None, "some words here"), (1, "again"), (1, "again")]
SCALE = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# --- Quality rules ----------------------------------------------------------------


def base_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_statistics_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, "\n".join(prose(rng, rng.randrange(0, 12), 4) + rng.choice(["", " #|", "\r", "  ", "é\x1f"]) for _ in range(rng.randrange(1, 9)))) for k in range(200)]
    rows = [r for r in [*rows, *ODD] if r[0] != 1] + [(910, "x\n\nx\nx y\x0b\nx"), (911, "a b c d e f a b c d e g a b c d")]
    found = by_id(O.quality_rules(documents(spark, rows)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert found == {i: base_statistics(t) for i, t in rows}


def test_rules_reject_outliers_and_keep_the_rest(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randrange(20, 200), 5000), "en", f"s{k % 2}") for k in range(400)]
    rows += [(1000 + k, " ".join(w + "###" for w in prose(rng, 80, 5000).split()), "en", "s0") for k in range(8)]
    rows += [(2000, prose(rng, 50, 5000), None, None), (2001, None, "en", "s0"), (2002, "too short", "en", "s0")]
    verdicts = {i: (kept, failed) for i, (kept, failed) in by_id(O.quality_rules(documents(spark, rows)), "kept", "base_failed").items()}
    assert all(verdicts[k] == (True, False) for k in range(400)) and verdicts[2000] == (True, False)
    assert all(verdicts[1000 + k] == (False, False) for k in range(8))
    assert verdicts[2001] == verdicts[2002] == (False, True)


def regularised(near, floor=0.1):
    s = np.cov(near.T, bias=True)
    cov = (1 - O.SHRINKAGE) * s + O.SHRINKAGE * np.diag(np.diag(s)) + floor**2 * np.eye(len(s))
    return near.mean(0), cov, np.linalg.slogdet(cov)[1]


def squared(x, centre, cov):
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)


def nearest(x, d, share):
    return x[d <= np.sort(d)[int(np.ceil(share * len(d))) - 1]]


def test_distances_equal_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {}
    for g in range(3):
        x = rng.normal(size=(300, 2)) @ np.array([[1.0, 0.5], [0.0, 0.7]]) + g
        x[: 40 + 10 * g] += 9
        groups[f"g{g}"] = x
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "grp string, x_0 double, x_1 double")
    found = {(r["grp"], r["x_0"], r["x_1"]): r["distance"] for r in O.robust_distances(rows, 2, [0.1, 0.1]).collect()}
    for g, x in groups.items():
        q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
        medians = (q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2 + 0.01))
        starts = [medians, regularised(x)[:2], regularised(nearest(x, squared(x, *medians), 0.5))[:2]]
        ends = []
        for centre, cov in starts:
            least = np.inf
            while True:
                new = regularised(nearest(x, squared(x, centre, cov), O.KEPT_SHARE))
                if new[2] >= least - 1e-9:
                    break
                centre, cov, least = new
            ends.append((least, centre, cov))
        least, centre, cov = min(ends, key=lambda e: e[0])
        want = squared(x, centre, cov) * O.CONSISTENCY
        assert np.allclose([found[g, float(a), float(b)] for a, b in x], want, rtol=1e-6)
        assert want[:40].min() > 4 * want[70:].max()


def test_smallest_determinant_of_all_subsets(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g in range(6):
        x = rng.normal(size=(12, 2)) @ rng.normal(size=(2, 2))
        x[:3] += rng.normal(size=2) * 2 + 12
        rows += [(f"g{g}", *map(float, r)) for r in x]
        want[f"g{g}"] = min(regularised(x[list(kept)])[2] for kept in combinations(range(12), 9))
    table = spark.createDataFrame(rows, "grp string, x_0 double, x_1 double")
    found = {r["grp"]: r["log_det"] for r in O.minimum_determinants(table, 2, [0.1, 0.1]).collect()}
    assert found == pytest.approx(want, abs=1e-9)


def test_groups_of_one_row_and_of_equal_rows(spark):
    rows = [("one", 1.0, 2.0)] + [("same", 3.0, 3.0)] * 40
    found = O.robust_distances(spark.createDataFrame(rows, "grp string, x_0 double, x_1 double"), 2, [0.1, 0.1]).collect()
    assert len(found) == 41 and all(abs(r["distance"]) < 1e-9 for r in found)


def test_rules_use_no_python_and_take_an_empty_table(spark):
    assert O.quality_rules(documents(spark, [])).collect() == []
    for frame in (O.statistics(documents(spark, ODD)), O.quality_rules(documents(spark, ODD))):
        plan = frame._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- Language -----------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    found = by_id(L.op10_language_id(spark, SCALE), "held_out", "lang_pred", "score")
    truth = by_id(spark.read.parquet(f"{SCALE}/documents.parquet"), "lang")
    assert all(h == held_out(i) and 0 <= s <= 1 for i, (h, _, s) in found.items())
    apart = [i for i, (h, _, _) in found.items() if h]
    assert sum(found[i][1] == truth[i][0] for i in apart) >= 0.98 * len(apart)


def test_language_of_odd_texts(spark):
    model = L.train(["the cat and the dog"] * 30 + ["der hund und die katze"] * 30, ["en"] * 30 + ["de"] * 30)
    rows = [*ODD, (920, "12 34 !!"), (921, "The dogs and the cats"), (922, "die Hunde")]
    found = by_id(L.identify(documents(spark, rows), model), "lang_pred", "score")
    assert all(found[i] == ("und", 0.0) for i in (900, 901, 902, 920))
    assert found[921][0] == "en" and found[922][0] == "de"
    assert L.identify(documents(spark, []), model).collect() == []
    none = L.train([], [])
    assert by_id(L.identify(documents(spark, ODD[3:4]), none), "lang_pred") == {903: ("und",)}
    assert L.training_sample(documents(spark, ODD)).collect() == []


def test_long_texts_have_all_their_subwords(monkeypatch):
    def counts(texts):
        table = Counter()
        for rows, buckets in L.subwords(texts):
            table.update(zip(rows.tolist(), buckets.tolist()))
        return table

    texts = ["ab cde, f", "", "x" * 50, "das ist ein Satz. " * 9]
    whole = counts(texts)
    monkeypatch.setattr(L, "CHUNK_CHARS", 7)
    assert counts(texts) == whole
    alone = [counts([t]) for t in texts]
    assert {k: sorted(n for (r, _), n in whole.items() if r == k) for k in range(4)} == {k: sorted(alone[k].values()) for k in range(4)}
    assert sum(counts(["abc"]).values()) == 4 + 3 + 2  # with its edges 4 pairs, 3 triples and 2 quadruples


# --- Quality ranking -----------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    found = by_id(Q.op6_quality_ranking(spark, SCALE), "held_out", "score", "predicted")
    labels = by_id(spark.read.parquet(f"{SCALE}/labels.parquet"), "quality")
    assert len(found) == 1000 and all(h == held_out(i) and 0 <= s <= 1 and p == (s >= 0.3) for i, (h, s, p) in found.items())
    apart = [i for i in labels if found[i][0]]
    assert sum(found[i][2] == labels[i][0] for i in apart) >= 0.95 * len(apart)


def test_quality_of_odd_texts_and_labels(spark):
    table = documents(spark, [*ODD, *[(k, "fine words all along here " * 4) for k in range(2, 30)], *[(k, "# # # # junk # #" * 9) for k in range(30, 60)]])
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(2, 60)] + [(None, 1), (3, None), (9999, 1), (4, 1)], "doc_id long, quality int")
    scores = by_id(Q.scored(table, Q.learn(table, labels)), "score")
    assert min(scores[k][0] for k in range(2, 30)) > 0.3 > max(scores[k][0] for k in range(30, 60))
    assert all(0 <= s <= 1 for (s,) in scores.values()) and len(scores) == 66
    for some in (labels.where("quality = 1"), labels.limit(0)):
        assert {round(s, 6) for (s,) in by_id(Q.scored(table, Q.learn(table, some)), "score").values()} == {Q.CUT_SCORE}
    assert Q.scored(documents(spark, []), Q.learn(table, labels)).collect() == []


def test_quality_cut_covers_all_labelled_rows(spark):
    rng = random.Random(6)
    # Good and bad words in any share, so that scores spread and labels overlap.
    rows = []
    for k in range(1200):
        good = rng.random()
        text = " ".join("fine" if rng.random() < good else "#junk" for _ in range(rng.randrange(20, 60)))
        rows.append((k, text, int(rng.random() < good**2)))
    table = documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    model = Q.learn(table, labels, rows_per_class=40)
    scores = sorted(s for (s,) in by_id(Q.scored(table, model), "score").values())
    bad = sum(1 - y for _, _, y in rows)
    assert scores[bad - 1] <= Q.CUT_SCORE + 1e-9 and scores[bad] >= Q.CUT_SCORE - 1e-9


def test_quantile_cut_is_exact(spark):
    rng = random.Random(7)
    values = [rng.choice([rng.gauss(0, 1), 1e6 * rng.random(), 0.25, -3.0]) for _ in range(2000)]
    rows = [(int(k >= 700), v) for k, v in enumerate(values)]
    in_order = sorted(values)
    assert Q.quantile_cut(spark.createDataFrame(rows, "label int, utility double")) == (in_order[699] + in_order[700]) / 2


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    def of(texts):
        data = [t.encode() for t in texts]
        return Q.features(Texts(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])))

    texts = ["a a a b", "", "Same line\nSame line!", "b"]
    assert np.allclose(of(texts), np.vstack([of([t]) for t in texts]))


def test_counts_of_the_sample_are_those_of_its_texts(spark):
    """What is learned from comes as bounded counts in the sample's order, with ties of languages and repeated rows."""
    rows = [(k, f"das ist Text {k} " * (k % 4), "de" if k % 2 else "en", "s") for k in range(40)] + [(50, "é" * 200_000, "fr", "s"), (51, "", "fr", "s")]
    sample = L.training_sample(documents(spark, [*rows, rows[3]]))
    counts, langs = L.counted_sample(sample)
    texts = sample.toPandas()
    assert langs == texts["lang"].tolist() and len(counts) == len(rows) + 1
    for (buckets, n), text in zip(counts, texts["text"]):
        table = Counter(b for _, found in L.subwords([text]) for b in found.tolist())
        assert dict(zip(buckets.tolist(), n.tolist())) == table
    assert max(len(b) for b, _ in counts) <= L.BUCKETS
    one, two = L.train_on_counts(counts, langs), L.train(texts["text"].tolist(), langs)
    assert (one.table == two.table).all() and one.accept_from == two.accept_from
    assert L.counted_sample(L.training_sample(documents(spark, []))) == ([], [])


def test_a_model_scores_as_plain_python_does():
    model = L.train(["the cat and the dog"] * 30 + ["der hund und die katze"] * 30, ["en"] * 30 + ["de"] * 30)
    for text in ("the dog", "die katze!", "x", "hund hund dog"):
        found = Counter()
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            for _, buckets in L.subwords([word]):
                found.update(buckets.tolist())
        total = sum(found.values())
        mean = sum((n / total) * model.table[b].astype(float) for b, n in found.items())
        scores = np.exp((mean + model.bias) / model.temperature)
        names, score, _ = model.predict([text])
        assert names[0] == model.languages[int(np.argmax(scores))] and np.isclose(score[0], scores.max() / scores.sum())
