import random
from collections import Counter

import numpy as np

from panelloom.llm import quality
from tests.llm.helpers import clashing, frame, opposite_words, words

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    w = (text or "").split()
    runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if line.split():
            again += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(hit))


def corpus(rng):
    good = [" ".join(words(rng, rng.randint(20, 90))) for _ in range(200)]
    poor = [" ".join(x + "###" for x in words(rng, 40)) for _ in range(80)]
    poor += [" ".join(x.upper() + "!!" for x in words(rng, 40)) for _ in range(80)]
    return good, poor


def test_counts_match_brute_force():
    rng = random.Random(6)
    texts = ["", "é ü\né ü\n\n \n", "a b c d e " * 4, "x" * 50_000, "a|b <c> #d $e% *f & g", " ".join(words(rng, 4000)), "r s t\nr s t\r\n" * 9, "a a a a a a a"]
    assert [tuple(r[:5]) for r in quality.text_counts(texts).tolist()] == [brute(t) for t in texts]


def test_words_that_polynomials_confuse():
    x, y = opposite_words()
    texts = [f"{x} b c d e {y} b c d e", f"{x} b c d e {x} b c d e"]
    assert [tuple(r[:5]) for r in quality.text_counts(texts).tolist()] == [brute(t) for t in texts]


def test_learned_list_rejects_by_ordered_expression(spark):
    rng = random.Random(7)
    good, poor = corpus(rng)
    docs = frame(spark, good + poor)
    labels = spark.createDataFrame([(k, int(k < 200), 0) for k in range(360)] + [(None, 1, 0), (3, None, 0)], LABELS)
    rules = quality.learn_rules(docs, labels)
    assert rules.rules and rules == quality.learn_rules(docs.repartition(3), labels)
    fresh_good, fresh_poor = corpus(random.Random(8))
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, fresh_good + fresh_poor), rules).select("__row.doc_id", "kept").collect()}
    assert all(got[k] for k in range(200)) and sum(got[k] for k in range(200, 360)) <= 3


def test_edges(spark):
    docs = clashing(frame(spark, [None, "", "few words", " ".join("abcdefghijkl"), " ".join(["x y z u v"] * 10)], ids=[None, 1, 2, 3, 3]))
    none = spark.createDataFrame([], LABELS)
    got = quality.quality_report(docs, none).collect()
    assert {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in got} == {(None, 0, True, False), (1, 0, True, False), (2, 2, True, False), (3, 12, False, True), (3, 50, True, False)}
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 1
    assert quality.quality_report(docs.limit(0), none).count() == 0
    assert quality.learn_list(np.zeros((5, 9)), np.array([True] * 5)).rules == ()


def test_a_condition_is_the_best_of_all_thresholds():
    rng = np.random.default_rng(3)
    for _ in range(20):
        v, bad = np.round(rng.normal(size=60), 1), rng.random(60) < 0.4
        best = 0.0
        for t in np.unique(v)[:-1]:
            for hit in (v <= t, v > t):
                p, n = (hit & bad).sum(), (hit & ~bad).sum()
                if p:
                    best = max(best, p * (np.log2(p / (p + n)) - np.log2(bad.mean())))
        found = quality._cut(v, bad, np.unique(v))
        assert (found is None) == (best <= 1e-9) and (found is None or abs(found[0] - best) < 1e-9)


def test_held_out_rows_are_judged_by_a_list_learned_without_them():
    rng = np.random.default_rng(4)
    x = rng.random((500, len(quality.FEATURES)))
    got = quality.measured(x, x[:, 2] > 0.7)
    assert got["rows"] == 100 and got["precision"] > 0.9 and got["recall"] > 0.9


def test_a_repeated_id_counts_once_in_the_sample(spark):
    docs = frame(spark, ["a b c " * (k % 9 + 1) for k in range(900)], ids=[k % 3 for k in range(900)]).repartition(4)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (2, 1, 1)], LABELS)
    x, poor = quality.labelled_sample(docs, labels, max_rows=10)
    assert len(x) == 3 and poor.sum() == 1
    assert (quality.labelled_sample(docs.repartition(2), labels, max_rows=10)[0] == x).all()
