import random

import numpy as np
import pytest

from panelloom.llm import graph, neardup
from tests.llm.helpers import clashing, frame, opposite_words, words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = (text or "").translate(FOLD).split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(ids, texts, width):
    sets = [shingles(t, width) for t in texts]
    names = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                inter = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                    names[i] = names[j] = min(names[i], names[j])
    by = {}
    for k, n in enumerate(names):
        by.setdefault(n, []).append(ids[k])
    return [(len(s), min(by[n])) for s, n in zip(sets, names, strict=True)]


def corpus(rng):
    texts = []
    for _ in range(12):
        base = words(rng, rng.randint(30, 120))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)[0].upper()
            texts.append(" ".join(w))
    chain = words(rng, 100)
    for k in range(8):  # neighbours are alike, the ends are not
        texts.append(" ".join(words(rng, 3 * k) + chain[3 * k :]))
    return [*texts, "a b", "A  B", "a b c", "", None, " \t ", "a b"]


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_brute_force(spark, width):
    texts = corpus(random.Random(width))
    ids = [(k * 7919) % 1009 for k in range(len(texts))]
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, texts, ids), width=width).collect()}
    for i, (n, name) in zip(ids, brute(ids, texts, width), strict=True):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, name, i == name)


def test_no_link_depends_on_the_estimate(spark, monkeypatch):
    """No pair with a hub passes here, so that the exact join alone must find every link."""
    monkeypatch.setattr(neardup, "SLACK", -1.0)
    texts = corpus(random.Random(6))
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    for i, (n, name) in enumerate(brute(list(range(len(texts))), texts, 5)):
        assert (got[i].n_shingles, got[i].component_id) == (n, name)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """Variants of one text around the threshold: many components among which pairs must be looked for."""
    rng = random.Random(21)
    base = words(rng, 50)
    texts = []
    for _ in range(120):
        w = list(base)
        for k in rng.sample(range(50), rng.randint(2, 6)):
            w[k] += rng.choice("xy")
        texts.append(" ".join(w))
    met = []

    def counted(*args, join=neardup.prefix_pairs):
        out = neardup.written(join(*args), "met")
        met.append(out.count())
        return out

    monkeypatch.setattr(neardup, "prefix_pairs", counted)
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, texts), width=4).collect()}
    for i, (n, name) in enumerate(brute(list(range(120)), texts, 4)):
        assert (got[i].n_shingles, got[i].component_id) == (n, name)
    assert len({r.component_id for r in got.values()}) > 5 and met[0] > 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
        k = int(3000 * (1 - share) / 2)
        a, b = pool[: 3000 - k], pool[k:]
        true = (3000 - 2 * k) / 3000
        sa, sb, both = neardup.sketches([a, b, pool])
        assert (np.maximum(sa, sb) == both).all()
        est = neardup.likely_similarity(sa[None], sb[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(est - true) < 0.1
    one, none = neardup.sketches([pool[:1], pool[:0]])
    assert one.min() > 0 and none.max() == 0


@pytest.mark.parametrize("small", [graph.SMALL, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(70, 70), (80, 79)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 5 for k in range(5, 40)} | {79: 79, 80: 79}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first_and_edges(spark):
    base = " ".join(words(random.Random(9), 60))
    docs = clashing(frame(spark, [base, base, base + " end", None, "", base], ids=[4, 2, 9, 5, 6, None]))
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {2, 5, 6, None}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {4: 2, 2: 2, 9: 2, 5: 5, 6: 6, None: 2}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_keep_first_goes_by_row(spark):
    import corpus_pipeline

    rng = random.Random(11)
    base, own, alone, other = (" ".join(words(rng, 60)) for _ in range(4))
    ids = [1, 7, 7, *[3] * 5, None, None, None, None, 8, 8, 2]
    texts = [base, base + " end", own, *[alone] * 5, base, other, other, None, "", "", other + " end"]
    docs = clashing(frame(spark, texts, ids))
    kept = corpus_pipeline.near_dedup(spark, docs.repartition(3), "")
    assert kept.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(1, base), (7, own), (3, alone), (None, None), (8, ""), (8, ""), (2, other + " end")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)


def test_words_that_polynomials_confuse(spark):
    x, y = opposite_words()
    texts = [x, y, f"{x} one two three four", f"{y} one two three four", f"{x} {y}", f"{y} {x}", x]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0}


def test_nodes_that_share_a_number_are_told_apart(spark):
    rows = spark.createDataFrame([(0, 7, 1), (1, 7, 1), (2, 7, 2), (3, 8, 3)], "doc_id long, node long, other long")
    node = {r.doc_id: r.node for r in neardup._told_apart(rows).collect()}
    assert node[0] == node[1] != node[2] and node[3] == 8


def test_very_long_text(spark):
    rng = random.Random(9)
    long = words(rng, 60_000)
    near = [*long]
    near[30_000] = "other"
    got = neardup.near_duplicates(frame(spark, [" ".join(long), " ".join(near), "x" * 400_000])).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2}
