import random

from hypothesis import given, settings
from hypothesis import strategies as st

from panelloom.llm import decontam
from tests.llm.helpers import clashing, frame, opposite_words, words

BENCH = "item_id long, text string"


def brute_tiles(a, b, m):
    """Greedy string tiling from its definition: total tokens covered."""
    used_a, used_b, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < m:
            return total
        k, i, j = best[0], -best[1], -best[2]
        used_a |= set(range(i, i + k))
        used_b |= set(range(j, j + k))
        total += k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=18), st.lists(st.sampled_from("abc"), max_size=24))
def test_tiles_are_disjoint_common_and_greedy(a, b):
    fa, fb = decontam.fingerprints(" ".join(a)), decontam.fingerprints(" ".join(b))
    tiles = decontam.tile(fa, fb, 3)
    seen_a, seen_b = set(), set()
    for i, j, n in tiles:
        assert n >= 3 and a[i : i + n] == b[j : j + n]
        assert not seen_a & set(range(i, i + n)) and not seen_b & set(range(j, j + n))
        seen_a |= set(range(i, i + n))
        seen_b |= set(range(j, j + n))
    assert max((n for _, _, n in tiles), default=0) == max((k for k in range(3, 19) if any(a[i : i + k] == b[j : j + k] for i in range(len(a) - k + 1) for j in range(len(b) - k + 1))), default=0)


def test_greedy_total_matches_definition_on_distinct_tokens():
    rng = random.Random(3)
    for _ in range(30):
        a = words(rng, 30)
        b = a[15:] + words(rng, 5) + a[:12] + a[2:9]
        assert sum(n for _, _, n in decontam.tile(decontam.fingerprints(" ".join(a)), decontam.fingerprints(" ".join(b)))) == brute_tiles(a, b, 5)


def corpus(rng):
    items = [" ".join(words(rng, 40)) for _ in range(6)]
    w = items[1].split()
    moved = " ".join(words(rng, 30) + w[20:] + words(rng, 9) + w[:20])
    half = " ".join(w[:20] + words(rng, 200))
    shouted = f"{' '.join(words(rng, 50))} {items[2].upper().replace(' ', ', ')}!"
    plain = [" ".join(words(rng, 120)) for _ in range(10)]
    return items, [moved, half, shouted, items[3], *plain, None, "", "one two"]


def test_reordered_passages_are_leaks_and_both_ways_agree(spark):
    items, texts = corpus(random.Random(4))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "too short"), (92, "")], BENCH)
    docs = frame(spark, texts)
    small = decontam.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in small} == {(0, 1), (2, 2), (3, 3)}
    assert next(r for r in small if r.doc_id == 0).n_tiles == 2
    large = decontam.leaks(docs, bench, broadcast_tokens=0).collect()
    assert sorted(small) == sorted(large)
    kept = decontam.without_leaks(clashing(docs), bench)
    assert kept.columns == clashing(docs).columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {0, 2, 3}


def test_edges(spark):
    items, texts = corpus(random.Random(5))
    bench = spark.createDataFrame(list(enumerate(items)), BENCH)
    docs = frame(spark, [texts[0], texts[0]], ids=[None, 1])
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == {(None, 1), (1, 1)}
    assert decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    long = frame(spark, [" ".join(words(random.Random(1), 60_000)) + " " + items[0]])
    assert [r.item_id for r in decontam.leaks(long, bench).collect()] == [0]


def test_leaks_match_brute_force(spark):
    rng = random.Random(17)
    items = [words(rng, rng.randint(8, 40)) for _ in range(12)] + [words(rng, 3)]
    docs = []
    for k in range(60):
        item = items[k % len(items)]
        cut = rng.randint(0, len(item))
        passage = {0: item, 1: item[cut:] + words(rng, 4) + item[:cut], 2: [*item[: cut // 2], "zz", *item[cut:]], 3: words(rng, 30)}[k % 4]
        docs.append(" ".join(words(rng, rng.randint(0, 30)) + passage + words(rng, rng.randint(0, 30))))
    want = set()
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            total = brute_tiles(item, text.split(), decontam.MIN_TILE)
            if total >= decontam.COVERAGE * len(item) and total:
                want.add((d, i, len(item), total))
    bench = spark.createDataFrame([(i, ". ".join(t).title()) for i, t in enumerate(items)], BENCH)
    for bound in (decontam.BROADCAST_TOKENS, 0):
        got = {(r.doc_id, r.item_id, r.n_tokens, r.n_covered) for r in decontam.leaks(frame(spark, docs), bench, broadcast_tokens=bound).collect()}
        assert got == want and len(want) > 15


def test_words_that_polynomials_confuse(spark):
    x, y = opposite_words()
    item, other = (f"{w} one two three four five" for w in (x, y))
    bench = spark.createDataFrame([(1, " ".join([x, "p", x, "q", x, "r"]))], BENCH)
    docs = frame(spark, [" ".join([y, "p", y, "q", y, "r"]), " ".join([x, "p", x, "q", x, "r"])])
    assert [r.doc_id for r in decontam.leaks(docs, bench).collect()] == [1]
    assert decontam.tile(decontam.fingerprints(item), decontam.fingerprints(other), 3) == [(1, 1, 5)]


def test_one_repeated_word_is_tiled_in_bounded_memory():
    import tracemalloc

    item, doc = decontam.fingerprints("w " * 2000), decontam.fingerprints("w " * 40_000)
    tracemalloc.start()
    assert decontam.tile(item, doc, 5) == [(0, 0, 2000)]
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
