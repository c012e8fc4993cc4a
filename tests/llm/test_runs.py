import hashlib
import random
import re
import zlib
from fractions import Fraction

from panelloom.llm import runs as R
from tests.llm.helpers import clashing, frame


def brute_runs(s, least=6, times=4):
    """Every period by itself, smallest first; a stretch found before has a smaller period."""
    out, seen = [], set()
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p) and (i, j + p - i) not in seen:
                seen.add((i, j + p - i))
                out.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    drop = {k for s, m, p in found for k in range(s + p, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    tail = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *tail, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def noisy(rng, size):
    """Words with stretches written again and again, some of them within others."""
    s = [rng.choice(["a", "b", "cc", "é", "word\x00", "x" * 70, "y" * 71]) for _ in range(rng.randint(0, size))]
    for _ in range(rng.randint(0, 4)):
        if s:
            a = rng.randrange(len(s))
            e = min(len(s), a + rng.randint(1, 6))
            s = s[:a] + s[a:e] * rng.randint(2, 8) + s[e:]
    return s[:300]


def test_edges_equal_their_definition():
    rng = random.Random(3)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
        after, agree = R.lyndon_edges(s)
        for i, j in enumerate(after):
            assert j == next((k for k in range(i + 1, len(s)) if s[k:] < s[i:]), len(s))
            y = 0
            while j + y < len(s) and s[i + y] == s[j + y]:
                y += 1
            assert agree[i] == y


def test_runs_equal_brute_force():
    rng = random.Random(4)
    texts = [noisy(rng, 120) for _ in range(600)]
    found = R.runs_of_texts([" ".join(t).encode() for t in texts])
    assert found == [brute_runs(t) for t in texts]
    assert sum(map(len, found)) > 300


def test_query_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [rng.choice([" ", "\n", "\t "]).join(noisy(rng, 60)) for _ in range(300)]
    texts += [None, "", " \n ", "one", "same same same same same same", "           "]
    got = R.runs_report(R.with_periodic_tails(frame(spark, texts)))
    assert sorted(map(tuple, got.collect())) == sorted(expected(k, t) for k, t in enumerate(texts))


def test_repeated_rows_nulls_and_clashing_columns(spark):
    docs = frame(spark, ["a b " * 8, "a b " * 8, None], ids=[1, 1, None])
    out = clashing(docs).withColumns({"runs": docs.doc_id, "collapsed": docs.lang})
    rows = R.periodic_runs(out).collect()
    assert [[tuple(r) for r in x["runs"]] for x in rows if x["doc_id"] == 1] == [[(0, 16, 2)]] * 2
    assert {x["collapsed"] for x in rows} == {"a b", ""} and rows[0]["runs_in"] in (1, None) and rows[0]["collapsed_in"] == "en"
    assert R.runs_report(R.with_periodic_tails(docs.limit(0))).count() == 0
    assert R.runs_report(R.with_periodic_tails(docs)).count() == 3


def test_very_long_texts():
    long = [b"k%d" % k for k in range(70_000)] * 5
    texts = [b" ".join(long), b"z" * 3_000_000 + b" q" * 7, b"u v w " * 400_000]
    assert R.runs_of_texts(texts) == [[(0, 350_000, 70_000)], [(1, 7, 1)], [(0, 1_200_000, 3)]]
    assert R.without_repeats(texts[2], [(0, 1_200_000, 3)]) == b"u v w"
