import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from panelloom.llm import prefixtrie as P
from tests.llm.helpers import clashing

TURNS = "conv_id long, turn long, role string, text string"


def expected(rows):
    """The contract read word by word: every prefix of every rebuilt conversation in a dictionary."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        leaves, saved = (not children[path]), 0
        if path:
            saved = (len(members[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1]))
        for x in children[path]:
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(ids), len(path), parent, len(ids), len(children[path]), *below(path), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def got(df):
    return sorted((tuple(r) for r in P.trie_report(df).collect()), key=lambda r: r[:2])


def conversations(rng, n, most):
    rows = []
    for c in rng.sample(range(-5, 2 * n), n):
        for turn in range(rng.randint(1, most)):
            odd = rng.random()
            role = None if odd < 0.03 else ("user", "assistant")[turn % 2]
            text = None if odd > 0.97 else rng.choice(["hi there", "ok", "", "a b  c\nd", "längere Antwort"])
            rows.append((c, None if odd < 0.02 else turn if odd < 0.9 else 1, role, text))
    return rows


@pytest.mark.parametrize("most", [5, 23])
def test_trie_equals_brute_force(spark, most):
    rng = random.Random(most)
    rows = conversations(rng, 90, most)
    rows += rows[:7]  # repeated rows are further turns
    rows.append((None, 0, "user", "nobody's"))
    rng.shuffle(rows)
    assert got(clashing(spark.createDataFrame(rows, TURNS)).repartition(5)) == expected(rows)


def test_one_hot_conversation_and_equal_ones(spark):
    rows = [(40, k, "user", "word " * (k % 3)) for k in range(200)] + [(c, 0, "user", "same") for c in range(60, 160)]
    assert got(spark.createDataFrame(rows, TURNS)) == expected(rows)


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "x") for c in range(21, 40)]  # base 20 is absent
    assert got(spark.createDataFrame(rows, TURNS)) == expected(rows)
    assert got(spark.createDataFrame([], TURNS)) == []
    one = [(3, 0, "user", "long " * 300_000)]
    assert got(spark.createDataFrame(one, TURNS)) == expected(one)


def test_running_sums_over_parts(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 2000, 1, 7).select(F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(9).alias("key"), F.hash("id").alias("x"), F.col("id").alias("v"))
    rows = P.running_sums(P.sorted_parts(df, "key", F.col("x")), "key", {"s": F.col("v")}).collect()
    seen = defaultdict(list)
    for r in df.collect():
        seen[r.key].append((r.x, r.v))
    want = {(k, x): sum(v for y, v in seen[k] if y <= x) for k in seen for x, _ in seen[k]}
    assert {(r.key, r.x): r.s for r in rows} == want
