import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelloom.llm import packing as P
from tests.llm.helpers import clashing, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        k = min((g, k) for k, g in enumerate(gaps) if g >= s)[1] if any(g >= s for g in gaps) else None
        if k is None:
            gaps.append(capacity - s)
        else:
            gaps[k] -= s
    return len(gaps)


def test_ids_equal_the_tokenizers():
    rng = random.Random(1)
    parts = ["it's", "we'll", "12345", "naïve", "東京都", "<|endoftext|>", " ", "  ", "\n", "\t", "\x1c", " ", "　", "\x85", "!!!", "a", "'s", "x" * 90, "🙂", "\r\n", "_", "-"]
    from tokenizers import Tokenizer

    tok, mine = Tokenizer.from_file(PATH), P.Encoder(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("a" * 300_000, " " * 300_000 + "b", "ab " * 400_000, "\n\t" * 100_000):
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_sweep_takes_the_smallest_free_gap():
    rng = random.Random(2)
    for _ in range(500):
        rows = sorted(((rng.randint(1, 9), rng.random() < 0.5) for _ in range(rng.randint(1, 30))), key=lambda r: (-r[0], -r[1]))
        gaps, pieces, alone, free = P.sweep(np.array([g for _, g in rows]))
        stack, want, lone = [], {}, []
        for k, (_, is_gap) in enumerate(rows):
            if is_gap:
                stack.append(k)
            elif stack:
                want[k] = stack.pop()
            else:
                lone.append(k)
        assert dict(zip(pieces.tolist(), gaps.tolist(), strict=True)) == want
        assert alone.tolist() == lone and free.tolist() == stack


def test_bounds_and_openings():
    assert P.bounds(5, 8) == [0, 5] and P.bounds(8, 8) == [0, 8] and P.bounds(16, 8) == [0, 8, 16] and P.bounds(19, 8) == [0, 3, 11, 19]
    assert P.openings({5: 3, 2: 90}, {4: 100}, 10) == 2 and P.openings({5: 2, 1: 10}, {5: 2, 3: 9}, 10) == 0 and P.openings({9: 4, 6: 2}, {8: 1}, 10) == 5 and P.openings({2: 11, 1: 1}, {1: 2}, 10) == 3


@pytest.mark.parametrize("kind", ["even", "small", "large", "equal", "halves"])
def test_bins_hold_and_are_few(spark, kind):
    rng = random.Random(kind)
    draw = {
        "even": lambda: rng.randint(1, 99), "small": lambda: rng.choice([1, 2, 3, 7]), "large": lambda: rng.randint(40, 99),
        "equal": lambda: 30, "halves": lambda: rng.choice([50, 51, 49, 33, 34]),
    }[kind]
    sizes = {k: draw() for k in range(700)}
    df = spark.createDataFrame(list(sizes.items()), "item long, size long").repartition(7)
    rows = P.best_fit(df, 100).collect()
    assert sorted(r.item for r in rows) == sorted(sizes)
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin].append((r.offset, sizes[r.item]))
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= 100
    assert len(bins) <= best_fit_decreasing(sizes.values(), 100) * 1.02 + 1


def test_query_equals_its_contract(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "γ", "x1", "\n"]) for _ in range(rng.choice([3, 50, 400, 5000]))) for _ in range(60)]
    texts += [None, "", "same text", "same text", "word " * 40_000, "z" * 20_000]
    docs = frame(spark, texts, ids=[*range(len(texts) - 3), 61, 61, None])
    rows = P.pack_documents(clashing(docs).repartition(3), PATH).collect()
    assert P.pack_documents(docs.limit(0), PATH).count() == 0
    want = []
    for doc_id, text in ((r.doc_id, r.text) for r in docs.collect()):
        ids = [*plain(text or ""), 0]
        at = P.bounds(len(ids), 2048)
        want += [(doc_id, p, a, z - a, zlib.crc32(struct.pack(f"<{z - a}I", *ids[a:z]))) for p, (a, z) in enumerate(zip(at, at[1:], strict=False))]
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(seqs) <= best_fit_decreasing([r.length for r in rows], 2048) + 1
