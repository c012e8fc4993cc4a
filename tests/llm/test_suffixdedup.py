import hashlib
import random

import numpy as np
import pytest

from panelloom.llm import suffixdedup
from tests.llm.helpers import clashing, frame, words


def brute(texts, length, earlier_only):
    seen, starts = {}, []
    raw = [(t or "").encode() for t in texts]
    for k, d in enumerate(raw):
        for i in range(len(d) - length + 1):
            seen.setdefault(d[i : i + length], []).append((k, i))
    for k, d in enumerate(raw):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            places = seen[d[i : i + length]]
            if (len(places) > 1) if not earlier_only else places[0] != (k, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        starts.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return starts


def corpus(rng):
    passage = " ".join(words(rng, 40))
    texts = [f"{' '.join(words(rng, 30))} {passage} {' '.join(words(rng, 25))}" for _ in range(6)]
    base = " ".join(words(rng, 120))
    texts += [base, base, base[:300] + "X" + base[300:], base[17:], "é" * 150 + passage[20:]]
    texts += [passage + " " + passage, "a" * 900, "ab" * 300, None, "", "short", " ".join(words(rng, 3000))]
    return texts


@pytest.mark.parametrize("most", [4096, 1])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_matches_brute_force(spark, keep, most):
    texts = corpus(random.Random(2))
    # one partition keeps ids in the order of the brute force
    docs = clashing(frame(spark, texts))
    got = {r.doc_id: tuple(r)[1:] for r in suffixdedup.remove_repeats(docs, length=100, keep=keep, with_bytes=False, most_contexts=most).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 100, keep == "first")


def test_kept_bytes_and_edges(spark):
    text = " ".join(words(random.Random(3), 200))
    rows = {r.doc_id: r for r in suffixdedup.remove_repeats(frame(spark, [text, text, "tail"], ids=[1, None, 3])).collect()}
    assert bytes(rows[None].kept) == text.encode() and rows[1].n_removed == len(text) and bytes(rows[3].kept) == b"tail"
    assert suffixdedup.remove_repeats(frame(spark, [text]).limit(0)).count() == 0


def test_contexts_of_a_crowded_anchor_stay_in_their_tasks(spark, monkeypatch, tmp_path):
    rng = random.Random(5)
    passage = " ".join(words(rng, 40))
    texts = [f"{' '.join(words(rng, 20))} {passage} {' '.join(words(rng, 20))}" for _ in range(200)]
    for _ in range(300):  # many anchors in two contexts, so that counts of contexts are not small themselves
        shared = " ".join(words(rng, 50))
        texts += [f"{' '.join(words(rng, 10))} {shared} {' '.join(words(rng, 10))}" for _ in range(2)]
    plain, at = suffixdedup._windows, str(tmp_path)

    def noted(length):
        run = plain(length)

        def noting(batches):
            from pathlib import Path

            from pyspark import TaskContext

            for batch in batches:
                for anchor in batch["ahash"].unique():
                    Path(at, f"{anchor} {TaskContext.get().partitionId()}").touch()
                yield from run(iter([batch]))

        return noting

    monkeypatch.setattr(suffixdedup, "_windows", noted)
    # As on large tables: only what is known to be small is broadcast (1 kB here, where the counts of contexts have over 3).
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.autoBroadcastJoinThreshold": "3k"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = suffixdedup.remove_repeats(frame(spark, texts).repartition(4), length=200, keep="none", with_bytes=False, most_contexts=100).collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert [got[k] for k in range(len(texts))] == brute(texts, 200, False)
    anchors = [p.name.split()[0] for p in tmp_path.iterdir()]
    assert len(anchors) > len(set(anchors)) > 0


@pytest.mark.parametrize("length", [32, 100, 300])
def test_suffix_ranks_follow_the_order_of_strings(length):
    rng = random.Random(7)
    piece = bytes(rng.choice(b"ab\xff\x00") for _ in range(350))
    data = piece + bytes(rng.choice(b"ab") for _ in range(200)) + piece
    starts = np.array(sorted(rng.sample(range(len(data) - length + 1), 200)))
    strings = [data[i : i + length] for i in starts]
    order = {t: k for k, t in enumerate(sorted(set(strings)))}
    assert suffixdedup.suffix_ranks(np.frombuffer(data, np.uint8), starts, length).tolist() == [order[t] for t in strings]
    key = np.array([5, 1 << 60, 5, 0], np.uint64)
    assert suffixdedup.dense_ranks(key, (1 << 60) + 1).tolist() == suffixdedup.dense_ranks(key, 1 << 64).tolist() == [1, 2, 1, 0]
