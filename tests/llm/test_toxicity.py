import random
import zlib

from panelloom.llm import toxicity
from pyspark.sql import functions as F
from tests.llm.helpers import clashing, frame, words

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grotty", "wretch", "vileness"]


def corpus(rng, n):
    out = []
    for k in range(n):
        w = words(rng, rng.randint(20, 80))
        if k % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD).upper())
        out.append(" ".join(w))
    return out


def test_held_out_accuracy_and_fold(spark):
    texts = corpus(random.Random(1), 800)
    docs = clashing(frame(spark, texts))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(800)], LABELS)
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == 800
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out:
            right.append(r.predicted == int(r.doc_id % 4 == 0))
    assert sum(right) / len(right) > 0.95
    flipped = labels.collect()
    flipped = spark.createDataFrame([(r.doc_id, 1, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic) for r in flipped], LABELS)
    assert {(r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, flipped).collect()} == {(r.doc_id, r.score) for r in rows}


def test_edges(spark):
    docs = frame(spark, [None, "", "x" * 200_000, "same", "same"], ids=[None, 1, 2, 3, 3])
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.toxicity_scores(docs, none).collect()
    assert len(rows) == 5 and all(r.score < 0.5 for r in rows) and rows[3].score == rows[4].score
    one = spark.createDataFrame([(3, 1, 1), (2, 1, 1), (1, 1, 1)], LABELS)
    assert all(r.score > 0.5 for r in toxicity.toxicity_scores(docs, one).collect())
    assert toxicity.toxicity_scores(docs.limit(0), none).count() == 0


def test_a_repeated_id_counts_once_in_the_sample(spark):
    docs = frame(spark, ["some text " * (k % 9 + 1) for k in range(600)], ids=[k % 4 for k in range(600)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(4)], "doc_id long, quality int, toxic int")
    held = spark.range(4).filter(toxicity.held_out(F.col("id"))).count()
    assert toxicity.training_sample(docs, labels, 10).count() == 4 - held
