"""The registered queries of the corpus operators, and the pipeline, over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")


def test_one_query_per_operator():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        assert k == 4 or docs.columns == columns
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))


def test_stages_chain_over_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, and extra columns with the operators' own names; then no rows."""
    import random

    import corpus_pipeline
    from tests.llm.helpers import clashing, frame, words

    rng = random.Random(2)
    item = " ".join(words(rng, 40))
    prose = [" ".join(words(rng, rng.randint(30, 80))) for _ in range(40)]
    texts = [*prose, None, "", "  \n", "short", prose[3], prose[3], " ".join(words(rng, 20_000)), item + " " + prose[5]]
    ids = [*range(40), 40, 41, None, 43, 3, 900, 901, 902]
    docs = clashing(frame(spark, texts, ids, [None if k % 5 == 0 else "ab"[k % 2] for k in range(len(texts))]))
    spark.createDataFrame([(1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = []
    for rows in (docs, docs.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, str(tmp_path))
            assert k == 4 or out.columns == docs.columns
            found = out.collect()
            kept.append((name, {r.doc_id for r in found}))
            rows = spark.createDataFrame(found, out.schema)
    near, clean = dict(kept[:5])["near-dedup"], dict(kept[:5])["decontamination"]
    assert 900 not in near and 901 in near and near - clean == {902} and not any(ids for _, ids in kept[5:])
