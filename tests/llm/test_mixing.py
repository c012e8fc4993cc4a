import pytest

from panelloom.llm import mixing
from tests.llm.helpers import clashing, frame


def fill(sizes, weights, share, cap):
    """Targets by repeated resharing, one capped source at a time."""
    total, open_, out = share * sum(sizes), list(range(len(sizes))), {}
    while open_:
        left = total - sum(out.values())
        per = left / sum(weights[k] for k in open_)
        over = [k for k in open_ if per * weights[k] > cap * sizes[k]]
        if not over:
            out |= {k: per * weights[k] for k in open_}
            break
        for k in over:
            out[k] = cap * sizes[k]
            open_.remove(k)
    return [out[k] for k in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 50, 7], [5, 0, 90, 3, 3, 200]])
def test_targets_are_the_fixed_point(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, size long")
    got = [r.target for r in mixing.source_targets(df).orderBy("source").collect()]
    want = fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], 1.5, 2)
    assert got == pytest.approx(want)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))


def test_null_source_comes_last_and_weights_follow_code_points(spark):
    df = spark.createDataFrame([("é", 10), ("Z", 10), ("a", 10), (None, 10)], "source string, size long")
    got = {r.source: r.weight for r in mixing.source_targets(df).collect()}
    assert got == {"Z": 5, "a": 2, "é": 1, None: 5}


def test_plan_bounds_reruns_and_emitted_rows(spark):
    texts = [" ".join("w" * (k % 7 + 1)) for k in range(600)]
    docs = frame(spark, texts, sources=["abc"[k * k % 3] for k in range(600)])
    plan = mixing.mix_plan(docs).collect()
    assert sorted(plan) == sorted(mixing.mix_plan(docs.repartition(7)).collect())
    assert all(r.taken <= 2 * r["size"] for r in plan)
    for source in {r.source_size for r in plan}:
        own = [r for r in plan if r.source_size == source]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.15)
    emitted = mixing.mix_documents(docs)
    assert emitted.columns == docs.columns
    assert emitted.count() == sum(r.copies for r in plan)


def test_edges(spark):
    docs = frame(spark, [None, "", "  \t", "one two", "one two"], ids=[1, 2, None, 4, 4], sources=["a", None, "b", "b", "b"])
    plan = {(r.doc_id, r["size"]): r for r in mixing.mix_plan(clashing(docs)).collect()}
    assert plan[(1, 0)].taken == 0 and plan[(2, 0)].target == 0 and plan[(4, 2)].source_size == 4
    assert mixing.mix_plan(docs.limit(0)).count() == 0
    assert mixing.mix_documents(clashing(docs)).columns == clashing(docs).columns


def test_equal_rows_draw_apart(spark):
    """Two thousand equal rows are a source: together they come near its target, as other rows do."""
    texts = ["four words are here"] * 2000 + [f"w{k} " * 20 for k in range(900)]
    docs = frame(spark, texts, ids=[5] * 2000 + list(range(10, 910)), sources=["a"] * 2000 + ["b"] * 900)
    plan = mixing.mix_plan(docs.repartition(5)).collect()
    own = [r for r in plan if r.source_size == 8000]
    assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.03) and len({r.copies for r in own}) <= 2
    assert sorted(plan) == sorted(mixing.mix_plan(docs.repartition(2)).collect())
    assert mixing.mix_documents(docs).count() == sum(r.copies for r in plan)
