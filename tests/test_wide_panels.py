import datetime as dt

from pyspark.sql import functions as F

from panelloom.operators.portfolio import construct
from panelloom.operators.signals import compute_signal
from panelloom.operators.simulate import simulate
from panelloom.plans.backtest import backtest
from panelloom.queries import QUERIES
from panelloom.sources.panels import dense_panel
from tests.panel_helpers import panel, same, walk, wide_of


def test_dense_panel_has_every_cell_once(spark):
    day = [dt.date(2021, 1, d) for d in range(1, 7)]
    rows = [("a", day[1], 1.0), ("a", day[1], 3.0), ("a", day[4], 5.0), ("b", day[0], None), ("b", day[5], 7.0), ("c", day[2], 9.0), (None, day[3], 8.0)]
    df = spark.createDataFrame(rows, "asset string, ts date, x double")
    for tasks in (None, 3):
        got = sorted(dense_panel(df, F.col("asset"), F.col("ts"), F.col("x"), tasks).collect(), key=lambda r: (r.asset or "", r.pos))
        prices = {("a", 1): 2.0, ("a", 4): 5.0, ("b", 5): 7.0, ("c", 2): 9.0}
        assert [tuple(r) for r in got] == [(a, day[k], k, prices.get((a, k))) for a in (None, "a", "b", "c") for k in range(6)]
    assert dense_panel(df.limit(0), F.col("asset"), F.col("ts"), F.col("x")).count() == 0


def test_a_wide_backtest_moves_the_panel_once(spark):
    plan = QUERIES["bt_supplier"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "hashpartitioning(pos" not in plan
    assert plan.count("hashpartitioning(__block") == 1


def test_blocks_of_dates_equal_the_whole(spark):
    prices = panel(spark, walk(35, 5))
    whole = construct(compute_signal("momentum", prices, lookback=3), 1.0, 0.5)
    result = backtest(prices, lookback=3, max_leverage=0.5)
    assert result.weights.count() == result.weights.select("asset", "pos").distinct().count() == 35 * 5
    same(wide_of(result.weights, "weight"), wide_of(whole, "weight"))
    columns = ["pos", "gross", "turnover", "net"]
    got, want = (d.orderBy("pos").select(*columns).toPandas() for d in (result.daily, simulate(whole)))
    same(got, want)
