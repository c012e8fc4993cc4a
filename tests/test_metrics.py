import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from panelloom.operators import metrics, simulate
from pyspark.sql import functions as F


def series(spark, values):
    rows = [(k, f"2021-{1 + k // 28 % 12:02d}-{1 + k % 28:02d}", None if v is None else float(v), 0.5) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "pos long, ts string, net double, turnover double").withColumn("ts", F.to_date("ts"))


@pytest.fixture(scope="module")
def returns():
    return np.random.default_rng(8).normal(0.001, 0.02, 300)


def test_four_summaries(spark, returns):
    df, n = series(spark, returns), len(returns)
    eq = np.cumprod(1 + returns)
    dd = (eq / np.maximum.accumulate(eq) - 1).min()
    a, b, c, d = (f(df).first() for f in (metrics.backtest_summary, metrics.blend_summary, metrics.walk_forward_summary, metrics.fold_summary))
    assert a.cagr == pytest.approx(eq[-1] ** (252 / n) - 1) and b.cagr == pytest.approx((eq[-1] / eq[0]) ** (252 / n) - 1)
    assert a.max_dd == pytest.approx(dd) == b.max_dd and c.oos_calmar == pytest.approx(c.oos_cagr / abs(dd))
    assert a.hit_rate == pytest.approx((returns > 0).mean()) and b.win_loss_ratio == pytest.approx(returns[returns > 0].mean() / -returns[returns < 0].mean())
    assert d.avg_loss == pytest.approx(returns[returns < 0].mean()) and d.turnover == 0.5


def test_guards(spark):
    flat = series(spark, [0.0] * 10)
    a, b = metrics.backtest_summary(flat).first(), metrics.blend_summary(flat).first()
    assert (a.sharpe, a.calmar, a.hit_rate, a.win_loss_ratio) == (0, 0, 0, 0) and b.calmar is None
    ruin = series(spark, [0.1, -1.5, 0.1])
    assert metrics.backtest_summary(ruin).first().cagr == -1 and metrics.walk_forward_summary(ruin).first().oos_cagr is None
    assert metrics.fold_summary(series(spark, [None, 0.1, -0.1])).first().n_days == 2


def test_newey_west(spark, returns):
    n, lags = len(returns), int(0.75 * len(returns) ** (1 / 3))
    e = returns - returns.mean()
    var = sum((1 if k == 0 else 2 * (1 - k / (lags + 1))) * (e[k:] * e[: n - k]).sum() / n for k in range(lags + 1))
    row = metrics.newey_west(series(spark, returns)).first()
    assert row.lags == lags and row.t == pytest.approx(returns.mean() / math.sqrt(var / n))


def test_newey_west_gaps_and_edges(spark, returns):
    with_gaps = [v for r in returns for v in (r, None)]
    whole, gaps = (metrics.newey_west(series(spark, x), 3).first() for x in (list(returns), with_gaps))
    assert gaps.n == whole.n and gaps.t == pytest.approx(whole.t)
    assert metrics.newey_west(series(spark, [1.0, 1.0, 1.0]), 1).first().t == math.inf
    assert metrics.newey_west(series(spark, [0.5, None])).first().t is None


def test_bootstrap(spark, returns):
    r, block = returns[:101], 10
    starts = [[int(hashlib.md5(f"1:{d}:{i}".encode()).hexdigest()[:13], 16) % 101 for i in range(11)] for d in range(60)]
    means, ratios = [], []
    for row in starts:
        at = np.concatenate([(s + np.arange(block)) % 101 for s in row])[:101]
        means.append(r[at].mean())
        ratios.append(r[at].mean() / r[at].std(ddof=1) * math.sqrt(252))
    got = metrics.block_bootstrap(series(spark, r), F.avg("net"), draws=60, seed=1).first()
    assert (got.low, got.high) == (pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))
    again = metrics.block_bootstrap(series(spark, r), draws=60, seed=1, function=np.mean).first()
    assert again.low == pytest.approx(got.low)
    with_gaps = [v for x in r for v in (x, None)]
    for block in (None, 101, 500):
        sharpe = metrics.block_bootstrap(series(spark, with_gaps), draws=60, seed=1, block=block).first()
        each = metrics.block_bootstrap(series(spark, with_gaps), F.avg("net") / F.stddev_samp("net") * math.sqrt(252), draws=60, seed=1, block=block).first()
        assert (sharpe.low, sharpe.high) == (pytest.approx(each.low), pytest.approx(each.high))
        assert block or sharpe.low == pytest.approx(np.percentile(ratios, 2.5))
    assert metrics.block_bootstrap(series(spark, [0.01] * 30), draws=5).first().high == 0
    with pytest.raises(ValueError):
        metrics.block_bootstrap(series(spark, [None]))


def test_deflated_sharpe(spark, returns):
    s = pd.Series(returns)
    sr, g, k, n = s.mean() / s.std(), s.skew(), s.kurt(), len(s)
    row = metrics.sharpe_moments(series(spark, returns)).first()
    assert (row.sharpe, row.skew, row.excess) == (pytest.approx(sr), pytest.approx(g), pytest.approx(k))
    se = math.sqrt((1 - g * sr + k / 4 * sr**2) / (n - 1))
    got = metrics.deflated_sharpe(series(spark, returns), 10)
    assert got["z"] == pytest.approx(sr / se - metrics.expected_best(10))
    assert metrics.deflated_sharpe(series(spark, returns), 1)["z"] == pytest.approx(sr / se)
    assert metrics.deflated_sharpe(series(spark, [0.1, 0.2]), 5)["dsr"] == 0
    assert metrics.deflated_sharpe(series(spark, returns), 10, "paper")["dsr"] != got["dsr"]
    with pytest.raises(ValueError):
        metrics.deflated_sharpe(series(spark, returns), 0)


def test_deflated_sharpe_of_many(spark, returns):
    many = series(spark, returns).withColumn("trials", F.explode(F.array(*[F.lit(k) for k in (1, 2, 10, 500)])))
    rows = metrics.deflated_sharpe_table(many, F.col("trials"), "trials").collect()
    for r in rows:
        assert r.best == pytest.approx(metrics.expected_best(r.trials), abs=1e-12)
        assert (r.z, r.dsr) == tuple(pytest.approx(metrics.deflated_sharpe(series(spark, returns), r.trials)[k]) for k in ("z", "dsr"))
    assert len(rows) == 4


def test_normal_functions(spark):
    n = NormalDist()
    x = [-40.0, -8.3, -7.0, -3.2, -1e-9, 0.0, 0.5, 2.0, 7.2, 9.0]
    p = [1e-300, 1e-12, 0.001, 0.02425, 0.3, 0.5, 0.77, 0.99, 1 - 1e-9]
    rows = spark.createDataFrame([(v,) for v in x], "v double").select("v", metrics.normal_cdf(F.col("v")).alias("y")).collect()
    assert all(r.y == pytest.approx(n.cdf(r.v), rel=1e-9, abs=1e-15) for r in rows if r.v > -10)
    rows = spark.createDataFrame([(v,) for v in [*p, 0.0, 1.0]], "v double").select("v", metrics.normal_quantile(F.col("v")).alias("y")).collect()
    assert all(r.y is None if r.v in (0, 1) else r.y == pytest.approx(n.inv_cdf(r.v), rel=1e-9, abs=1e-12) for r in rows)


def test_passive_summary_rounds_half_to_even(spark, returns):
    r = pd.Series(returns)
    equity = (1 + r).cumprod()
    cagr, dd = equity.iloc[-1] ** (252 / len(r)) - 1, (equity / equity.cummax() - 1).min()
    got = metrics.passive_summary(series(spark, [None, *returns])).first()
    assert (got.cagr, got.ann_vol, got.sharpe) == (round(cagr, 6), round(r.std() * 252**0.5, 6), round(252**0.5 * r.mean() / r.std(), 4))
    assert (got.max_dd, got.calmar, got.n_days) == (round(dd, 6), round(cagr / abs(dd), 4), 300)
    one = metrics.passive_summary(series(spark, [0.5, None])).first()
    assert one.cagr is None and one.sharpe is None and one.n_days == 1


def test_plot_tables(spark, returns):
    df = series(spark, returns[:84])
    table = simulate.monthly_table(df).first()
    assert table.m01 == pytest.approx(np.prod(1 + returns[:28]) - 1) and table.m07 is None
    got = simulate.rolling_sharpe(df, 10).orderBy("pos").toPandas()["sharpe"]
    s = pd.Series(returns[:84])
    np.testing.assert_allclose(got, s.rolling(10).mean() / s.rolling(10).std() * np.sqrt(252))
