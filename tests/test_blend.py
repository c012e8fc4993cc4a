import numpy as np
import pytest

from panelloom.operators.risk import RiskConfig
from panelloom.plans import blend
from tests.panel_helpers import panel, walk

NAMES = ["momentum", "ewma_momentum"]


def zed(s):
    return s.sub(s.mean(axis=1), axis=0).div(s.std(axis=1).replace(0, np.nan), axis=0).fillna(0)


def backtested(p, scores, risk):
    r = p.pct_change()
    w = scores
    if risk:
        w = w.clip(-2, 2).ewm(halflife=5, min_periods=1).mean()
        w = (w / (r.rolling(20, min_periods=10).std() * np.sqrt(252)).clip(lower=0.01)).fillna(0)
    g = w.abs().sum(axis=1)
    w = w.div(g.where(g > 1e-12), axis=0).fillna(0)
    if risk:
        port = (w.shift(1) * r).sum(axis=1)
        w = w.mul((0.15 / (port.rolling(63, min_periods=31).std() * np.sqrt(252)).clip(lower=0.01)).clip(upper=2), axis=0)
    return (w.shift(1) * r).sum(axis=1) - w.diff().abs().sum(axis=1) * 0.001


@pytest.fixture(scope="module")
def prices():
    return walk(260, 4, 12)


def scores_of(p):
    r = p.pct_change()
    return zed(r.rolling(20).sum().shift(1)), zed(r.ewm(span=20, adjust=False).mean().shift(1))


@pytest.mark.parametrize("risk", [None, RiskConfig()])
def test_walk_forward_matches_the_loop(spark, prices, risk):
    train, test = 120, 60
    a, b = scores_of(prices)
    grid = blend.weight_grid(2, 0.5)
    want, chosen = {}, []
    for start in range(0, len(prices) - train - test + 1, test):
        best = (-np.inf, None)
        for c in grid:
            s = slice(start, start + train)
            r = backtested(prices.iloc[s], (a * c[0] + b * c[1]).iloc[s], risk)
            sharpe = r.mean() / r.std() * np.sqrt(252)
            if sharpe > best[0] + 1e-12:
                best = (sharpe, c)
        chosen.append(best[1])
        s = slice(start + train - 1, start + train + test)
        r = backtested(prices.iloc[s], (a * best[1][0] + b * best[1][1]).iloc[s], risk)
        for k, v in enumerate(r):
            want.setdefault(start + train - 1 + k, v)
    result = blend.walk_forward(panel(spark, prices), NAMES, train, test, test, 0.5, risk=risk)
    got = {r.pos: r.net for r in result.daily.collect()}
    assert set(got) == set(want)
    np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(want)], atol=1e-9)
    windows = result.windows.orderBy("win").collect()
    assert [tuple(w.best_weights[n] for n in NAMES) for w in windows] == chosen and all(w.oos_days == test + 1 for w in windows)
    assert result.metrics.first().oos_days == len(want)
    if risk:  # the risk model starts anew: no position while the volatility is unknown
        assert all(got[train - 1 + k] == 0 for k in range(31))


def test_blend_and_cancellation(spark, prices):
    a, b = scores_of(prices)
    got = blend.blend_equal_weight(panel(spark, prices), NAMES, rebalance="weekly").daily.orderBy("pos").toPandas()["net"]
    np.testing.assert_allclose(got, backtested(prices, (a + b) / 2, None), atol=1e-10)
    nothing = blend.blend_equal_weight(panel(spark, prices), ["momentum", "mean_reversion"])
    assert nothing.daily.filter("net != 0").count() == 0 and nothing.metrics.first().calmar is None


def test_grid_and_errors(spark, prices):
    assert [len(blend.weight_grid(n, 0.2)) for n in (2, 3, 4)] == [6, 21, 56] and [len(blend.weight_grid(n, 0.25)) for n in (2, 3, 4)] == [5, 15, 35]
    assert blend.weight_grid(2, 0.3) == []
    with pytest.raises(ValueError):
        blend.walk_forward(panel(spark, prices), NAMES, 250, 60)
    equal = blend.walk_forward(panel(spark, prices), NAMES, 150, 60, 60, 0.3).windows.first()
    assert equal.best_weights == {"momentum": 0.5, "ewma_momentum": 0.5} and equal.train_sharpe is None


def test_weighted_backtest_and_joined_signals(spark, prices):
    from panelloom.operators.signals import REGISTRY, momentum, register_signal

    a, b = scores_of(prices)
    got = blend.weighted_backtest(panel(spark, prices), {"momentum": 0.3, "volatility": 0.0, "ewma_momentum": 0.7}, risk=RiskConfig())
    net = [r.net for r in got.daily.orderBy("pos").collect()]
    assert np.allclose(net, backtested(prices, 0.3 * a + 0.7 * b, RiskConfig()).to_numpy()) and got.mode == "weighted"
    with pytest.raises(ValueError):
        blend.weighted_backtest(panel(spark, prices), {"momentum": 0.0})
    register_signal("narrow", lambda p: momentum(p).select("asset", "pos", "score"))
    try:
        both = blend.compute_signals(panel(spark, prices), ["momentum", "narrow"])
        assert both.filter("z_momentum <> z_narrow").count() == 0 and both.count() == prices.size
    finally:
        del REGISTRY["narrow"]
