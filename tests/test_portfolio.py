import numpy as np
import pandas as pd
import pytest

from panelloom.operators import portfolio, risk, simulate
from panelloom.operators.signals import momentum
from panelloom.plans.backtest import backtest
from panelloom.sources.panels import with_returns
from pyspark.sql import functions as F
from tests.panel_helpers import panel, same, walk, wide_of


@pytest.fixture(scope="module")
def prices():
    return walk(90, 5, 4)


def ranks(scores: pd.DataFrame) -> pd.DataFrame:
    r = scores.rank(axis=1)
    c = r.sub(r.mean(axis=1), axis=0)
    return c.div(c.abs().sum(axis=1).replace(0, np.nan), axis=0).fillna(0)


def test_ranks_leverage_and_rebalancing(spark, prices):
    scored = momentum(panel(spark, prices), 10)
    want = ranks(prices.pct_change().rolling(10).sum().shift(1))
    same(wide_of(portfolio.rank_weights(scored), "weight"), want)
    same(wide_of(portfolio.construct(scored, max_leverage=0.4), "weight"), want * 0.4)
    monday = want.where(pd.Series(want.index.weekday == 0, want.index), np.nan, axis=0).ffill().fillna(0)
    same(wide_of(portfolio.construct(scored, frequency="weekly"), "weight"), monday)
    first = want.where(pd.Series(want.index.day == 1, want.index), np.nan, axis=0).ffill().fillna(0)
    same(wide_of(portfolio.construct(scored, frequency="monthly"), "weight"), first)
    with pytest.raises(ValueError):
        portfolio.enforce_leverage(scored.withColumn("weight", F.lit(1.0)), 0)


def test_ties_single_assets_and_cancelling_scores(spark):
    flat = walk(30, 3) * 0 + 10
    scored = momentum(panel(spark, flat), 5)
    assert wide_of(portfolio.rank_weights(scored), "weight").abs().to_numpy().max() == 0
    one = momentum(panel(spark, walk(30, 1)), 5)
    assert wide_of(portfolio.zscores(one), "score").abs().to_numpy().max() == 0
    tiny = scored.withColumn("score", F.lit(1e-17))
    assert wide_of(portfolio.l1_weights(tiny), "weight").abs().to_numpy().max() == 0


def test_simulation_stop_and_passive(spark, prices):
    result = backtest(panel(spark, prices), lookback=10)
    w = ranks(prices.pct_change().rolling(10).sum().shift(1))
    gross = (w.shift(1) * prices.pct_change().fillna(0)).sum(axis=1)
    net = gross - w.diff().abs().sum(axis=1) * 0.001
    daily = result.daily.orderBy("pos").toPandas()
    np.testing.assert_allclose(daily["net"], net, atol=1e-12)
    np.testing.assert_allclose(daily["equity"], (1 + net).cumprod(), atol=1e-12)
    m = result.metrics_dict()
    assert m["days"] == 90 and m["sharpe"] == pytest.approx(np.sqrt(252) * net.mean() / net.std()) and m["signal"] == "momentum"
    limit = float(abs(daily["drawdown"].min()) / 2)
    stopped = backtest(panel(spark, prices), lookback=10, max_drawdown=limit).daily.orderBy("pos").toPandas()
    at = int(np.argmax(daily["drawdown"] < -limit))
    assert not stopped["stopped"][:at].any() and stopped["stopped"][at:].all() and (stopped["net"][at:] == 0).all()
    assert (stopped["turnover"][at:] > 0).any()
    p, r = panel(spark, prices), prices.pct_change()
    wealth = (1 + r.fillna(0)).cumprod()
    share = wealth.div(wealth.sum(axis=1), axis=0)
    np.testing.assert_allclose(simulate.buy_and_hold_returns(p).orderBy("pos").toPandas()["net"], (share.shift(1) * r).sum(axis=1), atol=1e-12)
    inv = 1 / (r.rolling(20).std() + 1e-8)
    inv = inv.div(inv.sum(axis=1), axis=0).fillna(0)
    np.testing.assert_allclose(simulate.inverse_vol_returns(p).orderBy("pos").toPandas()["net"], (inv.shift(1) * r).sum(axis=1), atol=1e-12)
    with pytest.raises(ValueError):
        simulate.simulate(p, impact="cubic")


def test_risk_model_matches_pandas(spark, prices):
    z = portfolio.zscores(momentum(panel(spark, prices), 10))
    s = prices.pct_change().rolling(10).sum().shift(1)
    s = s.sub(s.mean(axis=1), axis=0).div(s.std(axis=1).replace(0, np.nan), axis=0).fillna(0)
    r = prices.pct_change()
    w = s.clip(-2, 2).ewm(halflife=5, min_periods=1).mean()
    vol = (r.rolling(20, min_periods=10).std() * np.sqrt(252)).clip(lower=0.01)
    w = (w / vol).fillna(0)
    w = w.div(w.abs().sum(axis=1).replace(0, np.nan), axis=0).fillna(0)
    port = (w.shift(1) * r).sum(axis=1)
    scale = (0.15 / (port.rolling(63, min_periods=31).std() * np.sqrt(252)).clip(lower=0.01)).clip(upper=2)
    same(wide_of(risk.apply_risk(z, risk.RiskConfig()), "weight"), w.mul(scale, axis=0), 1e-7)
    none = risk.RiskConfig(clip_zscore=0, smooth_halflife=0, inverse_vol=False, vol_target=0)
    same(wide_of(risk.apply_risk(z, none), "weight"), wide_of(portfolio.l1_weights(z), "weight"))
    assert set(none.to_dict()) >= {"clip_zscore", "max_leverage"} and len(none.to_dict()) == 8
    _ = with_returns
