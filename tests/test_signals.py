import numpy as np
import pytest

from panelloom.operators import arma, signals
from tests.panel_helpers import panel, same, walk, wide_of

SMALL = {"lookback": 12, "skip": 3, "vol_window": 8, "span": 6, "short_window": 3, "long_window": 9}


def pandas_signals(p):
    r = p.pct_change()
    m = r.mean(axis=1)
    var = m.rolling(12, min_periods=6).var()
    resid = r.apply(lambda c: c - c.rolling(12, min_periods=6).cov(m) / var.clip(lower=1e-10) * m)
    calm = r.rolling(8).std().mean(axis=1) < 0.02
    mom = r.rolling(12).sum()
    return {
        "momentum": mom,
        "mean_reversion": -mom,
        "skip_month_momentum": p.shift(3) / p.shift(12) - 1,
        "residual_momentum": resid.rolling(12, min_periods=6).sum() - resid.rolling(3, min_periods=1).sum(),
        "volatility": -(r**2).rolling(12).mean(),
        "vol_scaled_momentum": mom / (r.rolling(8).std() + 1e-8),
        "regime_switch": mom.where(calm, -mom, axis=0),
        "ewma_momentum": r.ewm(span=6, adjust=False).mean(),
        "ma_crossover": p.rolling(3).mean() - p.rolling(9).mean(),
    }


def test_all_closed_forms_match_pandas(spark):
    p = walk(80, 5, 1)
    for name, want in pandas_signals(p).items():
        same(wide_of(signals.compute_signal(name, panel(spark, p), **SMALL), "score"), want.shift(1).set_axis(range(80)), 1e-8)


@pytest.mark.parametrize("name", [n for n in sorted(signals.REGISTRY) if n != "arima"])
def test_no_look_ahead_and_scale_free(spark, name):
    p = walk(60, 3, 2)
    full = wide_of(signals.compute_signal(name, panel(spark, p), **SMALL), "score")
    cut = wide_of(signals.compute_signal(name, panel(spark, p.iloc[:45]), **SMALL), "score")
    same(full.iloc[:45], cut)
    scale = 7.0 if name == "ma_crossover" else 1.0
    same(wide_of(signals.compute_signal(name, panel(spark, p * 7), **SMALL), "score"), full * scale, 1e-7)


def test_arima_forecasts_an_autoregression(spark):
    rng = np.random.default_rng(5)
    r = np.zeros(400)
    for t in range(1, 400):
        r[t] = 0.6 * r[t - 1] + rng.normal(0, 0.01)
    p = walk(400, 1)
    p["A0"] = 100 * np.exp(np.cumsum(r))
    got = wide_of(signals.arima(panel(spark, p), (1, 0, 0)), "score")["A0"].to_numpy()
    assert np.corrcoef(got[20:], p["A0"].pct_change().shift(2).to_numpy()[20:])[0, 1] > 0.95
    assert signals.arima(panel(spark, p.iloc[:5])).count() == 5


def dense_likelihood(x, phi, theta, constant=True):
    """From the covariance matrix itself, at the best mean and variance."""
    n, m = len(x), 4000
    psi = np.zeros(m)
    psi[0] = 1
    for j in range(1, m):
        psi[j] = (theta[j - 1] if j <= len(theta) else 0) + sum(phi[i] * psi[j - 1 - i] for i in range(min(len(phi), j)))
    lags = np.array([(psi[: m - k] * psi[k:]).sum() for k in range(n)])
    inverse = np.linalg.inv(s := lags[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))])
    one = np.ones(n)
    y = x - (one @ inverse @ x / (one @ inverse @ one) if constant else 0)
    return -(n * np.log(2 * np.pi * (y @ inverse @ y) / n) + np.linalg.slogdet(s)[1] + n) / 2


@pytest.mark.parametrize(("p", "q"), [(1, 0), (0, 1), (1, 1), (2, 2), (3, 1), (0, 0)])
def test_likelihood_equals_the_dense_form(p, q):
    rng = np.random.default_rng(10 * p + q)
    for constant in (True, False):
        u, x = rng.normal(0, 0.7, p + q), rng.normal(0.3, 1, 30)
        phi, theta = arma.coefficients(u[:p]), -arma.coefficients(u[p:])
        assert -arma.profile(x, phi, theta, constant)[0] == pytest.approx(dense_likelihood(x, phi, theta, constant), rel=1e-9)
        np.testing.assert_allclose(arma.coordinates(phi), u[:p], atol=1e-9)
        best = arma.fitted(x, p, q, constant)
        assert best["loglik"] == pytest.approx(dense_likelihood(x, best["phi"], best["theta"], constant), rel=1e-7)
        for _ in range(20):  # nothing near is better
            v = np.concatenate([arma.coordinates(best["phi"]), arma.coordinates(-best["theta"])]) + rng.normal(0, 0.05, p + q)
            assert -arma.profile(x, arma.coefficients(v[:p]), -arma.coefficients(v[p:]), constant)[0] <= best["loglik"] + 1e-7


def test_fit_recovers_parameters_and_rejects_flat_series():
    rng = np.random.default_rng(4)
    e, x = rng.normal(size=4000), np.zeros(4000)
    for t in range(1, 4000):
        x[t] = 0.7 * x[t - 1] + e[t] + 0.4 * e[t - 1]
    f = arma.fitted(x + 3, 1, 1)
    assert (f["phi"][0], f["theta"][0], f["mean"], f["variance"]) == tuple(pytest.approx(v, abs=t) for v, t in ((0.7, 0.04), (0.4, 0.05), (3, 0.3), (1, 0.07)))
    np.testing.assert_allclose(f["forecast"][100:] - f["mean"], f["phi"][0] * (x + 3 - f["mean"])[99:-1] + f["theta"][0] * (x + 3 - f["forecast"])[99:-1], atol=1e-8)
    for bad in (np.ones(50), np.arange(3.0), np.array([])):
        with pytest.raises(ValueError):
            arma.fitted(bad, 1, 1)


def test_arima_falls_back_and_differences(spark):
    p = walk(60, 2)
    p["A1"] = 100.0
    flat = wide_of(signals.arima(panel(spark, p), (2, 0, 1)), "score")["A1"].to_numpy()
    assert np.isnan(flat[:3]).all() and (flat[3:] == 0).all()
    got = wide_of(signals.arima(panel(spark, p), (1, 1, 0)), "score")["A0"].to_numpy()
    r = p["A0"].pct_change().dropna().to_numpy()
    np.testing.assert_allclose(got[2:], np.append(0, r[:-1] + arma.fitted(np.diff(r), 1, 0, False)["forecast"])[:-1])


def test_registry(spark):
    @signals.register_signal("flat")
    def flat(df):
        return signals.momentum(df, 1)

    p = panel(spark, walk(10, 2))
    assert signals.compute_signal("flat", p, lookback=99).count() == 20
    del signals.REGISTRY["flat"]
    with pytest.raises(ValueError, match="known"):
        signals.compute_signal("nothing", p)
    with pytest.raises(ValueError):
        signals.momentum(p, 0)
    with pytest.raises(ValueError):
        signals.skip_month_momentum(p, 5, 5)
