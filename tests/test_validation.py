"""Cross-validation, labels, features, differencing, models."""

import itertools

import numpy as np
import pandas as pd
import pytest

from panelloom.operators import crossval, fracdiff, labels, model
from panelloom.plans import search
from pyspark.sql import functions as F
from tests.panel_helpers import panel, same, walk, wide_of


def members(splits, k, role):
    return {r.eid for r in splits if r.split == k and r.role == role}


@pytest.fixture(scope="module")
def events(spark):
    return crossval.event_table(panel(spark, walk(63, 1)), 4)


def purge(n, h, test, e):
    span = n - 1 + h
    low, high = min(test) - e * span, max(test) + h + e * span
    return {i for i in range(n) if i not in test and (i > high or i + h < low)}


@pytest.mark.parametrize("embargo", [0.0, 0.05])
def test_purged_folds(events, embargo):
    n, h, k = 59, 4, 5
    got = crossval.PurgedKFold(k, embargo).split(events).collect()
    sizes = [n // k + (i < n % k) for i in range(k)]
    cover = []
    for i, (a, size) in enumerate(zip(np.cumsum([0, *sizes]), sizes, strict=False)):
        test = set(range(a, a + size))
        assert members(got, i, "test") == test and members(got, i, "train") == purge(n, h, test, embargo)
        cover += test
    assert sorted(cover) == list(range(n))


def test_combinatorial_folds(events):
    got = crossval.combinatorial_splits(events, 4, 2).collect()
    folds = np.array_split(range(59), 4)
    for i, c in enumerate(itertools.combinations(range(4), 2)):
        test = set(np.concatenate([folds[f] for f in c]).tolist())
        assert members(got, i, "test") == test and members(got, i, "train") == purge(59, 4, test, 0)
    with pytest.raises(ValueError):
        crossval.combinatorial_splits(events, 4, 4)


def test_validation_errors(spark, events):
    for bad in ({"n_splits": 1}, {"embargo_pct": 1.0}):
        with pytest.raises(ValueError):
            crossval.PurgedKFold(**bad)
    with pytest.raises(KeyError):
        crossval.check_events(events.drop("t1"))
    with pytest.raises(ValueError):
        crossval.check_events(events.limit(0))
    with pytest.raises(ValueError):
        crossval.event_table(panel(spark, walk(9, 1)), 0)
    assert crossval.PurgedKFold(3).get_n_splits() == 3


def brute_labels(p: pd.Series, span: int, h: int):
    vol = p.pct_change().ewm(span=span, adjust=False).std().bfill()
    out = {}
    for i in range(len(p) - 1):
        j = min(i + h, len(p) - 1)
        if not vol.iloc[i] > 0:
            continue
        path = p.iloc[i : j + 1]
        up = path[path >= p.iloc[i] * (1 + vol.iloc[i])].index.min()
        down = path[path <= p.iloc[i] * (1 - vol.iloc[i])].index.min()
        if not pd.isna(up) and (pd.isna(down) or up <= down):
            out[i] = 1
        elif not pd.isna(down):
            out[i] = -1
        else:
            out[i] = int(np.sign(p.iloc[j] - p.iloc[i]))
    return out


def test_triple_barrier_both_forms(spark):
    w = walk(70, 2, 6)
    df = panel(spark, w)
    got = labels.triple_barrier(df, 5, span=20)
    for a in w:
        assert {r.pos: r.y for r in got.filter(F.col("asset") == a).collect()} == brute_labels(w[a], 20, 5)
    ev = labels.barrier_events(df, 5, span=20).filter("t0 < t1")
    joined = labels.label_events(df, ev.withColumn("event_id", F.struct("asset", "pos"))).select("asset", "t0", "y")
    assert sorted(joined.collect()) == sorted(got.select("asset", "t0", "y").collect())
    meta = labels.meta_labels(got).toPandas()
    assert ((meta["y"] != 0) & (np.sign(meta["realised"]) == meta["y"])).astype(int).tolist() == meta["meta"].tolist()
    with pytest.raises(ValueError):
        labels.barrier_events(df, 0)


@pytest.mark.parametrize("bucket_days", [3, 10, 400])
def test_event_labels_equal_a_loop(spark, bucket_days):
    """Spans of any length, some sharing asset and dates, some outside the prices, null barriers, gaps in the prices."""
    rng = np.random.default_rng(bucket_days)
    w = walk(150, 2, 8)
    w[rng.random(w.shape) < 0.2] = np.nan
    rows = []
    for k in range(240):
        a, lo = f"A{k % 3}", int(rng.integers(-10, 155))
        pt, sl = (None if rng.random() < 0.1 else float(100 + s * rng.uniform(0, 40)) for s in (1, -1))
        rows += [(k, a, lo, lo + int(rng.integers(-3, 120)), pt, sl)]
    rows += [(900, "A0", 5, 100, 102.0, 60.0), (901, "A0", 5, 100, 500.0, 99.5), (902, None, 5, 100, 1.0, 1.0), (903, "A0", None, 9, 1.0, 1.0)]
    start = w.index[0]
    day = lambda k: None if k is None else (start + pd.Timedelta(days=k)).date()
    want = {}
    for k, a, lo, hi, pt, sl in rows:
        path = w[a].loc[pd.Timestamp(day(lo)) : pd.Timestamp(day(hi))].dropna() if a in w and lo is not None else pd.Series(dtype=float)
        y = 0
        if len(path) and lo < hi:
            y = int(np.sign(path.iloc[-1] - path.iloc[0]))
            for price in path:
                if pt is not None and price >= pt or sl is not None and price <= sl:
                    y = 1 if pt is not None and price >= pt else -1
                    break
        want[k] = y
    ev = spark.createDataFrame([(k, a, day(lo), day(hi), pt, sl) for k, a, lo, hi, pt, sl in rows], "event_id long, asset string, t0 date, t1 date, pt double, sl double")
    got = labels.label_events(panel(spark, w), ev, bucket_days).collect()
    assert len(got) == len(rows) and {r.event_id: r.y for r in got} == want
    with pytest.raises(KeyError):
        labels.label_events(panel(spark, w), ev.drop("event_id"))


def test_features_do_not_look_ahead(spark):
    w = walk(60, 2, 7)
    full = labels.build_features(panel(spark, w), 5, 10)
    cut = labels.build_features(panel(spark, w.iloc[:40]), 5, 10)
    for c in ("momentum", "volatility", "mean_rev"):
        same(wide_of(full, c).iloc[:40], wide_of(cut, c))
    same(wide_of(full, "momentum"), w.pct_change(5).shift(1))
    same(wide_of(full, "mean_rev"), ((w - w.rolling(5).mean()) / w.rolling(5).std()).shift(1), 1e-7)


def test_fractional_differencing(spark):
    w = walk(60, 1, 9)
    k = fracdiff.kernel(0.5, 0.02)
    assert k[:3] == (1.0, -0.5, -0.125) and len(fracdiff.kernel(0.5, 1e-9, 7)) == 7
    want = sum(c * w.shift(j) for j, c in enumerate(k))
    same(wide_of(fracdiff.fracdiff(panel(spark, w), 0.5, 0.02), "value"), want)
    ahead = sum(c * w.shift(-j).fillna(0) for j, c in enumerate(k))
    same(wide_of(fracdiff.fracdiff(panel(spark, w), 0.5, 0.02, mode="forward"), "value"), ahead)
    same(wide_of(fracdiff.fracdiff(panel(spark, w), 0), "value"), w)
    with pytest.raises(ValueError):
        fracdiff.kernel(-0.1)


def test_kernel_keeps_long_memory(spark):
    k = fracdiff.kernel(0.4)
    assert len(k) == 282 and abs(sum(k) - 0.070) < 1e-3
    assert len(fracdiff.kernel(0.1, 1e-6)) > 1000
    w = walk(300, 1, 9)
    want = sum(c * w.shift(j) for j, c in enumerate(k))
    same(wide_of(fracdiff.fracdiff(panel(spark, w), 0.4), "value"), want)
    short = sum(c * w[:90].shift(j) for j, c in enumerate(fracdiff.kernel(0.4, most=90)))
    assert short.notna().sum().sum() == 1
    same(wide_of(fracdiff.fracdiff(panel(spark, w[:90]), 0.4), "value"), short)


def test_least_order(spark):
    rng = np.random.default_rng(3)
    w = walk(400, 2)
    w["A0"] = 50 + rng.normal(0, 1, 400)
    w["A1"] = 1000 + np.cumsum(rng.normal(0, 1, 400))
    got = {r.asset: r for r in fracdiff.least_order(panel(spark, w), threshold=0.01).collect()}
    assert got["A0"].d == 0.1 and got["A0"].stationary and got["A1"].d > 0.1
    short = fracdiff.least_order(panel(spark, w.iloc[:30])).first()
    assert short.d == 0.6 and not short.stationary and short.tested == {} and short.p_value is None
    first = got["A1"]
    assert max(first.tested) == first.d and first.tested[first.d] == first.p_value and all(p >= 0.05 for d, p in first.tested.items() if first.stationary and d < first.d)
    loose = fracdiff.least_order(panel(spark, w.iloc[:30]), candidates=(0.0, 0.2), p_threshold=1.1, min_obs=10).first()
    assert loose.d == 0.0 and loose.stationary


def dickey_fuller(x):
    """Statistic with a constant, lags by the AIC, one least-squares fit after another."""
    n, dx = len(x), np.diff(x)
    most, best = max(min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3), 0), (np.inf, np.nan)
    for k in range(most + 1):
        y = dx[most:]
        a = np.column_stack([x[most:-1], np.ones(len(y))] + [dx[most - j : len(dx) - j] for j in range(1, k + 1)])
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        rss = ((y - a @ beta) ** 2).sum()
        aic = len(y) * np.log(rss / len(y)) + 2 * a.shape[1]
        if aic < best[0]:
            best = (aic, beta[0] / np.sqrt(rss / (len(y) - a.shape[1]) * np.linalg.pinv(a.T @ a)[0, 0]))
    return best[1]


@pytest.mark.parametrize("least", [64, 4096])
def test_least_order_equals_one_fit_after_another(spark, least):
    w = walk(700, 3, 12)
    w["A2"] = 5000 + 10 * w["A2"]
    w.iloc[[3, 200, 201], 0] = np.nan
    got = {r.asset: r for r in fracdiff.least_order(panel(spark, w), threshold=0.005, p_threshold=0.0, least=least).collect()}
    for a in w:
        x = w[a].dropna().to_numpy()
        assert set(got[a].tested) == {0.1, 0.2, 0.3, 0.4, 0.5, 0.6} and not got[a].stationary
        for d, p in got[a].tested.items():
            y = np.convolve(x, fracdiff.kernel(d, 0.005, len(x)), mode="valid")
            assert p == pytest.approx(fracdiff.unit_root_p(dickey_fuller(y)), rel=1e-7, abs=1e-10)


def test_unit_root_p_values():
    """The published five and ten per cent points, and the ends of the table."""
    assert abs(fracdiff.unit_root_p(-2.86154) - 0.05) < 0.001 and abs(fracdiff.unit_root_p(-2.56677) - 0.10) < 0.001
    assert fracdiff.unit_root_p(3.0) == 1.0 and fracdiff.unit_root_p(-20.0) == 0.0 and fracdiff.unit_root_p(0.0) > 0.9


def newton(x, y, steps=50):
    """Logistic regression with a unit L2 penalty on all but the intercept, one group at a time."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge, b = np.diag([0.0] + [1.0] * x.shape[1]), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -50, 50)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(b)), a.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-10:
            break
    return b


def test_logistic_fits_equal_one_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(7):
        x = rng.normal(0, 1 + g, (40 + 5 * g, 2))
        y = (x[:, 0] - x[:, 1] + rng.normal(0, 2, len(x)) > 0).astype(float) if g else (x[:, 0] > 0).astype(float)
        want[g] = newton(x, y)
        rows += [(g, float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "g long, u double, v double, y int").repartition(5)
    got = {r.g: [r.b0, r.b1, r.b2] for r in model.logistic_fits(df, ["g"], "y", ["u", "v"]).collect()}
    assert got.keys() == want.keys()
    for g, b in want.items():
        np.testing.assert_allclose(got[g], b, rtol=1e-8, atol=1e-8)
    assert model.logistic_fits(df.limit(0), ["g"], "y", ["u", "v"]).count() == 0


def test_meta_model(spark):
    df = panel(spark, walk(300, 2, 1))
    got = {r.asset: r for r in model.meta_model(df, span=20, n_splits=4, embargo=0.01).collect()}
    for asset, rows in model.training_table(df, span=20).toPandas().sort_values("pos").groupby("asset"):
        n, scores = len(rows), []
        s0, s1 = (np.array([pd.Timestamp(t).timestamp() for t in rows[c]]) for c in ("t0", "t1"))
        x, y, e = rows[model.FEATURES].to_numpy(float), rows["meta"].to_numpy(float), (s1.max() - s0.min()) * 0.01
        fold = np.repeat(np.arange(4), [n // 4 + (k < n % 4) for k in range(4)])
        for k in range(4):
            test = fold == k
            train = ~test & ((s0 > s1[test].max() + e) | (s1 < s0[test].min() - e))
            if len(set(y[train])) == 2:
                m, d = x[train].mean(0), x[train].std(0)
                b = newton((x[train] - m) / d, y[train])
                scores.append(((b[0] + (x[test] - m) / d @ b[1:] > 0) == (y[test] == 1)).mean())
        r = got[asset]
        assert (r.n_samples, r.n_positive, r.folds) == (n, y.sum(), len(scores)) and r.n_positive + r.n_negative == n
        assert (r.cv_accuracy_mean, r.cv_accuracy_std) == (pytest.approx(np.mean(scores)), pytest.approx(np.std(scores)))
    few = model.meta_model(panel(spark, walk(28, 1)), lookback=20, span=5).collect()
    assert all(r.cv_accuracy_mean is None for r in few)


def test_search(spark):
    df = panel(spark, walk(150, 4, 3))
    r = search.optimize_parameter(df, "momentum", "lookback", [5, 10], run_best=True, n_splits=3)
    rows = {x.place: x["mean"] for x in r.scores.collect()}
    assert r.best == [5, 10][max(rows, key=lambda k: (rows[k], -k))] and r.final.settings["lookback"] == r.best
    for signal, name, tried in (("momentum", "lookback", [3, 10, 200]), ("volatility", "lookback", [7]), ("mean_reversion", "lookback", [4, 4]), ("ewma_momentum", "span", [1, 9]), ("ma_crossover", "short_window", [5, 8])):
        got = {x.place: (x["mean"], x["median"]) for x in search.optimize_parameter(df, signal, name, tried, n_splits=4, horizon=3).scores.collect()}
        for k, c in enumerate(tried):
            each = search.cross_validate_sharpe(df, signal, 4, horizon=3, **{name: c}).agg(F.avg("sharpe"), F.median("sharpe")).first()
            assert got[k] == (pytest.approx(each[0]), pytest.approx(each[1]))
    with pytest.raises(ValueError):
        search.optimize_parameter(df, "momentum", "lookback", [0])
    grid = search.sweep(df, "momentum", [5, 10], [0.5, 1.0])
    assert grid.count() == 4 and search.best_cell(grid).count() == 1
    with pytest.raises(RuntimeError):
        search.optimize_parameter(df, "momentum", "lookback", [])
