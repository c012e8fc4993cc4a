"""Fractional differencing and the least order that passes a unit-root test."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import ship


@lru_cache(maxsize=64)
def kernel(d: float, threshold: float = 1e-4, most: int | None = None) -> tuple[float, ...]:
    """Binomial weights of order ``d`` down to ``threshold``, at most ``most``, the length of the series."""
    if d < 0:
        raise ValueError("d must not be negative")
    if most is None and threshold <= 0:
        raise ValueError("weights without a threshold need a largest number")
    out = [1.0]
    while most is None or len(out) < most:
        w = out[-1] * (len(out) - 1 - d) / len(out)
        if abs(w) < threshold:
            break
        out.append(w)
    return tuple(out)


def fracdiff(panel: DataFrame, d: float, threshold: float = 1e-4, most: int | None = None, mode: str = "causal") -> DataFrame:
    """Adds value: the differenced price of each asset.

    The kernel is cut at ``threshold`` and at ``most`` weights, by default the rows of an asset, which are
    counted first (every asset of a panel has as many).  ``causal`` weighs the past, NULL until the kernel is
    full.  ``forward`` weighs the rows ahead, with zeros beyond the end, as a convolution read off too late
    would give.
    """
    if d < 0:
        raise ValueError("d must not be negative")
    if d == 0:
        return panel.withColumn("value", F.col("price"))
    if most is None:
        most = panel.groupBy("asset").count().agg(F.max("count")).first()[0] or 1
    return filtered(panel, kernel(d, threshold, most), mode == "forward")


def filtered(panel: DataFrame, weights: tuple[float, ...], forward: bool = False, least: int = 4096) -> DataFrame:
    """Adds value: ``weights`` over an asset's prices, by overlap-save blocks.

    Each block has as many positions again as the kernel, at least, and the rows before it (ahead of it) that its
    own rows weigh; a row goes to two blocks at most.  One Fourier transform serves a block, so the cost of
    a row grows with the logarithm of the kernel, and an asset's series is many tasks.
    """
    ship(panel.sparkSession)
    n = len(weights)
    size = max(least, 1 << (2 * n - 1).bit_length())
    w = np.array(weights)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ascending=not forward)
        x, known = pdf["price"].fillna(0.0).to_numpy(float), pdf["price"].notna().to_numpy()
        m = 1 << (len(x) + n - 1).bit_length()
        y = np.fft.irfft(np.fft.rfft(x, m) * np.fft.rfft(w, m), m)[: len(x)]
        seen = np.cumsum(known)
        seen[n:] -= seen[:-n].copy()
        out = pdf.drop(columns="block").assign(value=y if forward else np.where(seen == n, y, np.nan))
        return out[(pdf["pos"] // size == pdf["block"]).to_numpy()]

    low, high = ("greatest(pos - {0}, 0)", "pos") if forward else ("pos", "pos + {0}")
    blocks = F.sequence(*[F.floor(F.expr(e.format(n - 1)) / size) for e in (low, high)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema.fields)
    out = panel.withColumn("block", F.explode(blocks)).groupBy("asset", "block").applyInPandas(block, f"{kinds}, value double")
    return out.withColumn("value", F.nullif("value", F.lit(float("nan"))))


def most_lags(n: int) -> int:
    """Lags that the unit-root test of ``n`` values may have."""
    return max(min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3), 0)


def products(y: np.ndarray, at: np.ndarray, lags: int) -> np.ndarray:
    """Sums of products of the regression's columns over its rows ``at``: level, one, ``lags`` lagged changes, change."""
    dy = np.diff(y)
    z = np.column_stack([y[at], np.ones(len(at)), *[dy[at - j] for j in range(1, lags + 1)], dy[at]])
    return z.T @ z


def statistic(sums: np.ndarray) -> float:
    """Augmented Dickey-Fuller statistic with a constant from sums of products, lags chosen by the AIC.

    Every number of lags has the same rows and the first columns of the same matrix.
    """
    rows, last, best = sums[1, 1], sums.shape[0] - 1, (math.inf, math.nan)
    for k in range(last - 1):
        m = k + 2
        inverse = np.linalg.pinv(sums[:m, :m], hermitian=True)
        beta = inverse @ sums[:m, last]
        rss = sums[last, last] - beta @ sums[:m, last]
        if rss <= 0 or rows <= m:
            continue
        aic = rows * math.log(rss / rows) + 2 * m
        if aic < best[0]:
            best = (aic, float(beta[0] / math.sqrt(rss / (rows - m) * inverse[0, 0])))
    return best[1]


#: MacKinnon's (1994) approximation of the p-value of the statistic with a constant: below and above STAR the normal
#: probability of a polynomial in the statistic.  Fixed values of the published tables.
STAR = -1.61
BELOW = (2.1659, 1.4412, 0.038269)
ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(t: float) -> float:
    """p-value of an augmented Dickey-Fuller statistic with a constant."""
    if math.isnan(t):
        return math.nan
    if t > 2.74 or t < -18.83:  # beyond the range of the tables
        return 1.0 if t > 0 else 0.0
    return NormalDist().cdf(sum(c * t**k for k, c in enumerate(BELOW if t <= STAR else ABOVE)))


def least_order(panel: DataFrame, candidates: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6), threshold: float = 1e-4, p_threshold: float = 0.05, min_obs: int = 50, least: int = 4096) -> DataFrame:
    """(asset, d, p_value, stationary, tested): the first order whose differenced series rejects a unit root.

    ``tested`` maps the orders tried to their p-values.  Orders that leave fewer than ``min_obs`` values are
    passed over; without a success d is the largest order, ``stationary`` is false and ``p_value`` that of d,
    NULL if it was not tried.

    One pass serves all orders and lags: each block of an asset's prices, with the rows before it that its own
    need, is differenced by every order and gives the sums of products of the test's columns, a matrix of about
    thirty rows; an asset's matrices add up, and the choice of lags and the statistic are algebra on their sum.
    Prices enter less their mean and in units of their deviation, which changes no statistic.
    """
    ship(panel.sparkSession)
    orders = sorted(candidates)
    order = Window.partitionBy("asset").orderBy("pos")
    x = panel.select("asset", "pos", "price").filter("price is not null").withColumn("at", F.row_number().over(order) - 1)
    whole = Window.partitionBy("asset")
    x = x.withColumns({"n": F.count("price").over(whole), "mean": F.avg("price").over(whole), "spread": F.stddev_pop("price").over(whole)})
    n_most = x.agg(F.max("n")).first()[0] or 1
    reach = max(len(kernel(d, threshold, n_most)) for d in orders) + most_lags(n_most) + 1
    size = max(least, 1 << reach.bit_length())
    blocks = F.explode(F.sequence(F.floor(F.col("at") / size), F.floor(F.least(F.col("at") + reach, F.col("n") - 1) / size)))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        n, block, first = int(pdf["n"].iloc[0]), int(pdf["block"].iloc[0]), int(pdf["at"].iloc[0])
        z = (pdf["price"].to_numpy() - pdf["mean"].iloc[0]) / (pdf["spread"].iloc[0] or 1.0)
        out = []
        for d in orders:
            w = np.array(kernel(d, threshold, n))
            values = n - len(w) + 1
            if values < min_obs:
                continue
            lags, m = most_lags(values), 1 << (len(z) + len(w)).bit_length()
            y = np.fft.irfft(np.fft.rfft(z, m) * np.fft.rfft(w, m), m)[len(w) - 1 : len(z)]  # of places first + len(w) - 1 and on
            ends = np.arange(max(block * size, len(w) + lags), min((block + 1) * size, n))  # the later value of a row's change
            at = ends - (first + len(w) - 1) - 1
            if len(at):
                out.append((pdf["asset"].iloc[0], d, values, products(y, at, lags).ravel().tolist()))
        return pd.DataFrame(out, columns=["asset", "d", "n", "products"])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        found, tested = None, {}
        for d in orders:
            own = pdf.loc[pdf["d"] == d, "products"]
            if len(own):
                total = np.sum([np.array(v) for v in own], axis=0)
                side = math.isqrt(len(total))
                tested[d] = unit_root_p(statistic(total.reshape(side, side)))
                if tested[d] < p_threshold:
                    found = d
                    break
        d = orders[-1] if found is None else found
        return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "d": [d], "p_value": pd.array([tested.get(d)], "Float64"), "stationary": [found is not None], "tested": [tested]})

    sums = x.withColumn("block", blocks).groupBy("asset", "block").applyInPandas(summed, "asset string, d double, n long, products array<double>")
    chosen = sums.groupBy("asset").applyInPandas(pick, "asset string, d double, p_value double, stationary boolean, tested map<double,double>")
    none = F.create_map().cast("map<double,double>")
    rest = panel.select("asset").distinct().join(chosen, "asset", "left_anti")
    return chosen.unionByName(rest.select("asset", F.lit(float(orders[-1])).alias("d"), F.lit(None).cast("double").alias("p_value"), F.lit(False).alias("stationary"), none.alias("tested")))
