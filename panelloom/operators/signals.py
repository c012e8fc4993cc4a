"""Signals: a panel to scores (asset, ts, pos, price, ret, score), known one date before they are used.

Every signal ends with a lag of one date.  ``REGISTRY`` maps names to functions of (panel, **options);
:func:`register_signal` adds to it, as a call or as a decorator.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.windows import across, along, change, ewm_mean, lag, rolling, rolling_cov, rolling_std, running
from panelloom.operators import arma
from panelloom.session import ship
from panelloom.sources.panels import with_returns

EPS = 1e-8
VAR_FLOOR = 1e-10
WORKING = ("market", "resid", "__mom", "__vol", "__ewm", "__fit")
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register_signal(name: str, function: Callable[..., DataFrame] | None = None):
    """``register_signal("x", f)`` or ``@register_signal("x")``."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = f
        return f

    return add(function) if function else add


def compute_signal(name: str, panel: DataFrame, **options) -> DataFrame:
    """The signal ``name`` with those of ``options`` that it takes."""
    if name not in REGISTRY:
        raise ValueError(f"unknown signal {name!r}; known: {', '.join(sorted(REGISTRY))}")
    f = REGISTRY[name]
    takes = inspect.signature(f).parameters
    if not any(p.kind is p.VAR_KEYWORD for p in takes.values()):
        options = {k: v for k, v in options.items() if k in takes}
    return f(panel, **options)


def _positive(**values: int) -> None:
    for k, v in values.items():
        if v < 1:
            raise ValueError(f"{k} must be at least 1, got {v}")


def _scored(df: DataFrame, score: Column) -> DataFrame:
    """``df`` with the score, lagged, and without working columns; columns that the caller brought stay."""
    df = df.withColumn("score", score)
    return df.withColumn("score", lag(F.col("score"), 1, along())).drop(*WORKING)


@register_signal("momentum")
def momentum(panel: DataFrame, lookback: int = 20) -> DataFrame:
    _positive(lookback=lookback)
    return _scored(with_returns(panel), rolling(F.sum, F.col("ret"), lookback, along()))


@register_signal("mean_reversion")
def mean_reversion(panel: DataFrame, lookback: int = 20) -> DataFrame:
    """The negative of momentum, from the same sums, so that the two cancel exactly."""
    return momentum(panel, lookback).withColumn("score", -F.col("score"))


@register_signal("skip_month_momentum")
def skip_month_momentum(panel: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    _positive(lookback=lookback, skip=skip)
    if skip >= lookback:
        raise ValueError(f"skip ({skip}) must be below lookback ({lookback})")
    w = along()
    return _scored(with_returns(panel), F.try_divide(lag(F.col("price"), skip, w), lag(F.col("price"), lookback, w)) - 1)


@register_signal("residual_momentum")
def residual_momentum(panel: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Momentum of what an equal-weight market with a rolling beta leaves unexplained."""
    _positive(lookback=lookback, skip=skip)
    if skip >= lookback:
        raise ValueError(f"skip ({skip}) must be below lookback ({lookback})")
    w, half = along(), lookback // 2
    df = with_returns(panel).withColumn("market", F.avg("ret").over(across()))
    variance = rolling(F.var_samp, F.col("market"), lookback, w, half)
    beta = rolling_cov(F.col("ret"), F.col("market"), lookback, w, half) / F.when(variance.isNotNull(), F.greatest(variance, F.lit(VAR_FLOOR)))
    df = df.withColumn("resid", F.col("ret") - beta * F.col("market"))
    return _scored(df, rolling(F.sum, F.col("resid"), lookback, w, half) - rolling(F.sum, F.col("resid"), skip, w, 1))


@register_signal("volatility")
def volatility(panel: DataFrame, lookback: int = 20) -> DataFrame:
    _positive(lookback=lookback)
    return _scored(with_returns(panel), -rolling(F.avg, F.col("ret") * F.col("ret"), lookback, along()))


@register_signal("vol_scaled_momentum")
def vol_scaled_momentum(panel: DataFrame, lookback: int = 20, vol_window: int = 20) -> DataFrame:
    _positive(lookback=lookback, vol_window=vol_window)
    r = F.col("ret")
    return _scored(with_returns(panel), rolling(F.sum, r, lookback, along()) / (rolling_std(r, vol_window, along()) + EPS))


@register_signal("regime_switch")
def regime_switch(panel: DataFrame, lookback: int = 20, vol_window: int = 20, vol_threshold: float = 0.02) -> DataFrame:
    """Momentum while the mean deviation across assets is below the threshold, reversal above it, NULL while it is unknown."""
    _positive(lookback=lookback, vol_window=vol_window)
    df = with_returns(panel)
    df = df.withColumns({"__mom": rolling(F.sum, F.col("ret"), lookback, along()), "__vol": rolling_std(F.col("ret"), vol_window, along())})
    calm = F.avg("__vol").over(across()) < vol_threshold
    return _scored(df, F.when(calm, F.col("__mom")).when(~calm, -F.col("__mom")))


@register_signal("ewma_momentum")
def ewma_momentum(panel: DataFrame, span: int = 20) -> DataFrame:
    _positive(span=span)
    return _scored(ewm_mean(with_returns(panel), "__ewm", "ret", span, ["asset"]), F.col("__ewm"))


@register_signal("ma_crossover")
def ma_crossover(panel: DataFrame, short_window: int = 10, long_window: int = 50) -> DataFrame:
    """Short minus long moving average, in units of price."""
    _positive(short_window=short_window, long_window=long_window)
    if long_window <= short_window:
        raise ValueError("long_window must exceed short_window")
    p = F.col("price")
    return _scored(with_returns(panel), rolling(F.avg, p, short_window, along()) - rolling(F.avg, p, long_window, along()))


#: Signals that are a window's sum: what is summed, and the score from sum and count.
WINDOW_SUMS: dict[str, tuple[Callable[[], Column], Callable[[Column, Column], Column]]] = {
    "momentum": (lambda: F.col("ret"), lambda s, n: s),
    "mean_reversion": (lambda: F.col("ret"), lambda s, n: -s),
    "volatility": (lambda: F.col("ret") * F.col("ret"), lambda s, n: -s / n),
}


def _by_length(panel: DataFrame, signal: str, table: DataFrame) -> DataFrame:
    """Scores of windows of every ``value`` rows in ``table``, as differences of one running sum at two places.

    Each row sends its running sum to the date after it, where a window ends, and its negative to the date after
    the window that begins behind it, so one grouping serves all lengths; the score comes out lagged.
    """
    x, score = WINDOW_SUMS[signal]
    ever = running(along())
    df = with_returns(panel).withColumns({"__s": F.sum(F.coalesce(x(), F.lit(0.0))).over(ever), "__n": F.count(x()).over(ever)})
    part = lambda at, s, n, row: F.struct(at.alias("at"), s.alias("s"), n.alias("n"), row.alias("row"))
    row = F.struct("ts", "price", "ret")
    none = F.when(F.lit(False), row)
    pos, s, n = F.col("pos"), F.col("__s"), F.col("__n")
    parts = F.array(part(pos, F.lit(0.0), F.lit(0).cast("long"), row), part(pos + 1, s, n, none), part(pos + F.col("value") + 1, -s, -n, none))
    rows = df.crossJoin(F.broadcast(table)).select("place", "value", "asset", F.explode(parts).alias("e"))
    out = rows.groupBy("place", "value", "asset", F.col("e.at").alias("pos")).agg(F.sum("e.s").alias("s"), F.sum("e.n").alias("n"), F.max("e.row").alias("row")).filter("row is not null")
    full = F.when(F.col("n") >= F.col("value"), score(F.col("s"), F.col("n")))
    return out.select("place", "value", "asset", "row.ts", "pos", "row.price", "row.ret", full.alias("score"))


def candidate_scores(panel: DataFrame, signal: str, name: str, candidates: list, **options) -> DataFrame:
    """(place, value, asset, ts, pos, price, ret, score): the signal for every candidate of its option ``name``.

    One plan over one panel, with the candidate as a key, for the lookback of window sums and the span of the
    exponential momentum; for other signals and options the candidates' plans side by side.
    """
    spark = panel.sparkSession
    if name == "lookback" and signal in WINDOW_SUMS or (signal, name) == ("ewma_momentum", "span"):
        _positive(**{name: min(candidates)})
        table = spark.createDataFrame([(k, int(c)) for k, c in enumerate(candidates)], "place int, value int")
        if name == "lookback":
            return _by_length(panel, signal, table)
        df = with_returns(panel).crossJoin(F.broadcast(table))
        df = ewm_mean(df, "__ewm", "ret", F.col("value"), ["place", "asset"])
        return df.withColumn("score", F.lag("__ewm").over(along("place"))).select("place", "value", "asset", "ts", "pos", "price", "ret", "score")
    each = [compute_signal(signal, panel, **(options | {name: c})).withColumns({"place": F.lit(k), "value": F.lit(c)}) for k, c in enumerate(candidates)]
    return reduce(DataFrame.unionByName, each).select("place", "value", "asset", "ts", "pos", "price", "ret", "score")


@register_signal("arima")
def arima(panel: DataFrame, order: tuple[int, int, int] = (1, 0, 1)) -> DataFrame:
    """Per asset, one-step forecasts of a model of its returns, fitted on the whole sample (so parameters look ahead).

    The fit maximises the exact likelihood (``operators.arma``), with a mean where nothing is differenced; a first
    difference has a first forecast of 0.  Where it fails (too few returns, or all equal), the rolling mean of the
    last p returns.  A likelihood runs through a series in order, so an asset's returns are one group.
    """
    ship(panel.sparkSession)
    p, d, q = order
    if d > 1:
        raise ValueError("differences above 1 are not supported")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        r, known = pdf["ret"], pdf["ret"].notna().to_numpy()
        out, x = np.full(len(pdf), np.nan), r[known].to_numpy()
        try:
            forecast = arma.fitted(np.diff(x) if d else x, p, q, constant=not d)["forecast"]
            out[known] = np.append(0.0, x[:-1] + forecast) if d else forecast
        except (np.linalg.LinAlgError, ValueError, IndexError):
            out = r.rolling(max(p, 1)).mean().to_numpy()
        return pdf.assign(score=out)[["asset", "pos", "score"]]

    df = with_returns(panel)
    fits = df.select("asset", "pos", "ret").groupBy("asset").applyInPandas(fit, "asset string, pos long, score double")
    fits = fits.withColumn("score", F.nullif(F.col("score"), F.lit(float("nan"))))
    return _scored(df.join(fits.withColumnRenamed("score", "__fit"), ["asset", "pos"]), F.col("__fit"))


def k_period_change(panel: DataFrame, n: int) -> DataFrame:
    return with_returns(panel).withColumn("ret", change(F.col("price"), n, along()))
