"""Parameter search by cross-validated Sharpe ratio, and sweeps over two parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.crossval import PurgedKFold, event_table, fold_returns, position_folds
from panelloom.operators.metrics import annual_sharpe, backtest_summary
from panelloom.operators.portfolio import Rebalance, construct, rank_weights
from panelloom.operators.signals import candidate_scores
from panelloom.operators.simulate import drawdown_stop, simulate
from panelloom.plans.backtest import BacktestResult, backtest


@dataclass
class OptimizationResult:
    best: object
    best_score: float
    scores: DataFrame
    final: BacktestResult | None = None


def cross_validate_sharpe(panel: DataFrame, signal: str = "momentum", n_splits: int = 5, embargo_pct: float = 0.0, horizon: int = 5, **options) -> DataFrame:
    """(split, sharpe): one backtest, its returns judged on each test fold; folds without returns drop out."""
    daily = backtest(panel, signal, **options).daily
    return annual_sharpe(fold_returns(daily, event_table(panel, horizon), PurgedKFold(n_splits, embargo_pct)), 252, "split")


def candidate_returns(
    panel: DataFrame, signal: str, name: str, candidates: list, max_gross: float = 1.0, max_leverage: float | None = None, cost_bps: float = 10.0,
    impact: str = "proportional", frequency: Rebalance | str = "daily", max_drawdown: float | None = None, **options,
) -> DataFrame:
    """Daily returns of a backtest for every candidate, told apart by place and value, as one plan over one panel."""
    if not candidates:
        raise RuntimeError("no candidate to try")
    scored = candidate_scores(panel, signal, name, candidates, **options)
    daily = simulate(construct(scored, max_gross, max_leverage, frequency, "place", "value"), cost_bps, impact, "place", "value")
    return daily if max_drawdown is None else drawdown_stop(daily, max_drawdown, "place", "value")


def optimize_parameter(panel: DataFrame, signal: str, name: str, candidates: list, run_best: bool = False, n_splits: int = 5, embargo_pct: float = 0.0, horizon: int = 5, **options) -> OptimizationResult:
    """Each candidate's mean and median fold Sharpe ratio; the first of equal means wins.

    The candidate is a key of one plan: the panel is read once, however many there are.  An embargo moves training
    events only, so it leaves these scores alone.
    """
    cv = PurgedKFold(n_splits, embargo_pct)
    daily = candidate_returns(panel, signal, name, candidates, **options)
    each = annual_sharpe(position_folds(daily, cv.n_splits, horizon, "place"), 252, "place", "split")
    scores = each.groupBy("place").agg(F.avg("sharpe").alias("mean"), F.median("sharpe").alias("median"))
    top = scores.filter("mean is not null").orderBy(F.desc("mean"), "place").first()
    if top is None:
        raise RuntimeError("no candidate gave a score")
    best = candidates[top.place]
    return OptimizationResult(best, top["mean"], scores, backtest(panel, signal, **options, **{name: best}) if run_best else None)


def optimize_ewma(panel: DataFrame, spans: list[int] = (5, 10, 20, 40), **options) -> OptimizationResult:
    return optimize_parameter(panel, "ewma_momentum", "span", list(spans), **options)


def sweep(panel: DataFrame, signal: str, lookbacks: list[int], grosses: list[float], cost_bps: float = 10.0, impact: str = "proportional") -> DataFrame:
    """(lookback, max_gross, measures): gross only scales the weights, so a lookback's ranks are shared by all; one plan over one panel."""
    table = panel.sparkSession.createDataFrame([(float(g),) for g in grosses], "max_gross double")
    unit = rank_weights(candidate_scores(panel, signal, "lookback", lookbacks), 1.0, "place").withColumnRenamed("value", "lookback")
    rows = unit.crossJoin(F.broadcast(table)).withColumn("weight", F.col("weight") * F.col("max_gross"))
    return backtest_summary(simulate(rows, cost_bps, impact, "lookback", "max_gross"), "lookback", "max_gross")


def best_cell(grid: DataFrame) -> DataFrame:
    return grid.filter("sharpe is not null").orderBy(F.desc("sharpe"), "lookback", "max_gross").limit(1)
