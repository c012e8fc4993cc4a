"""Results to files: measures as JSON, series and weights as CSV, plot tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.simulate import monthly_table, rolling_sharpe
from panelloom.plans.backtest import BacktestResult
from panelloom.sources.panels import long_to_wide, missing_counts


def write_metrics(metrics: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(metrics, indent=2, default=str) + "\n")


def write_csv(df: DataFrame, path: str | Path) -> None:
    """A folder of CSV files, written by the executors."""
    df.write.mode("overwrite").csv(str(path), header=True)


def write_backtest(result: BacktestResult, folder: str | Path, plots: bool = True) -> dict:
    """metrics.json, daily_returns, weights, and the tables behind the plots."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    metrics = result.metrics_dict()
    write_metrics(metrics, folder / "metrics.json")
    write_csv(result.daily.select("ts", "net").orderBy("ts"), folder / "daily_returns")
    write_csv(long_to_wide(result.weights, "weight"), folder / "weights")
    if plots:
        for name, df in plot_tables(result.daily).items():
            write_csv(df, folder / name)
    return metrics


def plot_tables(daily: DataFrame) -> dict[str, DataFrame]:
    return {
        "equity": daily.select("ts", "equity").orderBy("ts"),
        "drawdown": daily.select("ts", "drawdown").orderBy("ts"),
        "rolling_sharpe": rolling_sharpe(daily).select("ts", "sharpe").orderBy("ts"),
        "monthly_returns": monthly_table(daily).orderBy("year"),
    }


def train_test_table(windows: DataFrame) -> DataFrame:
    """(win, sample, sharpe): the two bars of each walk-forward window, "train" and "test"."""
    bars = F.array(*[F.struct(F.lit(n).alias("sample"), F.col(c).alias("sharpe")) for n, c in (("train", "train_sharpe"), ("test", "oos_sharpe"))])
    return windows.select("win", F.explode(bars).alias("bar")).select("win", "bar.sample", "bar.sharpe")


def sweep_matrix(grid: DataFrame, grosses: list[float]) -> DataFrame:
    """One row per lookback of a sweep and a column ``gross_<g>`` of Sharpe ratios per gross, points as underscores."""
    cells = [F.max(F.when(F.col("max_gross") == g, F.col("sharpe"))).alias(f"gross_{g}".replace(".", "_")) for g in map(float, grosses)]
    return grid.groupBy("lookback").agg(*cells)


def write_prices(panel: DataFrame, folder: str | Path) -> dict:
    """Prices as wide CSV, and what is missing per asset as metadata.json."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    write_csv(long_to_wide(panel), folder / "prices")
    gaps = {r.asset: r.missing for r in missing_counts(panel).collect()}
    span = panel.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("ts").alias("dates")).first()
    meta = {"missing": gaps, "first": str(span["first"]), "last": str(span["last"]), "dates": span["dates"]}
    write_metrics(meta, folder / "metadata.json")
    return meta
