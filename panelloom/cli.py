"""Command line: run, cv, train, example, combined, sweep, passive, fetch."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom import sinks
from panelloom.operators import crossval, metrics, model, simulate
from panelloom.operators.portfolio import Rebalance
from panelloom.operators.risk import RiskConfig
from panelloom.operators.signals import REGISTRY
from panelloom.plans import blend, search
from panelloom.plans.backtest import backtest, check_observed, observed_panel
from panelloom.session import local_session
from panelloom.sources.loaders import UNIVERSES, load_prices
from panelloom.sources.panels import clean


def _prices(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    tickers = UNIVERSES.get(args.universe) if getattr(args, "universe", None) else args.tickers
    panel = load_prices(spark, args.csv, tickers, args.start, args.end, n_names=args.names, n_days=args.days, seed=args.seed)
    panel, args.observed = observed_panel(panel)
    return panel


def _options(args: argparse.Namespace) -> dict:
    names = ("lookback", "span", "skip", "vol_window", "vol_threshold", "short_window", "long_window")
    return {k: getattr(args, k) for k in names if getattr(args, k) is not None}


def _show(values: dict, path: Path | None = None) -> None:
    print(json.dumps(values, indent=2, default=str))
    if path:
        path.parent.mkdir(parents=True, exist_ok=True)
        sinks.write_metrics(values, path)


def _simulation(args: argparse.Namespace) -> dict:
    return {"max_gross": args.max_gross, "max_leverage": args.max_leverage, "cost_bps": args.cost_bps, "impact": args.impact_model, "frequency": args.rebalance, "max_drawdown": args.max_drawdown}


def cmd_run(spark: SparkSession, args: argparse.Namespace) -> None:
    result = backtest(_prices(spark, args), args.signal, **_simulation(args), **_options(args))
    print(json.dumps(sinks.write_backtest(result, args.output_dir, not args.no_plots), indent=2, default=str))


def cmd_cv(spark: SparkSession, args: argparse.Namespace) -> None:
    folds = search.cross_validate_sharpe(_prices(spark, args), args.signal, args.n_splits, args.embargo_pct, args.horizon, **_options(args)).persist()
    each = [r.sharpe for r in folds.orderBy("split").collect()]
    _show({"fold_sharpes": each} | crossval.cv_summary(folds).first().asDict(), Path(args.output_dir) / "cv.json")


def cmd_train(spark: SparkSession, args: argparse.Namespace) -> None:
    scores = model.meta_model(_prices(spark, args), args.lookback or 20, args.vol_span, (args.profit_taking, args.stop_loss), args.horizon, args.n_splits, args.embargo_pct).persist()
    per = {r.asset: r.asDict() for r in scores.collect()}
    total = scores.agg(F.avg("cv_accuracy_mean").alias("accuracy_mean"), F.stddev_pop("cv_accuracy_mean").alias("accuracy_std")).first().asDict()
    _show(total | {"assets": per}, Path(args.output_dir) / "train.json")


def cmd_example(spark: SparkSession, args: argparse.Namespace) -> None:
    _show(backtest(load_prices(spark, n_names=10, n_days=300), "momentum").metrics_dict())


def cmd_combined(spark: SparkSession, args: argparse.Namespace) -> None:
    risk = None if args.no_risk else RiskConfig(smooth_halflife=args.smooth_halflife, vol_target=args.vol_target)
    shared = {"max_gross": args.max_gross, "cost_bps": args.cost_bps, "impact": args.impact_model, "risk": risk} | _options(args)
    out = Path(args.output_dir)
    if args.mode == "walk_forward":
        result = blend.walk_forward(_prices(spark, args), args.signals, args.train_days, args.test_days, args.step_days, args.weight_step, **shared)
        values = {"overall_metrics": result.metrics.first().asDict(), "window_results": [r.asDict(True) for r in result.windows.orderBy("win").collect()]}
        sinks.write_csv(sinks.train_test_table(result.windows), out / "train_test")
    else:
        result = blend.blend_equal_weight(_prices(spark, args), args.signals, rebalance=args.rebalance, **shared)
        values = result.metrics.first().asDict() | {"weights": result.weights_used, "mode": result.mode, "rebalance": args.rebalance}
    _show(values, out / "metrics.json")
    sinks.write_csv(result.daily.select("ts", "net").orderBy("ts"), out / "daily_returns")


def cmd_sweep(spark: SparkSession, args: argparse.Namespace) -> None:
    grid = search.sweep(_prices(spark, args), args.signal, args.lookbacks, args.grosses, args.cost_bps, args.impact_model).persist()
    best = search.best_cell(grid).first()
    sinks.write_csv(grid, Path(args.output_dir) / "sweep")
    sinks.write_csv(sinks.sweep_matrix(grid, args.grosses), Path(args.output_dir) / "sweep_matrix")
    _show({"best": best.asDict() if best else None}, Path(args.output_dir) / "sweep.json")


def cmd_passive(spark: SparkSession, args: argparse.Namespace) -> None:
    panel = _prices(spark, args)
    made = {"equal_weight": simulate.equal_weight_returns(panel), "buy_and_hold": simulate.buy_and_hold_returns(panel), "inverse_vol": simulate.inverse_vol_returns(panel)}
    _show({k: metrics.passive_summary(v).first().asDict() for k, v in made.items()}, Path(args.output_dir) / "passive.json")


def cmd_fetch(spark: SparkSession, args: argparse.Namespace) -> None:
    _show(sinks.write_prices(clean(_prices(spark, args), args.drop_threshold), args.output_dir))


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="panelloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    made = {}
    for name, run in (("run", cmd_run), ("cv", cmd_cv), ("train", cmd_train), ("example", cmd_example), ("combined", cmd_combined), ("sweep", cmd_sweep), ("passive", cmd_passive), ("fetch", cmd_fetch)):
        p = made[name] = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--csv")
        p.add_argument("--tickers", nargs="+")
        p.add_argument("--universe", choices=sorted(UNIVERSES))
        p.add_argument("--start", default="2018-01-01")
        p.add_argument("--end", default="2023-12-31")
        p.add_argument("--names", type=int, default=20)
        p.add_argument("--days", type=int, default=750)
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--output-dir", default="results")
        p.add_argument("--signal", default="momentum", choices=sorted(REGISTRY))
        for option in ("lookback", "span", "skip", "vol-window", "short-window", "long-window"):
            p.add_argument(f"--{option}", type=int)
        p.add_argument("--vol-threshold", type=float)
        p.add_argument("--max-gross", type=float, default=1.0)
        p.add_argument("--max-leverage", type=float)
        p.add_argument("--cost-bps", type=float, default=10.0)
        p.add_argument("--max-drawdown", type=float)
        p.add_argument("--rebalance", default="daily", choices=[r.value for r in Rebalance])
        p.add_argument("--impact-model", default="proportional", choices=simulate.COST_MODELS)
        p.add_argument("--n-splits", type=int, default=5)
        p.add_argument("--embargo-pct", type=float, default=0.0)
        p.add_argument("--horizon", type=int, default=5)
    made["run"].add_argument("--no-plots", action="store_true")
    for option, value in (("vol-span", 50), ("profit-taking", 1.0), ("stop-loss", 1.0)):
        made["train"].add_argument(f"--{option}", type=type(value), default=value)
    c = made["combined"]
    c.add_argument("--signals", nargs="+", default=["momentum", "mean_reversion", "ewma_momentum"])
    c.add_argument("--mode", choices=("equal_weight", "walk_forward"), default="equal_weight")
    c.add_argument("--no-risk", action="store_true")
    for option, value in (("train-days", 504), ("test-days", 252), ("step-days", 252), ("weight-step", 0.2), ("smooth-halflife", 5), ("vol-target", 0.15)):
        c.add_argument(f"--{option}", type=type(value), default=value)
    made["sweep"].add_argument("--lookbacks", nargs="+", type=int, default=[10, 20, 40])
    made["sweep"].add_argument("--grosses", nargs="+", type=float, default=[0.5, 1.0, 1.5])
    made["fetch"].add_argument("--drop-threshold", type=float, default=0.1)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    args.run(SparkSession.getActiveSession() or local_session(), args)
    if hasattr(args, "observed"):
        check_observed(args.observed)
