"""Single-signal backtest: panel to signal, weights, returns, stop, equity and measures, as one lazy plan."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelloom.operators.metrics import backtest_summary
from panelloom.operators.portfolio import Rebalance, construct, date_blocks, own_dates
from panelloom.operators.signals import compute_signal
from panelloom.operators.simulate import drawdown_stop, simulate, with_equity


log = logging.getLogger(__name__)


@dataclass
class BacktestResult:
    """daily (ts, pos, gross, turnover, cost, net, stopped, equity, drawdown), weights, metrics (one row)."""

    daily: DataFrame
    weights: DataFrame
    metrics: DataFrame
    settings: dict[str, Any] = field(default_factory=dict)

    def metrics_dict(self) -> dict[str, Any]:
        return self.metrics.first().asDict() | self.settings


def observed_panel(panel: DataFrame) -> tuple[DataFrame, Observation]:
    """The panel, and counts that ride on the first action that reads it: no scan of their own."""
    seen = Observation(f"panel-{uuid.uuid4().hex}")
    gap = F.col("price").isNull() & (F.col("pos") > 0)
    counts = [F.count(F.lit(1)).alias("cells"), F.coalesce(F.max("pos") + 1, F.lit(0)).alias("dates"), F.count_if(gap).alias("gaps")]
    return panel.observe(seen, *counts), seen


def check_observed(seen: Observation) -> dict[str, int]:
    """Cells, dates and gaps after the action; fails on fewer than two dates, warns of gaps, which are carried forward.

    A price missing on the first date is no gap.  Waits for the action if it still runs.
    """
    counts = seen.get
    if counts["dates"] < 2:
        raise ValueError(f"need at least 2 dates, got {counts['dates']}")
    if counts["gaps"]:
        log.warning("%d of %d prices are missing and carried forward", counts["gaps"], counts["cells"])
    return counts


def backtest(
    panel: DataFrame,
    signal: str = "momentum",
    max_gross: float = 1.0,
    max_leverage: float | None = None,
    cost_bps: float = 10.0,
    impact: str = "proportional",
    frequency: Rebalance | str = "daily",
    max_drawdown: float | None = None,
    **options: Any,
) -> BacktestResult:
    """Options reach the signal if it takes them.

    Daily weights need no date but the one before, so they are made and judged in blocks of dates; weights that are
    held longer go back to their assets.
    """
    scored = compute_signal(signal, panel, **options)
    if Rebalance(frequency) is Rebalance.DAILY:
        blocks = construct(date_blocks(scored), max_gross, max_leverage, frequency, "__block")
        weights, daily = own_dates(blocks), own_dates(simulate(blocks, cost_bps, impact, "__block"))
    else:
        weights = construct(scored, max_gross, max_leverage, frequency)
        daily = simulate(weights, cost_bps, impact)
    if max_drawdown is not None:
        daily = drawdown_stop(daily, max_drawdown)
    settings = {
        "signal": signal, "max_gross": max_gross, "max_leverage": max_leverage, "cost_bps": cost_bps, "impact": impact,
        "frequency": Rebalance(frequency).value, "max_drawdown": max_drawdown, **options,
    }
    return BacktestResult(with_equity(daily), weights.select("asset", "ts", "pos", "weight"), backtest_summary(daily), settings)
