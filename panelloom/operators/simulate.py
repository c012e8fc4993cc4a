"""Weights and returns to daily portfolio returns, costs, stops and equity; passive portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import across, along, lag, rolling_std, running, through, total
from panelloom.sources.panels import with_returns

COST_MODELS = ("proportional", "sqrt")


def simulate(weighted: DataFrame, cost_bps: float = 10.0, impact: str = "proportional", *keys: str) -> DataFrame:
    """(keys, ts, pos, gross, turnover, cost, net): weights earn the next date's return.

    Turnover is the sum of absolute changes; the first date changes nothing, so entering is free there.
    """
    if impact not in COST_MODELS:
        raise ValueError(f"impact must be one of {COST_MODELS}, got {impact!r}")
    before = lag(F.col("weight"), 1, along(*keys))
    rows = weighted.withColumns({"__g": before * F.col("ret"), "__t": F.abs(F.col("weight") - before)})
    daily = rows.groupBy(*keys, "ts", "pos").agg(total(F.col("__g")).alias("gross"), total(F.col("__t")).alias("turnover"))
    rate = cost_bps / 10_000
    cost = F.col("turnover") * rate if impact == "proportional" else F.sqrt("turnover") * rate
    return daily.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost"))


def with_equity(daily: DataFrame, net: str = "net", *keys: str) -> DataFrame:
    """Adds equity and drawdown against the highest equity so far."""
    w = running(through(*keys))
    daily = daily.withColumn("equity", F.product(1 + F.col(net)).over(w))
    return daily.withColumn("drawdown", F.try_divide(F.col("equity"), F.max("equity").over(w)) - 1)


def drawdown_stop(daily: DataFrame, max_drawdown: float, *keys: str) -> DataFrame:
    """From the first date whose drawdown exceeds the limit on, returns are 0; adds stopped.

    Weights and turnover go on, as the limit is judged on returns only.
    """
    judged = with_equity(daily, "net", *keys)
    breach = F.coalesce(F.col("drawdown") < -abs(max_drawdown), F.lit(False))
    stopped = F.max(breach).over(running(through(*keys)))
    out = judged.withColumn("stopped", stopped).drop("equity", "drawdown")
    return out.withColumn("net", F.when(F.col("stopped"), F.lit(0.0)).otherwise(F.col("net")))


def equal_weight_returns(panel: DataFrame) -> DataFrame:
    return with_returns(panel).groupBy("ts", "pos").agg(F.avg("ret").alias("net"))


def buy_and_hold_returns(panel: DataFrame) -> DataFrame:
    """Weights in proportion to the wealth of one unit put into each asset."""
    df = with_returns(panel).withColumn("__wealth", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(running(along())))
    df = df.withColumn("weight", F.try_divide(F.col("__wealth"), F.sum("__wealth").over(across())))
    df = df.withColumn("__g", lag(F.col("weight"), 1, along()) * F.col("ret"))
    return df.groupBy("ts", "pos").agg(total(F.col("__g")).alias("net"))


def inverse_vol_returns(panel: DataFrame, lookback: int = 20) -> DataFrame:
    df = with_returns(panel).withColumn("__i", 1 / (rolling_std(F.col("ret"), lookback, along()) + 1e-8))
    df = df.withColumn("weight", F.coalesce(F.try_divide(F.col("__i"), F.sum("__i").over(across())), F.lit(0.0)))
    df = df.withColumn("__g", lag(F.col("weight"), 1, along()) * F.col("ret"))
    return df.groupBy("ts", "pos").agg(total(F.col("__g")).alias("net"))


def monthly_returns(daily: DataFrame, net: str = "net") -> DataFrame:
    """year, month, ret: compounded."""
    return daily.groupBy(F.year("ts").alias("year"), F.month("ts").alias("month")).agg((F.product(1 + F.col(net)) - 1).alias("ret"))


def monthly_table(daily: DataFrame, net: str = "net") -> DataFrame:
    """A row per year and a column per month, by the months' own dates."""
    wide = monthly_returns(daily, net).groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("ret"))
    return wide.select("year", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])


def rolling_sharpe(daily: DataFrame, n: int = 63, net: str = "net") -> DataFrame:
    w = Window.orderBy("pos")
    frame = w.rowsBetween(-(n - 1), 0)
    spread = rolling_std(F.col(net), n, w)
    return daily.withColumn("sharpe", F.try_divide(F.avg(net).over(frame), spread) * F.sqrt(F.lit(252.0)))
