"""Scores to weights, date by date: rank and L1 normalisation, z-scores, leverage, rebalancing."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import TINY, across, along, running


#: Dates that :func:`date_blocks` keeps together; each block has one more, of the block before it.
BLOCK = 8


class Rebalance(str, Enum):
    DAILY = "daily"
    WEEKLY = "weekly"
    MONTHLY = "monthly"


def rank_weights(scored: DataFrame, max_gross: float = 1.0, *keys: str) -> DataFrame:
    """Average ranks less their mean, scaled to gross ``max_gross``; ties share a rank, NULL scores get 0.

    Scores are compared at 12 places, so that the order of summation upstream cannot reorder near ties.
    """
    df = scored.withColumn("__s", F.round("score", 12))
    df = df.withColumn("__known", F.col("__s").isNotNull())  # a column, so that one sort serves all windows here
    group = Window.partitionBy(*keys, "pos", "__known")
    tied = F.count(F.lit(1)).over(group.orderBy("__s").rangeBetween(Window.currentRow, Window.currentRow))
    rank = F.when(F.col("__known"), F.rank().over(group.orderBy("__s")) + (tied - 1) / 2)
    df = df.withColumn("__r", rank).withColumn("__c", F.col("__r") - F.avg("__r").over(group))
    gross = F.nullif(F.sum(F.abs("__c")).over(group), F.lit(0.0))
    return df.withColumn("weight", F.coalesce(F.col("__c") / gross, F.lit(0.0)) * max_gross).drop("__s", "__known", "__r", "__c")


def zscores(scored: DataFrame, name: str = "score", to: str | None = None, *keys: str) -> DataFrame:
    """Score less the date's mean over its sample deviation; 0 without a score or spread."""
    w = across(*keys)
    spread = F.stddev_samp(name).over(w)
    z = F.try_divide(F.col(name) - F.avg(name).over(w), F.when(spread > TINY, spread))
    return scored.withColumn(to or name, F.coalesce(z, F.lit(0.0)))


def l1_weights(scored: DataFrame, max_gross: float = 1.0, *keys: str) -> DataFrame:
    """Scores over their absolute sum; sums below 1e-12, as left by cancelling scores, count as 0."""
    gross = F.sum(F.abs("score")).over(across(*keys))
    return scored.withColumn("weight", F.coalesce(F.col("score") / F.when(gross > TINY, gross), F.lit(0.0)) * max_gross)


def enforce_leverage(weighted: DataFrame, max_leverage: float, *keys: str) -> DataFrame:
    if max_leverage <= 0:
        raise ValueError("max_leverage must be positive")
    gross = F.sum(F.abs("weight")).over(across(*keys))
    scale = F.coalesce(F.least(F.try_divide(F.lit(float(max_leverage)), gross), F.lit(1.0)), F.lit(0.0))
    return weighted.withColumn("weight", F.col("weight") * F.when(gross > 0, scale).otherwise(F.lit(0.0)))


def rebalance(weighted: DataFrame, frequency: Rebalance | str = Rebalance.DAILY, *keys: str) -> DataFrame:
    """Weights change on Mondays or on the first of a month only and are carried between; 0 before the first."""
    frequency = Rebalance(frequency)
    if frequency is Rebalance.DAILY:
        return weighted
    due = F.weekday("ts") == 0 if frequency is Rebalance.WEEKLY else F.dayofmonth("ts") == 1
    held = F.last(F.when(due, F.col("weight")), ignorenulls=True).over(running(along(*keys)))
    return weighted.withColumn("weight", F.coalesce(held, F.lit(0.0)))


def construct(scored: DataFrame, max_gross: float = 1.0, max_leverage: float | None = None, frequency: Rebalance | str = Rebalance.DAILY, *keys: str) -> DataFrame:
    weighted = rank_weights(scored, max_gross, *keys)
    if max_leverage is not None:
        weighted = enforce_leverage(weighted, max_leverage, *keys)
    return rebalance(weighted, frequency, *keys)


def date_blocks(scored: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows dealt out by ``__block``, ``size`` dates each, the date before a block's first one included.

    With ``__block`` as a key, steps across the assets of a date and steps from a date to the next need no
    shuffle but this one.  :func:`own_dates` leaves out the repeated dates.
    """
    block, following = F.floor(F.col("pos") / size), F.floor((F.col("pos") + 1) / size)
    blocks = F.when(following > block, F.array(block, following)).otherwise(F.array(block))
    return scored.withColumn("__block", F.explode(blocks)).repartition("__block")


def own_dates(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    return blocks.filter(F.floor(F.col("pos") / size) == F.col("__block")).drop("__block")
