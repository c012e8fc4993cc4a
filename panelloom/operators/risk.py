"""The risk model: clip, smooth, weigh by inverse volatility, normalise, target a volatility."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.windows import across, along, clip, ewm_mean_halflife, lag, rolling_std
from panelloom.operators.portfolio import l1_weights

YEAR = 252


@dataclass(frozen=True)
class RiskConfig:
    clip_zscore: float = 2.0
    smooth_halflife: int = 5
    inverse_vol: bool = True
    vol_lookback: int = 20
    vol_target: float = 0.15
    vol_target_lookback: int = 63
    vol_floor: float = 0.01
    max_leverage: float = 2.0

    def to_dict(self) -> dict:
        return asdict(self)


def clip_scores(df: DataFrame, n_std: float) -> DataFrame:
    return df.withColumn("score", clip(F.col("score"), -n_std, n_std)) if n_std > 0 else df


def smooth_scores(df: DataFrame, halflife: float, *keys: str) -> DataFrame:
    return ewm_mean_halflife(df, "score", "score", halflife, [*keys, "asset"]) if halflife > 0 else df


def _annual(x, n: int, w, floor: float):
    return clip(rolling_std(x, n, w, max(n // 2, 2)) * F.sqrt(F.lit(float(YEAR))), low=floor)


def inverse_vol(df: DataFrame, lookback: int, floor: float, *keys: str) -> DataFrame:
    """Scores over each asset's annual volatility; 0 while that is unknown."""
    scaled = F.col("score") / _annual(F.col("ret"), lookback, along(*keys), floor)
    return df.withColumn("score", F.coalesce(scaled, F.lit(0.0)))


def vol_target(df: DataFrame, target: float, lookback: int, floor: float, max_leverage: float, *keys: str) -> DataFrame:
    """Weights times target over the portfolio's own volatility so far, at most ``max_leverage``.

    The portfolio's return is summed across each date and then followed along every asset, which in a dense
    panel has all dates, so nothing is joined back.  NULL weights until the volatility has half a lookback.
    """
    if target <= 0:
        return df
    rows = df.withColumn("__g", lag(F.col("weight"), 1, along(*keys)) * F.col("ret"))
    rows = rows.withColumn("__p", F.coalesce(F.sum("__g").over(across(*keys)), F.lit(0.0)))
    scale = F.try_divide(F.lit(float(target)), _annual(F.col("__p"), lookback, along(*keys), floor))
    return rows.withColumn("weight", F.col("weight") * clip(scale, high=max_leverage)).drop("__g", "__p")


def apply_risk(df: DataFrame, config: RiskConfig | None, max_gross: float = 1.0, *keys: str) -> DataFrame:
    """score to weight; without a config, L1 normalisation alone."""
    if config is None:
        return l1_weights(df, max_gross, *keys)
    df = smooth_scores(clip_scores(df, config.clip_zscore), config.smooth_halflife, *keys)
    if config.inverse_vol:
        df = inverse_vol(df, config.vol_lookback, config.vol_floor, *keys)
    df = l1_weights(df, max_gross, *keys)
    return vol_target(df, config.vol_target, config.vol_target_lookback, config.vol_floor, config.max_leverage, *keys)


__all__ = ["RiskConfig", "apply_risk", "clip_scores", "inverse_vol", "smooth_scores", "vol_target"]
