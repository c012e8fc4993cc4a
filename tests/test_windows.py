import numpy as np
import pytest

from panelloom.functions.windows import along, clip, convolved, ewm_mean, ewm_mean_halflife, ewm_std, rolling, rolling_cov
from panelloom.sources.panels import clean, clipped_panel, missing_counts, smoothed, with_returns
from pyspark.sql import functions as F
from tests.panel_helpers import panel, same, walk, wide_of


@pytest.fixture(scope="module")
def prices():
    return walk()


def test_returns_and_rolling(spark, prices):
    df = with_returns(panel(spark, prices))
    r = prices.pct_change()
    same(wide_of(df, "ret"), r)
    df = df.withColumn("s", rolling(F.sum, F.col("ret"), 7, along())).withColumn("v", rolling(F.stddev_samp, F.col("ret"), 7, along(), 3))
    same(wide_of(df, "s"), r.rolling(7).sum())
    same(wide_of(df, "v"), r.rolling(7, min_periods=3).std())
    df = df.withColumn("c", rolling_cov(F.col("ret"), F.col("price"), 9, along(), 4))
    same(wide_of(df, "c"), prices.apply(lambda p: p.pct_change().rolling(9, min_periods=4).cov(p)))


@pytest.mark.parametrize("span", [3, 20])
def test_exponential_windows(spark, prices, span):
    df = with_returns(panel(spark, prices))
    r = prices.pct_change()
    same(wide_of(ewm_mean(df, "y", "ret", span, ["asset"]), "y"), r.ewm(span=span, adjust=False).mean())
    same(wide_of(ewm_std(df, "y", "ret", span, ["asset"]), "y"), r.ewm(span=span, adjust=False).std(), 1e-7)
    gappy = prices.copy()
    gappy.iloc[5:9, 1] = np.nan
    df = panel(spark, gappy)
    same(wide_of(ewm_mean_halflife(df, "y", "price", span, ["asset"]), "y"), gappy.ewm(halflife=span, min_periods=1).mean())


def test_long_series_do_not_overflow(spark):
    long = walk(2600, 1, 3)
    df = with_returns(panel(spark, long))
    same(wide_of(ewm_mean(df, "y", "ret", 2, ["asset"]), "y"), long.pct_change().ewm(span=2, adjust=False).mean())


def test_gaps_zero_prices_and_cleaning(spark):
    w = walk(30, 3)
    w.iloc[0:4, 0] = np.nan
    w.iloc[10, 1] = np.nan
    w.iloc[20, 2] = 0.0
    df = panel(spark, w)
    got = wide_of(with_returns(df), "ret")
    assert got.iloc[10, 1] == 0 and got.iloc[0:5, 0].isna().all() and np.isnan(got.iloc[21, 2])
    assert {r.asset: r.missing for r in missing_counts(df).collect()} == {"A0": 4, "A1": 1, "A2": 0}
    kept = clean(df, 0.1)
    assert {r.asset for r in kept.collect()} == {"A1", "A2"} and kept.count() == 58 and kept.agg(F.max("pos")).first()[0] == 28
    same(wide_of(smoothed(df, 5), "price"), w.ffill().rolling(5, min_periods=1).mean())
    part = clipped_panel(df, "2021-01-20", "2021-01-25", 3)
    assert part.select("pos").distinct().count() == 9


def test_clip_keeps_nulls_and_filter(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-9.0,)], "x double")
    assert [r.y for r in df.select(clip(F.col("x"), -2, 0.5).alias("y")).collect()] == [0.5, None, -2.0]
    w = walk(12, 1)
    got = wide_of(panel(spark, w).withColumn("y", convolved(F.col("price"), [1.0, -0.5, 0.25], along())), "y")
    same(got, w - 0.5 * w.shift(1) + 0.25 * w.shift(2))
