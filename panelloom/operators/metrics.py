"""Performance measures of a daily return series, and inference on its Sharpe ratio.

Four summaries differ on purpose in the base of the growth rate, hit rate and zero guards; each has its
own name.  All take rows (pos, net[, turnover]) and extra ``keys`` and give one row per key.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import block_sums
from panelloom.operators.simulate import with_equity
from panelloom.session import ship

EULER = 0.5772156649015329
SPREAD_FLOOR = 1e-12


def _parts(daily: DataFrame, *keys: str) -> DataFrame:
    """The sums that all summaries draw on."""
    df = with_equity(daily, "net", *keys)
    has = "turnover" in daily.columns
    spread = F.stddev_samp("net")
    aggs = [
        F.count("net").alias("n"), F.avg("net").alias("mean"), F.when(spread > SPREAD_FLOOR, spread).otherwise(F.lit(0.0) * spread).alias("sd"),
        F.max_by("equity", "pos").alias("last"), F.min_by("equity", "pos").alias("first"), F.min("drawdown").alias("max_dd"),
        F.count_if(F.col("net") > 0).alias("wins"), F.count_if(F.col("net") < 0).alias("losses"),
        F.avg(F.when(F.col("net") > 0, F.col("net"))).alias("avg_win"), F.avg(F.when(F.col("net") < 0, F.col("net"))).alias("avg_loss"),
        (F.avg("turnover") if has else F.lit(None).cast("double")).alias("turnover"),
    ]
    return df.groupBy(*keys).agg(*aggs)


def _sharpe(year: float, guard: Column | None = None) -> Column:
    return F.coalesce(F.try_divide(F.col("mean"), F.when(F.col("sd") > 0, F.col("sd"))) * math.sqrt(year), F.lit(0.0))


def _growth(base: Column, year: float) -> Column:
    return F.pow(base, F.lit(float(year)) / F.col("n")) - 1


def _calmar(cagr: Column, otherwise: Column) -> Column:
    return F.when(F.col("max_dd") != 0, cagr / F.abs("max_dd")).otherwise(otherwise)


def backtest_summary(daily: DataFrame, *keys: str) -> DataFrame:
    p = _parts(daily, *keys)
    cagr = F.when(F.col("last") > 0, _growth(F.col("last"), 252)).otherwise(F.lit(-1.0))
    hit = F.coalesce(F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")), F.lit(0.0))
    ratio = F.coalesce(F.abs(F.try_divide(F.coalesce("avg_win", F.lit(0.0)), F.col("avg_loss"))), F.lit(0.0))
    return p.select(
        *keys, F.col("n").alias("days"), cagr.alias("cagr"), (F.col("sd") * math.sqrt(252)).alias("ann_vol"), _sharpe(252).alias("sharpe"),
        "max_dd", _calmar(cagr, F.lit(0.0)).alias("calmar"), hit.alias("hit_rate"), ratio.alias("win_loss_ratio"), F.col("turnover").alias("turnover_daily"),
    )


def blend_summary(daily: DataFrame, *keys: str) -> DataFrame:
    """Growth from the first equity, hit rate over all days, missing losses as 1, NULL where undefined."""
    p = _parts(daily, *keys)
    base = F.try_divide(F.col("last"), F.col("first"))
    cagr = F.when(base > 0, _growth(base, 252))
    ratio = F.coalesce("avg_win", F.lit(0.0)) / F.coalesce(F.abs("avg_loss"), F.lit(1.0))
    return p.select(
        *keys, F.col("n").alias("days"), cagr.alias("cagr"), (F.col("sd") * math.sqrt(252)).alias("ann_vol"), _sharpe(252).alias("sharpe"),
        "max_dd", _calmar(cagr, F.lit(None)).alias("calmar"), (F.col("wins") / F.col("n")).alias("hit_rate"), ratio.alias("win_loss_ratio"), F.col("turnover").alias("turnover_daily"),
    )


def walk_forward_summary(daily: DataFrame, *keys: str) -> DataFrame:
    p = _parts(daily, *keys)
    cagr = F.when(F.col("last") > 0, _growth(F.col("last"), 252))
    return p.select(
        *keys, F.col("n").alias("oos_days"), cagr.alias("oos_cagr"), (F.col("sd") * math.sqrt(252)).alias("oos_ann_vol"), _sharpe(252).alias("oos_sharpe"),
        F.col("max_dd").alias("oos_max_dd"), _calmar(cagr, F.lit(None)).alias("oos_calmar"),
    )


def fold_summary(daily: DataFrame, periods: int = 252, *keys: str) -> DataFrame:
    """As :func:`backtest_summary`, on the non-NULL returns, with average win and loss."""
    p = _parts(daily.filter(F.col("net").isNotNull()), *keys)
    cagr = F.when(F.col("last") > 0, _growth(F.col("last"), periods)).otherwise(F.lit(-1.0))
    zero = F.lit(0.0)
    return p.select(
        *keys, F.col("n").alias("n_days"), cagr.alias("cagr"), (F.col("sd") * math.sqrt(periods)).alias("ann_vol"), _sharpe(periods).alias("sharpe"),
        F.col("max_dd").alias("max_drawdown"), _calmar(cagr, zero).alias("calmar"), F.coalesce(F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")), zero).alias("hit_rate"),
        F.coalesce("avg_win", zero).alias("avg_win"), F.coalesce("avg_loss", zero).alias("avg_loss"),
        F.coalesce(F.abs(F.try_divide(F.coalesce("avg_win", zero), F.col("avg_loss"))), zero).alias("win_loss_ratio"), "turnover",
    )


def passive_summary(daily: DataFrame, periods: int = 252, *keys: str) -> DataFrame:
    """Of the non-NULL returns of a passive portfolio, rounded half to even to 6 places, ratios to 4; NULL below two returns."""
    p = _parts(daily.filter(F.col("net").isNotNull()), *keys)
    cagr = F.when(F.col("last") > 0, _growth(F.col("last"), periods)).otherwise(F.lit(-1.0))
    columns = {
        "cagr": (cagr, 6), "ann_vol": (F.col("sd") * math.sqrt(periods), 6), "sharpe": (_sharpe(periods), 4),
        "max_dd": (F.col("max_dd"), 6), "calmar": (_calmar(cagr, F.lit(0.0)), 4),
    }
    return p.select(*keys, *[F.when(F.col("n") >= 2, F.bround(c, k)).alias(name) for name, (c, k) in columns.items()], F.col("n").alias("n_days"))


def annual_sharpe(daily: DataFrame, periods: int = 252, *keys: str) -> DataFrame:
    return _parts(daily, *keys).select(*keys, _sharpe(periods).alias("sharpe"))


def newey_west(daily: DataFrame, lags: int | None = None) -> DataFrame:
    """t statistic of the mean with Bartlett weights; one row (n, mean, lags, variance, t).

    Dates without a return drop out first, so lags count the returns that are there.  By default there are
    0.75 times the cube root of n of them.  t is NULL for fewer than two returns, and infinite where the
    weighted variance is not positive.
    """
    series = daily.filter("net is not null").select("pos", "net")
    if lags is None:
        lags = int(0.75 * series.count() ** (1 / 3))
    e = F.col("net") - F.avg("net").over(Window.partitionBy())
    order = Window.orderBy("pos")
    centred = series.withColumn("e", e)
    products = centred.select("net", *[(F.col("e") * (F.lag("e", k).over(order) if k else F.col("e"))).alias(f"p{k}") for k in range(lags + 1)])
    sums = products.agg(F.count("net").alias("n"), F.avg("net").alias("mean"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(lags + 1)])
    weighted = sum((F.lit(2 * (1 - k / (lags + 1))) * F.col(f"s{k}") for k in range(1, lags + 1)), F.col("s0"))
    out = sums.select("n", "mean", F.lit(lags).alias("lags"), F.try_divide(weighted, F.col("n")).alias("variance"))
    t = F.when(F.col("variance") > 0, F.col("mean") / F.sqrt(F.col("variance") / F.col("n"))).otherwise(F.lit(float("inf")))
    return out.withColumn("t", F.when(F.col("n") >= 2, t))


def bootstrap_blocks(spark: SparkSession, n: int, block: int | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(draw, start, size): the circular blocks of every resample of ``n`` places.

    A start is the checksum of seed, draw and place of the block, so it depends on nothing else: tasks make
    their own, in any order and again after a failure.  The last block is cut to fill n.
    """
    block = block or max(1, int(math.sqrt(n)))
    blocks = -(-n // block)
    ids = spark.range(draws * blocks).select(F.floor(F.col("id") / blocks).alias("draw"), (F.col("id") % blocks).alias("i"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("i").cast("string"))
    start = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") % n
    return ids.select("draw", start.alias("start"), F.least(F.lit(block), n - F.col("i") * block).cast("long").alias("size"))


def _resampled_sharpe(numbered: DataFrame, blocks: DataFrame, n: int, mean: float, spread: float) -> DataFrame:
    """(draw, m): a block's sums are differences of two running sums, so a resample meets two places a block.

    The sums are of deviations from the mean and of their squares, so all n add up to nothing and to (n - 1) times
    the variance.
    """
    ends = F.col("start") + F.col("size")
    places = F.array(F.struct(F.col("start").alias("at"), F.lit(-1).alias("sign")), F.struct(F.when(ends > n, ends - n).otherwise(ends).alias("at"), F.lit(1).alias("sign")))
    met = blocks.select("draw", (ends > n).cast("long").alias("round"), F.explode(places).alias("p")).select("draw", "p.at", "p.sign", F.when(F.col("p.sign") > 0, F.col("round")).otherwise(0).alias("round"))
    sums = met.join(numbered.select("at", "s", "q"), "at", "left").groupBy("draw").agg(
        F.sum(F.col("sign") * F.coalesce("s", F.lit(0.0))).alias("s"), F.sum(F.col("sign") * F.coalesce("q", F.lit(0.0))).alias("q"), F.sum("round").alias("rounds")
    )
    sums = sums.withColumn("q", F.col("q") + F.col("rounds") * (n - 1) * spread**2)
    own = F.sqrt(F.greatest(F.try_divide(F.col("q") - F.col("s") * F.col("s") / n, F.lit(n - 1)), F.lit(0.0)))
    ratio = F.try_divide(mean + F.col("s") / n, F.when(own > SPREAD_FLOOR, own)) * math.sqrt(252)
    return sums.select("draw", F.coalesce(ratio, F.lit(0.0)).alias("m"))


def block_bootstrap(daily: DataFrame, metric: Column | None = None, level: float = 0.95, block: int | None = None, draws: int = 1000, seed: int = 42, function=None) -> DataFrame:
    """Percentile interval of a metric over circular block resamples: one row (low, high, draws).

    The metric is the annual Sharpe ratio, from running sums of returns and their squares.  Any other aggregate
    column over ``net`` (``metric``), or a Python function of an array (``function``, in Python workers), sees
    every resampled return.
    """
    rows = daily.filter(F.col("net").isNotNull())
    n, mean, spread = rows.agg(F.count("net"), F.avg("net"), F.stddev_samp("net")).first()
    if not n:
        raise ValueError("no returns to resample")
    blocks = bootstrap_blocks(daily.sparkSession, n, block, draws, seed)
    centred = rows.select("pos", "net", (F.col("net") - mean).alias("e"))
    numbered = block_sums(centred, {"at": F.lit(1).cast("long"), "s": F.col("e"), "q": F.col("e") * F.col("e")})
    if metric is None and function is None:
        each = _resampled_sharpe(numbered, blocks, n, mean, spread or 0.0)
    else:
        places = blocks.select("draw", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("o"))
        sample = places.select("draw", (F.col("o") % n + 1).alias("at")).join(numbered.select("at", "net"), "at")
        if function is not None:
            ship(daily.sparkSession)

            def measured(pdf: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"m": [float(function(pdf["net"].to_numpy()))]})

            each = sample.groupBy("draw").applyInPandas(measured, "m double")
        else:
            each = sample.groupBy("draw").agg(metric.alias("m"))
    tail = (1 - level) / 2
    return each.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"), F.count(F.lit(1)).alias("draws"))


def sharpe_moments(daily: DataFrame, *keys: str) -> DataFrame:
    """n, per-period Sharpe ratio, bias-corrected skewness and excess kurtosis."""
    m = daily.groupBy(*keys).agg(F.count("net").alias("n"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("sd"), F.skewness("net").alias("g1"), F.kurtosis("net").alias("g2"))
    n = F.col("n").cast("double")
    skew = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.col("g1")
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return m.select(*keys, "n", F.try_divide("mean", "sd").alias("sharpe"), skew.alias("skew"), kurt.alias("excess"))


# Coefficients of Hart's rational approximation of the normal distribution function.
_CDF_OVER = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_CDF_UNDER = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Coefficients of Acklam's rational approximation of its inverse, middle and tail.
_INV_OVER = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_INV_UNDER = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_TAIL_OVER = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_UNDER = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, to about 1e-14."""
    a = F.abs(x)
    near = _polynomial(a, _CDF_OVER) / _polynomial(a, _CDF_UNDER)
    far = 1 / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * math.sqrt(2 * math.pi))
    upper = F.exp(-a * a / 2) * F.when(a < 5 * math.sqrt(2), near).otherwise(far)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """The inverse of :func:`normal_cdf` inside (0, 1), to about 1e-14: an approximation, and one step of Halley's method."""
    low, q = 0.02425, p - 0.5
    middle = _polynomial(q * q, _INV_OVER) * q / _polynomial(q * q, _INV_UNDER)
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _polynomial(t, _TAIL_OVER) / _polynomial(t, _TAIL_UNDER)
    first = F.when(p < low, tail).when(p > 1 - low, -tail).otherwise(middle)

    def better(x: Column) -> Column:
        u = (normal_cdf(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
        return x - u / (1 + x * u / 2)

    return F.when((p > 0) & (p < 1), F.get(F.transform(F.array(first), better), F.lit(0)))  # a lambda's variable is computed once


def deflated_sharpe_table(daily: DataFrame, trials: Column | int, *keys: str, formula: str = "code") -> DataFrame:
    """(keys, n, sharpe, best, z, dsr) for many series at once, without a step on the driver.

    dsr is the probability that the Sharpe ratio exceeds ``best``, what the best of ``trials`` (a number, or a
    column of ``keys``) would reach by chance.  dsr and z are 0 for fewer than three returns, for returns without
    spread and where the variance of the ratio is not positive.
    """
    if isinstance(trials, int) and trials < 1:
        raise ValueError("trials must be at least 1")
    if formula not in ("code", "paper"):
        raise ValueError("formula must be 'code' or 'paper'")
    m = sharpe_moments(daily, *keys)
    k = (trials if isinstance(trials, Column) else F.lit(trials)).cast("double")
    best = F.when(k > 1, (1 - EULER) * normal_quantile(1 - 1 / k) + EULER * normal_quantile(1 - math.exp(-1) / k)).otherwise(0.0)
    spread = (F.coalesce("excess", F.lit(0.0)) + (2 if formula == "paper" else 0)) / 4
    variance = F.try_divide(1 - F.coalesce("skew", F.lit(0.0)) * F.col("sharpe") + spread * F.col("sharpe") * F.col("sharpe"), F.col("n") - 1)
    m = m.withColumns({"best": best, "variance": variance})
    known = (F.col("n") >= 3) & F.col("sharpe").isNotNull() & (F.col("variance") > 0)
    m = m.withColumn("z", F.when(known, F.col("sharpe") / F.sqrt("variance") - F.col("best")).otherwise(0.0))
    return m.select(*keys, "n", "sharpe", "best", "z", F.when(known, normal_cdf(F.col("z"))).otherwise(0.0).alias("dsr"))


def deflated_sharpe(daily: DataFrame, trials: int, formula: str = "code") -> dict[str, float]:
    """:func:`deflated_sharpe_table` of one series: its dsr and z.

    ``formula='code'`` divides the excess kurtosis by 4, ``'paper'`` the excess plus 2.
    """
    row = deflated_sharpe_table(daily, trials, formula=formula).first()
    return {"dsr": row.dsr, "z": row.z}


def expected_best(trials: int) -> float:
    """Expected greatest of ``trials`` standard normal draws; 0 for one."""
    if trials == 1:
        return 0.0
    inverse = NormalDist().inv_cdf
    return (1 - EULER) * inverse(1 - 1 / trials) + EULER * inverse(1 - math.exp(-1) / trials)
