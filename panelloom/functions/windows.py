"""Rolling, recursive and cross-sectional column functions.

A panel is long: asset, ts, pos, price, where pos numbers the dates from 0 and every asset has a row for
every date.  ``keys`` are further partition columns (walk-forward window, weight combination), so that many
runs are one plan.  Missing values are NULL; results that pandas would call NaN are NULL too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-12


def along(*keys: str) -> WindowSpec:
    """Each asset in time."""
    return Window.partitionBy(*keys, "asset").orderBy("pos")


def across(*keys: str) -> WindowSpec:
    """All assets of a date."""
    return Window.partitionBy(*keys, "pos")


def through(*keys: str) -> WindowSpec:
    """A portfolio's days; one row per day, so a partition is as long as the calendar."""
    return Window.partitionBy(*keys).orderBy("pos")


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(fn, x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """``fn(x)`` over the last ``n`` rows, NULL until ``least`` (``n``) values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), fn(x).over(frame))


def rolling_cov(x: Column, y: Column, n: int, w: WindowSpec, least: int) -> Column:
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= least, F.covar_samp(x, y).over(frame))


def rolling_std(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """Sample deviation; what is below 1e-12 counts as 0, as windows of equal values leave a residue."""
    s = rolling(F.stddev_samp, x, n, w, least)
    return F.when(s < TINY, F.lit(0.0)).otherwise(s)


def lag(x: Column, n: int, w: WindowSpec) -> Column:
    return F.lag(x, n).over(w)


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(running(w))


def backward_fill(x: Column, w: WindowSpec) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def change(price: Column, n: int, w: WindowSpec) -> Column:
    """Return over ``n`` rows; NULL for a zero or missing base."""
    return F.try_divide(price, F.lag(price, n).over(w)) - 1


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds, NULL kept (``greatest`` and ``least`` would skip it)."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def total(x: Column) -> Column:
    """Sum that is 0 where there is nothing to add."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def decayed_sum(df: DataFrame, name: str, x: Column, q: float | Column, parts: list[str]) -> DataFrame:
    """Adds ``name``: sum over rows j up to k of q**(k-j) * x_j, NULL counting as 0, along ``pos``.

    Weights are scaled inside blocks so long that what lies before the previous block weighs under 1e-60;
    no block overflows, however long the series, and both sums are built-in window aggregates.  ``q`` may be
    a column that is one value in each of ``parts``, so that many decays are one plan.
    """
    q = q if isinstance(q, Column) else F.lit(q)
    block = F.greatest(F.lit(2), F.ceil(60 * math.log(10) / -F.ln(q)))
    series = Window.partitionBy(*parts).orderBy("pos")
    df = df.withColumn("__k", F.row_number().over(series) - 1).withColumn("__block", F.floor(F.col("__k") / block))
    inner = Window.partitionBy(*parts, "__block").orderBy("pos")
    at = (F.col("__k") - F.col("__block") * block).cast("double")
    scaled = F.coalesce(x, F.lit(0.0)) * F.pow(q, -at)
    df = df.withColumn("__in", F.sum(scaled).over(running(inner)) * F.pow(q, at))
    before = Window.partitionBy(*parts).orderBy("__block").rangeBetween(-1, -1)
    end = F.max(F.struct("__k", "__in")).over(before)["__in"]
    df = df.withColumn(name, F.col("__in") + F.coalesce(end * F.pow(q, at + 1), F.lit(0.0)))
    return df.drop("__k", "__block", "__in")


def ewm_mean(df: DataFrame, name: str, x: str, span: int | Column, parts: list[str]) -> DataFrame:
    """Exponential mean from the first value on: y = (1-a) y' + a x, a = 2 / (span + 1); series without gaps.

    ``span`` may be a column that is one value in each of ``parts``.
    """
    a = 2 / (span + 1)
    first = F.count(x).over(running(Window.partitionBy(*parts).orderBy("pos"))) == 1
    df = df.withColumn("__x", F.when(first, F.col(x)).otherwise(F.col(x) * a))
    df = decayed_sum(df, "__y", F.col("__x"), 1 - a, parts)
    return df.withColumn(name, F.when(F.count(x).over(running(Window.partitionBy(*parts).orderBy("pos"))) >= 1, F.col("__y"))).drop("__x", "__y")


def ewm_mean_halflife(df: DataFrame, name: str, x: str, halflife: float, parts: list[str]) -> DataFrame:
    """Exponential mean with weights that sum over the values present, decaying by place."""
    q = 0.5 ** (1 / halflife)
    df = decayed_sum(df, "__num", F.col(x), q, parts)
    df = decayed_sum(df, "__den", F.col(x).isNotNull().cast("double"), q, parts)
    return df.withColumn(name, F.when(F.col("__den") > 0, F.col("__num") / F.col("__den"))).drop("__num", "__den")


def ewm_std(df: DataFrame, name: str, x: str, span: int, parts: list[str]) -> DataFrame:
    """Bias-corrected exponential deviation, NULL for the first value; series without gaps.

    With the weights of :func:`ewm_mean`, the second central moment is divided by one minus the sum of
    squared weights, which has a closed form in the number of values.
    """
    a = 2 / (span + 1)
    q = 1 - a
    df = ewm_mean(df, "__m", x, span, parts)
    df = df.withColumn("__sq", F.col(x) * F.col(x))
    df = ewm_mean(df, "__m2", "__sq", span, parts)
    k = (F.count(x).over(running(Window.partitionBy(*parts).orderBy("pos"))) - 1).cast("double")
    squares = F.pow(F.lit(q), 2 * k) + a * a * (1 - F.pow(F.lit(q), 2 * k)) / (1 - q * q)
    variance = F.greatest(F.col("__m2") - F.col("__m") * F.col("__m"), F.lit(0.0)) / (1 - squares)
    return df.withColumn(name, F.when(k >= 1, F.sqrt(variance))).drop("__m", "__sq", "__m2")


def block_sums(df: DataFrame, sums: dict[str, Column], *keys: str, size: int = 65536) -> DataFrame:
    """Adds running sums along ``pos`` within ``keys``, by two levels: inside blocks of ``size`` positions, and over
    the blocks' totals, so that one long series is many tasks.  Only the totals, a row per block, meet in one."""
    df = df.withColumn("__block", F.floor(F.col("pos") / size))
    totals = df.groupBy(*keys, "__block").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__block", *[F.sum(n).over(before).alias(f"__{n}") for n in sums])
    inner = running(Window.partitionBy(*keys, "__block").orderBy("pos"))
    out = df.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()}).join(offsets, [*keys, "__block"])
    return out.withColumns({n: F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in sums}).drop("__block", *[f"__{n}" for n in sums])


def convolved(x: Column, kernel: list[float], w: WindowSpec) -> Column:
    """Causal filter: sum of kernel[j] * x[t-j]; NULL until the window is full or while it holds a NULL."""
    n = len(kernel)
    frame = w.rowsBetween(-(n - 1), 0)
    weights = F.array(*[F.lit(float(v)) for v in reversed(kernel)])
    dot = F.aggregate(F.zip_with(F.collect_list(x).over(frame), weights, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.count(x).over(frame) >= n, dot)
