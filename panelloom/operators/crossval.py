"""Event tables, purged k-fold and combinatorial purged cross-validation, as tables of folds."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_table(dates: DataFrame, horizon: int) -> DataFrame:
    """(eid, t0, t1) from dates (ts): each with the one ``horizon`` rows on; the last ``horizon`` drop out."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    w = Window.orderBy("ts")
    out = dates.select("ts").distinct().select(F.col("ts").alias("t0"), F.lead("ts", horizon).over(w).alias("t1"), (F.row_number().over(w) - 1).cast("long").alias("eid"))
    return out.filter("t1 is not null").select("eid", "t0", "t1")


def check_events(events: DataFrame) -> None:
    missing = {"t0", "t1"} - set(events.columns)
    if missing:
        raise KeyError(f"events lack {sorted(missing)}")
    if events.isEmpty():
        raise ValueError("events are empty")


def with_folds(events: DataFrame, n_splits: int) -> DataFrame:
    """Adds fold: contiguous runs of events, the first ones longer by one where it does not divide."""
    return events.withColumn("fold", F.ntile(n_splits).over(Window.orderBy("eid")) - 1)


def _purged(events: DataFrame, tests: DataFrame, embargo: float) -> DataFrame:
    """(split, eid, role) for ``tests`` (split, eid, t0, t1): training events meet no test interval.

    Per split the test set is one interval from its first start to its last end, widened on both sides by
    a share of the whole span.  Splits are few, so their bounds are broadcast.
    """
    span = events.agg((F.unix_seconds(F.max("t1").cast("timestamp")) - F.unix_seconds(F.min("t0").cast("timestamp"))).alias("span"))
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    bounds = tests.groupBy("split").agg(F.min(at("t0")).alias("low"), F.max(at("t1")).alias("high")).crossJoin(F.broadcast(span))
    bounds = bounds.select("split", (F.col("low") - F.col("span") * embargo).alias("low"), (F.col("high") + F.col("span") * embargo).alias("high"))
    spaced = events.crossJoin(F.broadcast(bounds))
    train = spaced.filter((at("t0") > F.col("high")) | (at("t1") < F.col("low"))).select("split", "eid", F.lit("train").alias("role"))
    return train.union(tests.select("split", "eid", F.lit("test").alias("role")))


@dataclass(frozen=True)
class PurgedKFold:
    n_splits: int = 5
    embargo_pct: float = 0.0

    def __post_init__(self):
        if self.n_splits < 2:
            raise ValueError("n_splits must be at least 2")
        if not 0 <= self.embargo_pct < 1:
            raise ValueError("embargo_pct must be in [0, 1)")

    def get_n_splits(self) -> int:
        return self.n_splits

    def split(self, events: DataFrame) -> DataFrame:
        """(split, eid, role), all folds in one plan."""
        tests = with_folds(events, self.n_splits).select(F.col("fold").alias("split"), "eid", "t0", "t1")
        return _purged(events, tests, self.embargo_pct)


def combinatorial_splits(events: DataFrame, n_splits: int = 5, test_folds: int = 1, embargo_pct: float = 0.0) -> DataFrame:
    """(split, eid, role) for every choice of ``test_folds`` folds, in lexicographic order."""
    if not 1 <= test_folds < n_splits:
        raise ValueError(f"test_folds must be in [1, {n_splits - 1}], got {test_folds}")
    choices = [(k, f) for k, c in enumerate(itertools.combinations(range(n_splits), test_folds)) for f in c]
    table = events.sparkSession.createDataFrame(choices, "split int, fold int")
    tests = with_folds(events, n_splits).join(F.broadcast(table), "fold").select("split", "eid", "t0", "t1")
    return _purged(events, tests, embargo_pct)


def fold_returns(daily: DataFrame, events: DataFrame, cv: PurgedKFold) -> DataFrame:
    """(split, pos, ts, net): the returns at the starts of each fold's test events."""
    tests = with_folds(events, cv.n_splits).select(F.col("fold").alias("split"), F.col("t0").alias("ts"))
    return daily.join(tests, "ts").select("split", "pos", "ts", "net")


def position_folds(daily: DataFrame, n_splits: int, horizon: int, *keys: str) -> DataFrame:
    """Rows of ``daily`` with split, the fold whose test event starts there, from positions alone.

    The same folds as :func:`fold_returns` gives for the events of a dense panel: dates are numbered without
    gaps, the last ``horizon`` start no event, and the first folds are longer by one where it does not divide.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    n = F.max("pos").over(Window.partitionBy(*keys)) + 1 - horizon
    df = daily.withColumn("__n", n).filter("pos < __n")
    size, longer = F.floor(F.col("__n") / n_splits), F.col("__n") % n_splits
    cut = longer * (size + 1)
    fold = F.when(F.col("pos") < cut, F.floor(F.col("pos") / (size + 1))).otherwise(longer + F.floor((F.col("pos") - cut) / F.greatest(size, F.lit(1))))
    return df.withColumn("split", fold.cast("int")).drop("__n")


def cv_summary(scores: DataFrame, name: str = "sharpe") -> DataFrame:
    """Mean, population deviation, median, least, greatest and number of fold scores."""
    return scores.agg(
        F.avg(name).alias("mean"), F.stddev_pop(name).alias("std"), F.median(name).alias("median"), F.min(name).alias("min"), F.max(name).alias("max"), F.count(name).alias("n_folds")
    )
