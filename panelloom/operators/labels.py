"""Triple-barrier labels, meta-labels, realised returns and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import along, backward_fill, change, ewm_std, lag, rolling, rolling_std
from panelloom.sources.panels import with_returns


def daily_volatility(panel: DataFrame, span: int = 100) -> DataFrame:
    """Adds ret and vol: exponential deviation of returns, its first value carried back."""
    df = ewm_std(with_returns(panel), "vol", "ret", span, ["asset"])
    return df.withColumn("vol", backward_fill(F.col("vol"), along()))


def barrier_events(panel: DataFrame, horizon: int, pt_sl: tuple[float, float] = (1.0, 1.0), span: int = 100) -> DataFrame:
    """(asset, pos, t0, p0, t1, p1, pt, sl): barriers around the price at t0, where volatility is positive.

    t1 is ``horizon`` dates on or the asset's last date.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    w, ends = along(), Window.partitionBy("asset").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = daily_volatility(panel, span).filter("price is not null")
    ahead = F.lead(F.struct("ts", "price", "pos"), horizon).over(w)
    df = df.withColumn("end", F.coalesce(ahead, F.last(F.struct("ts", "price", "pos")).over(ends)))
    up, down = F.col("price") * (1 + pt_sl[0] * F.col("vol")), F.col("price") * (1 - pt_sl[1] * F.col("vol"))
    path = F.collect_list(F.struct("ts", "price")).over(w.rowsBetween(0, horizon))
    df = df.withColumns({"pt": up, "sl": down, "path": path}).filter("vol > 0")
    return df.select("asset", "pos", F.col("ts").alias("t0"), F.col("price").alias("p0"), F.col("end.ts").alias("t1"), F.col("end.price").alias("p1"), "pt", "sl", "path")


def _label(up, down, p0, p1):
    moved = F.signum(p1 - p0).cast("int")
    first_up = up.isNotNull() & (down.isNull() | (up <= down))
    return F.when(first_up, F.lit(1)).when(down.isNotNull(), F.lit(-1)).otherwise(moved)


def triple_barrier(panel: DataFrame, horizon: int = 5, pt_sl: tuple[float, float] = (1.0, 1.0), span: int = 100) -> DataFrame:
    """(asset, pos, t0, t1, y, p0, p1): 1 or -1 for the barrier touched first, else the sign of the move.

    The path to the horizon is a window frame, so there is no join.
    """
    events = barrier_events(panel, horizon, pt_sl, span).filter("t0 < t1")
    up = F.get(F.filter("path", lambda e: e["price"] >= F.col("pt")), F.lit(0))["ts"]
    down = F.get(F.filter("path", lambda e: e["price"] <= F.col("sl")), F.lit(0))["ts"]
    return events.select("asset", "pos", "t0", "t1", _label(up, down, F.col("p0"), F.col("p1")).alias("y"), "p0", "p1")


def label_events(panel: DataFrame, events: DataFrame, bucket_days: float = 90) -> DataFrame:
    """(event_id, asset, t0, t1, y) for events (event_id, asset, t0, t1, pt, sl) of any span and number.

    An interval join over buckets of time.  Prices are summed up per (asset, bucket): greatest, least, first
    and last.  An event meets the sums of the buckets that lie inside its span, which tell the first of them
    that touches a barrier, and meets single prices in that one and in the buckets of its two ends only.  So
    an event costs its buckets and the prices of three of them, and an asset's rows spread over its buckets.

    Each event_id is labelled by itself.  y is 0 where t1 is not after t0, where no price lies in the span, or
    where the price ends where it began; 1 or -1 for the barrier touched first (the upper one on the same date), else
    the sign of the move.  Null prices and barriers touch nothing; an event with a null asset, t0 or t1 gets 0.
    """
    if bucket_days <= 0:
        raise ValueError("bucket_days must be positive")
    if "event_id" not in events.columns:
        raise KeyError("events lack event_id")
    width = float(bucket_days * 86400)
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    tick = F.struct("ts", "price")
    at = panel.filter("price is not null").select("asset", "ts", "price", bucket("ts").alias("bucket"))
    sums = at.groupBy("asset", "bucket").agg(F.max("price").alias("high"), F.min("price").alias("low"), F.min(tick).alias("head"), F.max(tick).alias("tail"))
    ev = events.select("event_id", "asset", "t0", "t1", "pt", "sl", bucket("t0").alias("b0"), bucket("t1").alias("b1"))
    inner = ev.filter("b1 - b0 > 1").select("event_id", "asset", "pt", "sl", F.explode(F.sequence(F.col("b0") + 1, F.col("b1") - 1)).alias("bucket"))
    touched = (F.col("high") >= F.col("pt")) | (F.col("low") <= F.col("sl"))
    inner = inner.join(sums, ["asset", "bucket"]).groupBy("event_id").agg(
        F.min(F.when(touched, F.col("bucket"))).alias("hit"), F.min("head").alias("head"), F.max("tail").alias("tail")
    )
    looked = F.array_compact(F.array_distinct(F.array("b0", "b1", "hit")))
    spans = ev.join(inner, "event_id", "left").withColumn("bucket", F.explode_outer(looked))
    inside = F.col("ts").between(F.col("t0"), F.col("t1")) & (F.col("t0") < F.col("t1"))
    met = spans.join(at, ["asset", "bucket"], "left").groupBy("event_id", "asset", "t0", "t1", "head", "tail").agg(
        F.min(F.when(inside & (F.col("price") >= F.col("pt")), F.col("ts"))).alias("up"), F.min(F.when(inside & (F.col("price") <= F.col("sl")), F.col("ts"))).alias("down"),
        F.min(F.when(inside, tick)).alias("first"), F.max(F.when(inside, tick)).alias("last"),
    )
    first, last = F.least("first", "head"), F.greatest("last", "tail")
    y = F.coalesce(_label(F.col("up"), F.col("down"), first["price"], last["price"]), F.lit(0))
    return met.select("event_id", "asset", "t0", "t1", y.alias("y"))


def realised(labels: DataFrame) -> DataFrame:
    """Adds realised: the return to the vertical barrier; NULL from a zero price."""
    return labels.withColumn("realised", F.try_divide(F.col("p1") - F.col("p0"), F.col("p0")))


def meta_labels(labels: DataFrame) -> DataFrame:
    """Adds meta: 1 where the label is not 0 and has the sign of the realised return."""
    df = realised(labels)
    hit = (F.col("y") != 0) & (F.signum("realised").cast("int") == F.col("y"))
    return df.withColumn("meta", F.coalesce(hit, F.lit(False)).cast("int"))


def build_features(panel: DataFrame, lookback: int = 20, span: int = 50) -> DataFrame:
    """(asset, pos, ts, momentum, volatility, mean_rev), each lagged by one date."""
    if lookback < 1 or span < 1:
        raise ValueError("lookback and span must be at least 1")
    w = along()
    df = ewm_std(with_returns(panel), "__vol", "ret", span, ["asset"])
    spread = rolling_std(F.col("price"), lookback, w)
    df = df.withColumns(
        {
            "__mom": change(F.col("price"), lookback, w),
            "__rev": F.try_divide(F.col("price") - rolling(F.avg, F.col("price"), lookback, w), F.when(spread > 0, spread)),
        }
    )
    return df.select("asset", "pos", "ts", *[lag(F.col(c), 1, w).alias(n) for c, n in (("__mom", "momentum"), ("__vol", "volatility"), ("__rev", "mean_rev"))])
