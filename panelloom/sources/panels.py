"""Dense panels from tables of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import across, along, change, forward_fill, rolling

SMOOTH = 28


def dense_panel(rows: DataFrame, asset: Column, ts: Column, value: Column, tasks: int | None = None) -> DataFrame:
    """asset, ts, pos, price: the mean value of each cell, NULL where an asset has none on a date.

    Every asset has a row for every date, so that lags by row are lags by date; the calendar, which does not grow
    with the assets, is broadcast.  Only the cells that there are get shuffled, to their assets: each then fills the
    dates up to its asset's next cell, and the panel stays dealt out by asset for the windows along it.  ``tasks``
    fixes their number for wide panels, as adaptive execution would judge it by the cells, which are far fewer.
    """
    cells = rows.groupBy(asset.alias("asset"), ts.alias("ts")).agg(F.avg(value).alias("price"))
    dates = rows.select(ts.alias("ts")).distinct()
    dates = dates.select("ts", F.row_number().over(Window.orderBy("ts")).cast("long").alias("pos")).withColumn("pos", F.col("pos") - 1)
    placed = dates.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy())).withColumnRenamed("ts", "__ts")
    cells = cells.join(F.broadcast(placed), F.col("ts").eqNullSafe(F.col("__ts")))
    cells = cells.repartition(tasks, "asset") if tasks else cells
    first = F.when(F.lag("pos").over(along()).isNull(), F.lit(0).cast("long")).otherwise(F.col("pos"))
    after = F.coalesce(F.lead("pos").over(along()), F.col("__n"))
    known = F.when(F.col("asset").isNotNull() & F.col("ts").isNotNull(), F.col("price"))  # no cell of an unknown asset or date is a price
    spans = cells.select("asset", F.col("pos").alias("__at"), known.alias("__price"), first.alias("__first"), after.alias("__after"))
    spine = spans.select("asset", "__at", "__price", F.explode(F.sequence(F.col("__first"), F.col("__after") - 1)).alias("pos"))
    price = F.when(F.col("pos") == F.col("__at"), F.col("__price")).alias("price")
    return spine.join(F.broadcast(dates), "pos").select("asset", "ts", "pos", price)


def smoothed(panel: DataFrame, rows: int = SMOOTH) -> DataFrame:
    """Prices carried forward, then averaged over the last ``rows`` dates."""
    filled = panel.withColumn("price", forward_fill(F.col("price"), along()))
    return filled.withColumn("price", rolling(F.avg, F.col("price"), rows, along(), least=1))


def wide_to_long(wide: DataFrame, date: str) -> DataFrame:
    """Columns of prices by asset to a dense long panel."""
    numeric = [c for c, t in wide.dtypes if c != date and t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    if not numeric:
        raise ValueError("no numeric price column")
    long = wide.select(F.col(date).alias("ts"), *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric]).unpivot("ts", numeric, "asset", "price")
    long = long.withColumn("price", F.nullif(F.col("price"), F.lit(float("nan"))))
    dates = long.select("ts").distinct().withColumn("pos", F.row_number().over(Window.orderBy("ts")).cast("long") - 1)
    return long.join(dates, "ts").select("asset", "ts", "pos", "price")


def long_to_wide(panel: DataFrame, value: str = "price", assets: list[str] | None = None) -> DataFrame:
    return panel.groupBy("ts").pivot("asset", assets).agg(F.first(value)).orderBy("ts")


def with_returns(panel: DataFrame, n: int = 1, *keys: str) -> DataFrame:
    """Adds ret, on prices carried forward."""
    filled = forward_fill(F.col("price"), along(*keys))
    return panel.withColumn("price", filled).withColumn("ret", change(F.col("price"), n, along(*keys)))


def clean(panel: DataFrame, most_missing: float = 0.1) -> DataFrame:
    """Without assets that lack more than a share of dates, then only dates that all the rest have; pos anew."""
    kept = panel.groupBy("asset").agg(F.avg(F.col("price").isNull().cast("double")).alias("share")).filter(F.col("share") <= most_missing)
    rest = panel.join(kept.select("asset"), "asset", "left_semi")
    full = rest.withColumn("__gaps", F.sum(F.col("price").isNull().cast("int")).over(across())).filter("__gaps = 0").drop("__gaps")
    return full.withColumn("pos", F.dense_rank().over(Window.partitionBy("asset").orderBy("pos")).cast("long") - 1)


def missing_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("asset").agg(F.sum(F.col("price").isNull().cast("long")).alias("missing"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def clipped_panel(panel: DataFrame, start, end, warmup: int) -> DataFrame:
    """Dates from ``start`` to ``end`` and ``warmup`` dates before: a filter for signals of bounded memory."""
    at = panel.filter(F.col("ts") >= F.lit(start)).agg(F.min("pos").alias("first"))
    return panel.crossJoin(F.broadcast(at)).filter((F.col("pos") >= F.col("first") - warmup) & (F.col("ts") <= F.lit(end))).drop("first")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "lineitem")
    return dense_panel(t, F.concat("l_returnflag", "l_linestatus"), F.to_date("l_shipdate"), F.col("l_extendedprice"))


def line_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "lineitem")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dense_panel(t, F.col("l_suppkey").cast("string"), F.to_date("l_shipdate"), F.col("l_extendedprice"), tasks)


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_panel(_read(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.to_date("o_orderdate"), F.col("o_totalprice"))


def orders_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_panel(_read(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.to_date(F.date_trunc("week", "o_orderdate")), F.col("o_totalprice"))


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_panel(_read(spark, sf_dir, "events"), F.col("event_type"), F.to_date("ts"), F.col("value"))


def line_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothed(line_daily(spark, sf_dir))


def orders_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothed(orders_daily(spark, sf_dir))


def supplier_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothed(line_supplier(spark, sf_dir))
