"""Price sources: generated, CSV, a market data source, and the choice between them."""

from __future__ import annotations

import datetime
import inspect
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelloom.sources.panels import wide_to_long


# Lists of tickers by name.
UNIVERSES = {
    "faang": ["AAPL", "AMZN", "GOOGL", "META", "NFLX"],
    "mag7": ["AAPL", "AMZN", "GOOGL", "META", "MSFT", "NVDA", "TSLA"],
    "sp500_top10": ["AAPL", "MSFT", "AMZN", "NVDA", "GOOGL", "META", "BRK-B", "LLY", "AVGO", "JPM"],
    "sectors_etf": ["XLK", "XLF", "XLV", "XLE", "XLI", "XLY", "XLP", "XLU", "XLRE", "XLB", "XLC"],
}


def synthetic_prices(spark: SparkSession, n_names: int = 20, n_days: int = 750, seed: int = 42, annual_drift: float = 0.05, annual_vol: float = 0.2, start_price: float = 100.0, end: str = "2024-12-31") -> DataFrame:
    """Geometric Brownian motion from a seeded generator, on business days up to ``end``; small, for trials."""
    if n_names < 1 or n_days < 1:
        raise ValueError("n_names and n_days must be at least 1")
    step = 1 / 252
    z = np.random.default_rng(seed).standard_normal((n_days, n_names))
    prices = start_price * np.exp(np.cumsum((annual_drift - annual_vol**2 / 2) * step + annual_vol * np.sqrt(step) * z, axis=0))
    days = pd.bdate_range(end=end, periods=n_days).strftime("%Y-%m-%d")
    rows = [(f"SYM{k:03d}", d, p, float(np.round(v, 4))) for p, (d, own) in enumerate(zip(days, prices, strict=True)) for k, v in enumerate(own)]
    return spark.createDataFrame(rows, "asset string, ts string, pos long, price double").withColumn("ts", F.to_date("ts"))


def synthetic_prices_at_scale(spark: SparkSession, n_names: int, n_days: int, seed: int = 42, annual_drift: float = 0.05, annual_vol: float = 0.2, start_price: float = 100.0) -> DataFrame:
    """The same process drawn in tasks, one group per asset; dates are consecutive days."""
    step = 1 / 252
    days = spark.range(n_names).withColumnRenamed("id", "name").select("name", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))).alias("pos")).withColumn("pos", F.col("pos").cast("long"))
    u = [(F.pmod(F.xxhash64("name", "pos", F.lit(seed + k)), F.lit(2**52)).cast("double") + 0.5) / float(2**52) for k in (0, 1)]
    normal = F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * np.pi * u[1])
    days = days.withColumn("__r", (annual_drift - annual_vol**2 / 2) * step + annual_vol * float(np.sqrt(step)) * normal)
    path = F.exp(F.sum("__r").over(Window.partitionBy("name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return days.select(F.concat(F.lit("SYM"), F.lpad(F.col("name").cast("string"), 6, "0")).alias("asset"), F.date_add(F.lit("2000-01-03").cast("date"), F.col("pos").cast("int")).alias("ts"), "pos", F.round(path * start_price, 4).alias("price"))


def csv_prices(spark: SparkSession, path: str, date: str = "Date") -> DataFrame:
    """A wide CSV, a date column and a numeric column per asset, as a long panel."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    if date not in wide.columns:
        raise ValueError(f"no column {date!r} in {path}")
    return wide_to_long(wide.withColumn(date, F.to_date(date)), date)


#: Columns of a feed that hold the price, the first that it has counts.
CLOSES = ("Adj Close", "Close")


def _day(value) -> datetime.date | None:
    """The day of a date, a time or text; None for None."""
    if value is None or isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return value
    return value.date() if isinstance(value, datetime.datetime) else datetime.date.fromisoformat(str(value)[:10])


class MarketReader(DataSourceReader):
    """Prices of tickers from ``fetch(ticker, start, end)`` or ``fetch(ticker, start, end, interval)``.

    start is inclusive, end is not, both ISO text or None.  A feed gives (time, price) pairs, or mappings with
    "Date" and price columns, of which the first of CLOSES that the answer has is taken.  The range comes by options: a
    reader that took filters would keep those of one query for the next on the same DataFrame, as Spark 4.1 shares
    it between them.  A partition is a ticker in a year, so a long history of one
    ticker is many tasks (whole tickers where a bar is longer than a day and may cross the year's end); its rows go to
    Spark as Arrow batches.
    """

    def __init__(self, options: dict, fetch: Callable | None = None):
        self.fetch = fetch
        self.tickers = [t for t in options.get("tickers", "").split(",") if t]
        self.start, self.end, self.interval = _day(options.get("start")), _day(options.get("end")), options.get("interval", "1d")

    def partitions(self) -> list[InputPartition]:
        cuts = [self.start, self.end]
        if self.start and self.end and self.start >= self.end:
            return []
        if self.start and self.end and (self.interval == "1d" or intraday(self.interval)):
            cuts = [self.start, *(d for y in range(self.start.year + 1, self.end.year + 1) if (d := datetime.date(y, 1, 1)) < self.end), self.end]
        return [InputPartition((t, *(None if c is None else c.isoformat() for c in span))) for t in self.tickers for span in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if self.fetch is None:
            raise RuntimeError("no market feed is installed; give fetch(ticker, start, end)")
        ticker, start, end = partition.value
        takes = len(inspect.signature(self.fetch).parameters)
        rows = list(self.fetch(*(ticker, start, end, self.interval)[:takes]))
        if rows and isinstance(rows[0], dict):
            close = next((c for c in CLOSES if any(r.get(c) is not None for r in rows)), None)
            if close is None:
                raise ValueError(f"the feed has none of {CLOSES}: {sorted(rows[0])}")
            rows = [(r["Date"], r.get(close)) for r in rows]
        time = pa.timestamp("us", "UTC") if intraday(self.interval) else pa.date32()
        clean = [(t if intraday(self.interval) else _day(t), None if p is None or math.isnan(p) else float(p)) for t, p in rows]
        for k in range(0, len(clean), 10_000):
            part = clean[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([ticker] * len(part)), pa.array([t for t, _ in part], time), pa.array([p for _, p in part], pa.float64())], names=["asset", "ts", "price"])


def intraday(interval: str) -> bool:
    """Whether an interval such as 5m or 1h is shorter than a day; 1d, 1wk and 1mo are not."""
    return re.fullmatch(r"\d+[mh]", interval) is not None


class MarketSource(DataSource):
    """``spark.read.format("market").option("tickers", "A,B")``: asset, ts, price; options start, end and interval."""

    @classmethod
    def name(cls) -> str:
        return "market"

    def schema(self) -> str:
        return f"asset string, ts {'timestamp' if intraday(self.options.get('interval', '1d')) else 'date'}, price double"

    def reader(self, schema) -> MarketReader:
        return MarketReader(self.options)


def market_source(fetch: Callable | None = None) -> type[DataSource]:
    """The source with a feed; a class made here is sent to the workers together with ``fetch``."""

    class Fed(MarketSource):
        def reader(self, schema) -> MarketReader:
            return MarketReader(self.options, fetch)

    return Fed


def market_rows(spark: SparkSession, tickers: list[str], start: str | None = None, end: str | None = None, interval: str = "1d", fetch: Callable | None = None) -> DataFrame:
    """(asset, ts, price) as the feed gives them, from ``start`` up to but without ``end``."""
    if not tickers:
        raise ValueError("no tickers")
    spark.dataSource.register(market_source(fetch))
    options = {"tickers": ",".join(tickers), "start": start, "end": end, "interval": interval}
    return spark.read.format("market").options(**{k: v for k, v in options.items() if v is not None}).load()


def market_prices(spark: SparkSession, tickers: list[str], start: str | None = None, end: str | None = None, drop_gaps: bool = True, fetch: Callable | None = None, interval: str = "1d") -> DataFrame:
    """Adjusted closes by the feed ``fetch`` as a dense panel; dates on which an asset has no price drop out."""
    from panelloom.sources.panels import dense_panel

    rows = market_rows(spark, tickers, start, end, interval, fetch)
    panel = dense_panel(rows, F.col("asset"), F.col("ts"), F.col("price"))
    if not drop_gaps:
        return panel
    full = panel.groupBy("ts").agg(F.count_if(F.col("price").isNull()).alias("gaps")).filter("gaps = 0").select("ts")
    return panel.join(full, "ts", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("asset").orderBy("ts")).cast("long") - 1)


def load_prices(spark: SparkSession, csv: str | None = None, tickers: list[str] | None = None, start: str = "2018-01-01", end: str = "2023-12-31", fetch: Callable | None = None, **synthetic) -> DataFrame:
    """CSV before tickers before generated prices."""
    if csv:
        return csv_prices(spark, csv)
    if tickers:
        return market_prices(spark, tickers, start, end, fetch=fetch)
    return synthetic_prices(spark, **synthetic)
