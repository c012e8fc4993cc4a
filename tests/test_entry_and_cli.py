import datetime
import json
import math
import os

import pytest

import __spark_entry__ as entry
from panelloom import cli
from panelloom.plans import backtest
from panelloom.queries import QUERIES, SQL
from panelloom.sources import loaders
from panelloom.sources.panels import long_to_wide
from tests.panel_helpers import panel, walk, wide_of, same

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")


def test_names_are_registered():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


@needs_tables
@pytest.mark.parametrize("name", ["panel_dense", "clean_sparse", "sig_momentum", "w_weekly", "missing_counts", "folds_kfold", "weight_grid", "label_events", "sweep_matrix"])
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    norm = lambda rows: sorted((tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows))
    assert norm(map(tuple, got.select(*columns).collect())) == norm(want)


def test_csv_and_generated_prices(spark, tmp_path):
    w = walk(20, 3).round(4)
    w.index.name = "Date"
    w.assign(note="x").to_csv(tmp_path / "p.csv")
    df = loaders.csv_prices(spark, str(tmp_path / "p.csv"))
    same(wide_of(df, "price"), w)
    assert long_to_wide(df).columns == ["ts", "A0", "A1", "A2"]
    with pytest.raises(ValueError):
        loaders.csv_prices(spark, str(tmp_path / "p.csv"), "Day")
    a = loaders.synthetic_prices(spark, 3, 40)
    assert a.count() == 120 and sorted(a.collect()) == sorted(loaders.load_prices(spark, n_names=3, n_days=40).collect())
    assert loaders.synthetic_prices_at_scale(spark, 4, 30).count() == 120
    with pytest.raises(ValueError):
        loaders.synthetic_prices(spark, 0)


def test_market_source(spark):
    with pytest.raises(Exception, match="no market feed"):
        loaders.market_prices(spark, ["A"], "2020-01-01", "2020-02-01").count()
    def fetch(ticker, start, end):
        import datetime

        first = datetime.date.fromisoformat(start)
        return [(first + datetime.timedelta(k), 10.0 * k) for k in range(3) if ticker == "A" or k != 1]

    rows = loaders.market_prices(spark, ["A", "B"], "2020-01-01", "2020-02-01", fetch=fetch).orderBy("asset", "pos").collect()  # one year, one call
    assert [(r.asset, str(r.ts), r.pos, r.price) for r in rows] == [(a, d, p, x) for a in "AB" for d, p, x in (("2020-01-01", 0, 0.0), ("2020-01-03", 1, 20.0))]
    assert set(loaders.UNIVERSES) == {"faang", "mag7", "sp500_top10", "sectors_etf"}


def test_market_reader_splits_years_and_prefers_adjusted_closes():
    asked = []

    def fetch(ticker, start, end, interval):
        asked.append((ticker, start, end, interval))
        return [{"Date": datetime.datetime(2021, 3, 1, 15), "Close": 5.0, "Adj Close": None if ticker == "B" else 4.0}, {"Date": "2021-03-02", "Close": float("nan"), "Adj Close": None}]

    reader = loaders.MarketReader({"tickers": "A,B", "start": "2020-06-01", "end": "2021-03-02"}, fetch)
    d, parts = datetime.date, reader.partitions()
    assert [p.value for p in parts] == [(t, *s) for t in "AB" for s in (("2020-06-01", "2021-01-01"), ("2021-01-01", "2021-03-02"))]
    got = [b.to_pylist() for p in parts for b in reader.read(p)]
    assert asked[0] == ("A", "2020-06-01", "2021-01-01", "1d") and len(asked) == 4
    assert got[0] == [{"asset": "A", "ts": d(2021, 3, 1), "price": 4.0}, {"asset": "A", "ts": d(2021, 3, 2), "price": None}]
    assert got[2][0]["price"] == 5.0 and got[2][1]["price"] is None
    assert loaders.MarketReader({"tickers": "A", "start": "2020-01-01", "end": "2022-01-01", "interval": "1wk"}, fetch).partitions()[0].value == ("A", "2020-01-01", "2022-01-01")
    assert loaders.MarketReader({"tickers": "A", "start": "2022-01-01", "end": "2022-01-01"}, fetch).partitions() == []
    assert loaders.intraday("5m") and loaders.intraday("1h") and not any(map(loaders.intraday, ("1d", "1wk", "1mo")))
    bad = loaders.MarketReader({"tickers": "A"}, lambda t, s, e: [{"Date": d(2020, 1, 1), "Open": 1.0}])
    with pytest.raises(ValueError, match="Open"):
        list(bad.read(bad.partitions()[0]))


def test_market_feed_through_spark(spark):
    def recorded(ticker, start, end):
        import datetime

        days = (datetime.date(2019, 12, 30) + datetime.timedelta(k) for k in range(900))
        return [{"Date": x, "Adj Close": float(x.toordinal())} for x in days if start <= x.isoformat() < end]

    rows = loaders.market_rows(spark, ["A", "B"], "2019-12-30", "2022-01-01", fetch=recorded)
    cut = rows.filter("ts >= '2020-12-30' and ts < '2021-01-03' and asset = 'B'")
    assert sorted((r.asset, r.ts.isoformat()) for r in cut.collect()) == [("B", d) for d in ("2020-12-30", "2020-12-31", "2021-01-01", "2021-01-02")]
    assert rows.count() == 2 * 733 and rows.rdd.getNumPartitions() == 6
    with pytest.raises(ValueError, match="no tickers"):
        loaders.market_rows(spark, [])


@pytest.mark.parametrize("command", [["run", "--rebalance", "weekly", "--max-drawdown", "0.2"], ["cv"], ["combined", "--no-risk"], ["sweep", "--lookbacks", "5", "10", "--grosses", "1"], ["passive"], ["fetch"]])
def test_commands(spark, tmp_path, capsys, command):
    cli.main([*command, "--names", "4", "--days", "90", "--output-dir", str(tmp_path)])
    assert json.loads(capsys.readouterr().out)
    assert any(tmp_path.rglob("*.json")) and (command[0] in ("cv", "passive") or any(tmp_path.rglob("*.csv")))


def test_walk_forward_and_example_commands(spark, tmp_path, capsys):
    cli.main(["combined", "--mode", "walk_forward", "--signals", "momentum", "volatility", "--train-days", "60", "--test-days", "30", "--step-days", "30", "--weight-step", "0.5", "--no-risk", "--names", "4", "--days", "120", "--output-dir", str(tmp_path)])
    windows = json.loads(capsys.readouterr().out)["window_results"]
    bars = spark.read.csv(str(tmp_path / "train_test"), header=True).collect()
    assert sorted((int(r.win), r["sample"]) for r in bars) == [(w["win"], s) for w in windows for s in ("test", "train")]
    cli.main(["example"])
    assert json.loads(capsys.readouterr().out)


def test_command_errors(spark):
    with pytest.raises(SystemExit):
        cli.main(["run", "--signal", "nothing"])
    with pytest.raises(ValueError):
        cli.main(["run", "--names", "2", "--days", "1"])
    _ = panel


def test_counts_ride_on_the_main_action(spark, caplog):
    w = walk(30, 2)
    w.iloc[0, 0] = w.iloc[5, 1] = w.iloc[6, 1] = None
    df, seen = backtest.observed_panel(panel(spark, w))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "")
    daily = backtest.backtest(df).daily.collect()
    jobs = len(tracker.getJobIdsForGroup("observed"))
    counts = backtest.check_observed(seen)
    assert len(tracker.getJobIdsForGroup("observed")) == jobs and len(daily) == 30
    assert counts == {"cells": 60, "dates": 30, "gaps": 2} and "2 of 60" in caplog.text
    one, seen = backtest.observed_panel(panel(spark, w.iloc[:1]))
    one.collect()
    with pytest.raises(ValueError, match="2 dates"):
        backtest.check_observed(seen)


def test_train_writes_every_asset(spark, tmp_path, capsys):
    cli.main(["train", "--names", "3", "--days", "160", "--output-dir", str(tmp_path), "--vol-span", "10", "--n-splits", "3"])
    got = json.loads((tmp_path / "train.json").read_text())
    assert len(got["assets"]) == 3 and 0 <= got["accuracy_mean"] <= 1
    assert all(a["n_positive"] + a["n_negative"] == a["n_samples"] for a in got["assets"].values())
