"""The registered queries over panels, and their SQL.

Results are rounded to 6 places, dates are text, and keys come along, so that two engines can be compared.
Levels of price are given as logarithms or relative to the price, as averages of cents fall on ties of any
decimal rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom import oracle as o
from panelloom import sinks
from panelloom.functions.windows import ewm_std
from panelloom.operators import crossval, fracdiff, labels, metrics, model, portfolio, risk, signals, simulate
from panelloom.plans import backtest as bt
from panelloom.plans import blend, search
from panelloom.sources import loaders, panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SIGNAL_NAMES = {"skip_month": "skip_month_momentum", "residual": "residual_momentum", "vol_scaled": "vol_scaled_momentum", "regime": "regime_switch", "ewma": "ewma_momentum", "ma_cross": "ma_crossover"}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def day(c: str = "ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def cells(df: DataFrame, *names: str) -> DataFrame:
    """asset, day and rounded columns."""
    return df.select("asset", day().alias("day"), *[r6(n).alias(n) for n in names])


def cells_sql(base: str, *names: str) -> str:
    return o.render(f"SELECT asset, {o.day()} AS day, " + ", ".join(f"{o.r6(n)} AS {n}" for n in names) + f" FROM {base}", base)


def days(df: DataFrame, *names: str) -> DataFrame:
    return df.select(day().alias("day"), *[r6(n).alias(n) for n in names])


def days_sql(base: str, *names: str) -> str:
    return o.render(f"SELECT {o.day()} AS day, " + ", ".join(f"{o.r6(n)} AS {n}" for n in names) + f" FROM {base}", base)


# --- panels, returns, cleaning


@query("panel_dense", o.render(f"SELECT asset, {o.day()} AS day, pos::BIGINT AS pos, {o.r6('price')} AS price FROM line", "line"))
def panel_dense(spark, sf_dir):
    return panels.line_daily(spark, sf_dir).select("asset", day().alias("day"), "pos", r6("price").alias("price"))


@query("panel_smooth", o.render(f"SELECT asset, {o.day()} AS day, {o.r6('ln(price)')} AS log_price FROM orders_d_smooth", "orders_d_smooth"))
def panel_smooth(spark, sf_dir):
    return cells(panels.orders_smooth(spark, sf_dir).withColumn("log_price", F.ln("price")), "log_price")


@query("panel_wide", o.render(f"SELECT {o.day()} AS day, " + ", ".join(f"{o.r6(f'max(ln(price)) FILTER (asset = {chr(39)}{a}{chr(39)})')} AS {a}" for a in ("AF", "AO", "NF", "NO", "RF", "RO")) + " FROM line_smooth GROUP BY ts", "line_smooth"))
def panel_wide(spark, sf_dir):
    wide = panels.long_to_wide(panels.line_smooth(spark, sf_dir).withColumn("price", F.ln("price")), assets=["AF", "AO", "NF", "NO", "RF", "RO"])
    return days(wide, "AF", "AO", "NF", "NO", "RF", "RO")


@query("returns_simple", cells_sql("line_ret", "ret"))
def returns_simple(spark, sf_dir):
    return cells(panels.with_returns(panels.line_smooth(spark, sf_dir)), "ret")


@query("returns_zero_filled", o.render(f"SELECT asset, {o.day()} AS day, round(coalesce(ret, 0.0), 6) + 0.0 AS ret FROM orders_w_ret", "orders_w_ret"))
def returns_zero_filled(spark, sf_dir):
    panel = panels.smoothed(panels.orders_weekly(spark, sf_dir))
    return cells(panels.with_returns(panel).withColumn("ret", F.coalesce("ret", F.lit(0.0))), "ret")


@query("returns_k", o.render(f"SELECT asset, {o.day()} AS day, round(price / nullif(lag(price, 5) OVER ({o.AL}), 0) - 1, 6) + 0.0 AS ret FROM orders_d_smooth", "orders_d_smooth"))
def returns_k(spark, sf_dir):
    return cells(signals.k_period_change(panels.orders_smooth(spark, sf_dir), 5), "ret")


_CLEAN = o.cte("kept_assets", ("orders_d",), "SELECT asset FROM orders_d GROUP BY asset HAVING avg((price IS NULL)::INT) <= 0.3")
o.cte("cleaned", ("kept_assets",), "SELECT *, sum((price IS NULL)::INT) OVER (PARTITION BY pos) AS gaps FROM orders_d WHERE asset IN (SELECT asset FROM kept_assets)")


@query("clean_sparse", o.render(f"SELECT asset, {o.day()} AS day, (dense_rank() OVER (PARTITION BY asset ORDER BY pos) - 1)::BIGINT AS pos, {o.r6('price')} AS price FROM cleaned WHERE gaps = 0", "cleaned"))
def clean_sparse(spark, sf_dir):
    return panels.clean(panels.orders_daily(spark, sf_dir), 0.3).select("asset", day().alias("day"), "pos", r6("price").alias("price"))


@query("missing_counts", o.render(f"SELECT asset, sum((price IS NULL)::INT)::BIGINT AS missing, {o.day('min(ts)')} AS first_day, {o.day('max(ts)')} AS last_day FROM orders_d GROUP BY asset", "orders_d"))
def missing(spark, sf_dir):
    return panels.missing_counts(panels.orders_daily(spark, sf_dir)).select("asset", "missing", day("first").alias("first_day"), day("last").alias("last_day"))


# --- signals


def _signal(short: str, name: str) -> None:
    by = "price" if short == "ma_cross" else "1"  # that signal is in units of price

    @query(f"sig_{short}", o.render(f"SELECT asset, {o.day()} AS day, round(score / {by}, 6) + 0.0 AS score FROM {short}", short))
    def run(spark, sf_dir):
        df = signals.compute_signal(name, panels.line_smooth(spark, sf_dir))
        return cells(df.withColumn("score", F.col("score") / F.expr(by)), "score")


for _short in o.SIGNALS:
    _signal(_short, SIGNAL_NAMES.get(_short, _short))


@query("sig_regime_slow", cells_sql("regime_slow", "score"))
def sig_regime_slow(spark, sf_dir):
    """A deviation window longer than the lookback: scores are missing until the level is known."""
    return cells(signals.regime_switch(panels.line_smooth(spark, sf_dir), 5, 20), "score")


@query("sig_arima")
def sig_arima(spark, sf_dir):
    return cells(signals.arima(panels.line_smooth(spark, sf_dir)), "score")


@query("sig_autoregression", cells_sql("arima_1", "score"))
def sig_autoregression(spark, sf_dir):
    """The first-order autoregression, whose likelihood is a function of a few sums."""
    return cells(signals.arima(panels.line_smooth(spark, sf_dir), (1, 0, 0)), "score")


@query("ewm_std_vol", o.render(f"SELECT asset, {o.day()} AS day, {o.r6('v')} AS vol FROM dev100", "dev100"))
def ewm_std_vol(spark, sf_dir):
    return cells(ewm_std(panels.with_returns(panels.line_smooth(spark, sf_dir)), "vol", "ret", 100, ["asset"]), "vol")


# --- weights


def _momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.momentum(panels.line_smooth(spark, sf_dir))


@query("w_rank", cells_sql("w_rank", "weight"))
def w_rank(spark, sf_dir):
    return cells(portfolio.rank_weights(_momentum(spark, sf_dir)), "weight")


@query("w_leverage", cells_sql("w_lev", "weight"))
def w_leverage(spark, sf_dir):
    return cells(portfolio.construct(_momentum(spark, sf_dir), max_leverage=0.5), "weight")


@query("w_weekly", cells_sql("w_weekly", "weight"))
def w_weekly(spark, sf_dir):
    return cells(portfolio.construct(_momentum(spark, sf_dir), frequency="weekly"), "weight")


@query("w_monthly", cells_sql("w_monthly", "weight"))
def w_monthly(spark, sf_dir):
    return cells(portfolio.construct(_momentum(spark, sf_dir), frequency="monthly"), "weight")


@query("zscore", cells_sql("z_momentum", "score"))
def zscore(spark, sf_dir):
    return cells(portfolio.zscores(_momentum(spark, sf_dir)), "score")


@query("l1norm", cells_sql("w_l1", "weight"))
def l1norm(spark, sf_dir):
    return cells(portfolio.l1_weights(portfolio.zscores(_momentum(spark, sf_dir))), "weight")


# --- simulation

_DAILY = ("gross", "turnover", "cost", "net", "equity", "drawdown")


@query("bt_daily", days_sql("bt", *_DAILY))
def bt_daily(spark, sf_dir):
    return days(bt.backtest(panels.line_smooth(spark, sf_dir)).daily, *_DAILY)


@query("bt_sqrt_cost", days_sql("sim_sqrt", "turnover", "cost", "net"))
def bt_sqrt_cost(spark, sf_dir):
    return days(bt.backtest(panels.line_smooth(spark, sf_dir), impact="sqrt").daily, "turnover", "cost", "net")


@query("bt_stop", o.render(f"SELECT {o.day()} AS day, {o.r6('net')} AS net, {o.r6('equity')} AS equity, stopped FROM bt_stop", "bt_stop"))
def bt_stop(spark, sf_dir):
    daily = bt.backtest(panels.line_smooth(spark, sf_dir), max_drawdown=0.05).daily
    return daily.select(day().alias("day"), r6("net").alias("net"), r6("equity").alias("equity"), "stopped")


@query("rolling_sharpe", o.render(f"SELECT {o.day()} AS day, round(avg(net) OVER ({o.last(63, o.TH)}) / nullif({o.spread('net', 63, w=o.TH)}, 0) * sqrt(252), 6) + 0.0 AS sharpe FROM bt", "bt"))
def rolling_sharpe(spark, sf_dir):
    return days(simulate.rolling_sharpe(bt.backtest(panels.line_smooth(spark, sf_dir)).daily), "sharpe")


@query("monthly_pivot", o.render("SELECT year(ts)::INT AS year, " + ", ".join(f"round(product(1 + net) FILTER (month(ts) = {m}) - 1, 6) + 0.0 AS m{m:02d}" for m in range(1, 13)) + " FROM bt GROUP BY 1", "bt"))
def monthly_pivot(spark, sf_dir):
    table = simulate.monthly_table(bt.backtest(panels.line_smooth(spark, sf_dir)).daily)
    return table.select("year", *[r6(c).alias(c) for c in table.columns[1:]])


@query("bench_eqw", days_sql("b_eqw", "net"))
def bench_eqw(spark, sf_dir):
    return days(simulate.equal_weight_returns(panels.line_smooth(spark, sf_dir)), "net")


@query("bench_bh", days_sql("b_bh", "net"))
def bench_bh(spark, sf_dir):
    return days(simulate.buy_and_hold_returns(panels.line_smooth(spark, sf_dir)), "net")


@query("bench_ivol", days_sql("b_ivol", "net"))
def bench_ivol(spark, sf_dir):
    return days(simulate.inverse_vol_returns(panels.line_smooth(spark, sf_dir)), "net")


# --- measures


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("metrics_backtest", o.render(f"SELECT {o.summary('backtest')} FROM p_bt", "p_bt"))
def metrics_backtest(spark, sf_dir):
    return rounded(bt.backtest(panels.line_smooth(spark, sf_dir)).metrics)


@query("metrics_blend", o.render(f"SELECT {o.summary('blend')} FROM p_bt", "p_bt"))
def metrics_blend(spark, sf_dir):
    return rounded(metrics.blend_summary(bt.backtest(panels.line_smooth(spark, sf_dir)).daily))


@query("metrics_walk_forward", o.render(f"SELECT {o.summary('walk')} FROM p_bt", "p_bt"))
def metrics_walk_forward(spark, sf_dir):
    return rounded(metrics.walk_forward_summary(bt.backtest(panels.line_smooth(spark, sf_dir)).daily))


@query("metrics_fold", o.render(f"SELECT {o.summary('fold')} FROM p_bt", "p_bt"))
def metrics_fold(spark, sf_dir):
    return rounded(metrics.fold_summary(bt.backtest(panels.line_smooth(spark, sf_dir)).daily))


def _passive_sql() -> str:
    values = {"cagr": (o.CAGR, 6), "ann_vol": ("sd * sqrt(252)", 6), "sharpe": (o.SHARPE, 4), "max_dd": ("max_dd", 6), "calmar": (f"CASE WHEN max_dd <> 0 THEN ({o.CAGR}) / abs(max_dd) ELSE 0.0 END", 4)}
    columns = ", ".join(f"CASE WHEN n >= 2 THEN round_even({v}, {k}) + 0.0 END AS {name}" for name, (v, k) in values.items())
    names = {"equal_weight": "p_b_eqw", "buy_and_hold": "p_b_bh", "inverse_vol": "p_b_ivol"}
    return o.render(" UNION ALL ".join(f"SELECT '{k}' AS portfolio, {columns}, n AS n_days FROM {v}" for k, v in names.items()), *names.values())


@query("metrics_passive", _passive_sql())
def metrics_passive(spark, sf_dir):
    """The three passive portfolios side by side."""
    panel = panels.line_smooth(spark, sf_dir)
    made = {"equal_weight": simulate.equal_weight_returns, "buy_and_hold": simulate.buy_and_hold_returns, "inverse_vol": simulate.inverse_vol_returns}
    rows = reduce(DataFrame.unionByName, [f(panel).select("ts", "pos", "net", F.lit(k).alias("portfolio")) for k, f in made.items()])
    out = metrics.passive_summary(rows, 252, "portfolio")
    return out.select("portfolio", *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("cagr", "ann_vol", "sharpe", "max_dd", "calmar")], "n_days")


@query("sharpe_annual", o.render(f"SELECT {o.r6(o.SHARPE)} AS sharpe FROM p_bt", "p_bt"))
def sharpe_annual(spark, sf_dir):
    return rounded(metrics.annual_sharpe(bt.backtest(panels.line_smooth(spark, sf_dir)).daily))


_NW = o.newey_west_sql(8)
o.cte("gapped", ("bt",), "SELECT pos, CASE WHEN pos % 7 <> 3 THEN net END AS net FROM bt")


@query("newey_west", o.render("", "bt").rstrip() + ", " + _NW + " SELECT any_value(n)::BIGINT AS n, 8 AS lags, round(any_value(mean) / sqrt(any_value(variance) / any_value(n)), 6) + 0.0 AS t FROM c, v")
def newey_west(spark, sf_dir):
    return metrics.newey_west(bt.backtest(panels.line_smooth(spark, sf_dir)).daily, 8).select("n", "lags", r6("t").alias("t"))


@query("newey_west_gaps", o.render("", "gapped").rstrip() + ", " + o.newey_west_sql(8, "gapped") + " SELECT any_value(n)::BIGINT AS n, 8 AS lags, round(any_value(mean) / sqrt(any_value(variance) / any_value(n)), 6) + 0.0 AS t FROM c, v")
def newey_west_gaps(spark, sf_dir):
    """Every seventh return is missing: lags count the returns that are there."""
    daily = bt.backtest(panels.line_smooth(spark, sf_dir)).daily.withColumn("net", F.when(F.col("pos") % 7 != 3, F.col("net")))
    return metrics.newey_west(daily, 8).select("n", "lags", r6("t").alias("t"))


@query("sharpe_moments", o.render("SELECT count(net)::BIGINT AS n, round(avg(net) / stddev_samp(net), 6) + 0.0 AS sharpe, round(skewness(net), 6) + 0.0 AS skew, round(kurtosis(net), 6) + 0.0 AS excess FROM bt", "bt"))
def sharpe_moments(spark, sf_dir):
    return rounded(metrics.sharpe_moments(bt.backtest(panels.line_smooth(spark, sf_dir)).daily))


_BEST = metrics.expected_best(10)


@query("deflated_sharpe_z", o.render(f"SELECT round(s / sqrt((1 - g * s + k / 4 * s * s) / (n - 1)) - {_BEST!r}::DOUBLE, 6) + 0.0 AS z FROM (SELECT count(net) AS n, avg(net) / stddev_samp(net) AS s, skewness(net) AS g, kurtosis(net) AS k FROM bt)", "bt"))
def deflated_sharpe_z(spark, sf_dir):
    z = metrics.deflated_sharpe(bt.backtest(panels.line_smooth(spark, sf_dir)).daily, 10)["z"]
    return spark.createDataFrame([(z,)], "z double").select(r6("z").alias("z"))


_SAMPLED = (
    "s AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS at, net FROM bt WHERE net IS NOT NULL), n AS (SELECT count(*) AS n, greatest(floor(sqrt(count(*))), 1)::BIGINT AS block FROM s), "
    "d AS (SELECT d.draw, i.i, ('0x' || substr(md5('42:' || d.draw || ':' || i.i), 1, 13))::BIGINT % n AS start, n, block FROM n, range(1000) d(draw), range(100000) i(i) WHERE i.i * block < n), "
    "m AS (SELECT draw, coalesce(avg(net) / CASE WHEN stddev_samp(net) > 1e-12 THEN stddev_samp(net) END * sqrt(252), 0.0) AS m "
    "FROM d, range(1000) o(o) JOIN s ON s.at = (start + o) % n WHERE o < block AND i * block + o < n GROUP BY draw)"
)


@query("bootstrap_ci", o.render("", "bt").rstrip() + ", " + _SAMPLED + " SELECT round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high, count(*)::BIGINT AS draws FROM m")
def bootstrap_ci(spark, sf_dir):
    return rounded(metrics.block_bootstrap(bt.backtest(panels.line_smooth(spark, sf_dir)).daily))


# --- risk model and blends


def _z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.zscores(_momentum(spark, sf_dir))


@query("risk_clip", cells_sql("z_clip", "score"))
def risk_clip(spark, sf_dir):
    return cells(risk.clip_scores(_z(spark, sf_dir), 1.0), "score")


@query("risk_smooth", cells_sql("z_smooth", "score"))
def risk_smooth(spark, sf_dir):
    return cells(risk.smooth_scores(_z(spark, sf_dir), 5), "score")


@query("risk_inverse_vol", cells_sql("z_inv", "score"))
def risk_inverse_vol(spark, sf_dir):
    return cells(risk.inverse_vol(_z(spark, sf_dir), 20, 0.01), "score")


@query("risk_vol_target", cells_sql("w_target", "weight"))
def risk_vol_target(spark, sf_dir):
    return cells(risk.vol_target(portfolio.l1_weights(_z(spark, sf_dir)), 0.15, 63, 0.01, 2.0), "weight")


@query("risk_full", cells_sql("w_risk", "weight"))
def risk_full(spark, sf_dir):
    return cells(risk.apply_risk(_z(spark, sf_dir), risk.RiskConfig()), "weight")


_BLEND = ["momentum", "ewma_momentum", "volatility"]


@query("compute_signals", o.render(f"SELECT a.asset, {o.day('a.ts')} AS day, round(a.score, 6) + 0.0 AS z_momentum, round(b.score, 6) + 0.0 AS z_ewma_momentum FROM z_momentum a JOIN z_ewma b USING (asset, pos)", "z_momentum", "z_ewma"))
def compute_signals(spark, sf_dir):
    return cells(blend.compute_signals(panels.line_smooth(spark, sf_dir), _BLEND[:2]), "z_momentum", "z_ewma_momentum")


@query("blend_daily", days_sql("blend_bt", "turnover", "net", "equity"))
def blend_daily(spark, sf_dir):
    return days(blend.blend_equal_weight(panels.line_smooth(spark, sf_dir), _BLEND).daily, "turnover", "net", "equity")


@query("blend_metrics", o.render(f"SELECT {o.summary('blend')} FROM p_blend", "p_blend"))
def blend_metrics(spark, sf_dir):
    return rounded(blend.blend_equal_weight(panels.line_smooth(spark, sf_dir), _BLEND).metrics)


@query("blend_risk_metrics", o.render(f"SELECT {o.summary('blend')} FROM p_rblend", "p_rblend"))
def blend_risk_metrics(spark, sf_dir):
    return rounded(blend.blend_equal_weight(panels.line_smooth(spark, sf_dir), _BLEND, risk=risk.RiskConfig()).metrics)


@query("weight_grid", "WITH l AS (SELECT round(i * 0.25, 2)::DOUBLE AS v FROM range(5) t(i)) SELECT (row_number() OVER (ORDER BY a.v, b.v, c.v) - 1)::BIGINT AS combo, a.v AS w0, b.v AS w1, c.v AS w2 FROM l a, l b, l c WHERE abs(a.v + b.v + c.v - 1) < 1e-6")
def weight_grid(spark, sf_dir):
    return spark.createDataFrame([(k, *c) for k, c in enumerate(blend.weight_grid(3, 0.25))], "combo long, w0 double, w1 double, w2 double")


@query("wf_windows", "WITH n AS (SELECT count(DISTINCT l_shipdate::DATE) AS n FROM lineitem) SELECT i::INT AS win, i * 252 AS train_lo, i * 252 + 503 AS train_hi, i * 252 + 503 AS test_lo, i * 252 + 755 AS test_hi FROM n, range(1000) t(i) WHERE i * 252 + 756 <= n")
def wf_windows(spark, sf_dir):
    dates = panels.line_daily(spark, sf_dir).agg(F.max("pos")).first()[0] + 1
    return blend.windows_table(spark, dates)


@query("blend_weighted", days_sql("mixed_bt", "turnover", "net", "equity"))
def blend_weighted(spark, sf_dir):
    weights = {"momentum": 0.25, "ewma_momentum": 0.75}
    return days(blend.weighted_backtest(panels.line_smooth(spark, sf_dir), weights, risk=risk.RiskConfig()).daily, "turnover", "net", "equity")


@query("wf_stitched", days_sql("wf_bt", "net", "equity"))
def wf_stitched(spark, sf_dir):
    result = blend.walk_forward(panels.line_smooth(spark, sf_dir), _BLEND[:2], weight_step=0.25, risk=risk.RiskConfig())
    return days(result.daily, "net", "equity")


_OF_WINDOW = "SELECT pos // 1000000 AS win, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) ELSE 0.0 END AS s FROM wf_test_sim GROUP BY 1"


@query(
    "wf_train_test",
    o.render(
        "SELECT win::INT AS win, sample, round(s * sqrt(252), 6) + 0.0 AS sharpe FROM (SELECT w.win, 'train' AS sample, max(t.s) AS s "
        f"FROM wf_win w LEFT JOIN wf_tried t ON t.run // 100 = w.win GROUP BY 1 UNION ALL SELECT win, 'test', s FROM ({_OF_WINDOW}))",
        "wf_win", "wf_tried", "wf_test_sim",
    ),
)
def wf_train_test(spark, sf_dir):
    """The best training Sharpe ratio of each window beside that of its test slice."""
    result = blend.walk_forward(panels.line_smooth(spark, sf_dir), _BLEND[:2], weight_step=0.25, risk=risk.RiskConfig())
    return rounded(sinks.train_test_table(result.windows))


# --- cross-validation and search


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossval.event_table(panels.line_daily(spark, sf_dir), 5)


@query("event_table", o.render(f"SELECT eid::BIGINT AS eid, {o.day('t0')} AS t0, {o.day('t1')} AS t1 FROM ev", "ev"))
def event_table(spark, sf_dir):
    return _events(spark, sf_dir).select("eid", day("t0").alias("t0"), day("t1").alias("t1"))


@query("folds_kfold", o.render("SELECT split::INT AS split, eid::BIGINT AS eid, role FROM kfold", "kfold"))
def folds_kfold(spark, sf_dir):
    return crossval.PurgedKFold(5, 0.02).split(_events(spark, sf_dir))


@query("folds_cpcv", o.render("SELECT split::INT AS split, eid::BIGINT AS eid, role FROM cpcv", "cpcv"))
def folds_cpcv(spark, sf_dir):
    return crossval.combinatorial_splits(_events(spark, sf_dir), 5, 2, 0.01)


@query("cv_sharpe", o.render("SELECT split::INT AS split, round(sharpe, 6) + 0.0 AS sharpe FROM cv_sharpe", "cv_sharpe"))
def cv_sharpe(spark, sf_dir):
    return rounded(search.cross_validate_sharpe(panels.line_smooth(spark, sf_dir)))


@query("cv_summary", o.render("SELECT round(avg(sharpe), 6) + 0.0 AS mean, round(stddev_pop(sharpe), 6) + 0.0 AS std, round(median(sharpe), 6) + 0.0 AS median, round(min(sharpe), 6) + 0.0 AS min, round(max(sharpe), 6) + 0.0 AS max, count(sharpe)::BIGINT AS n_folds FROM cv_sharpe", "cv_sharpe"))
def cv_summary(spark, sf_dir):
    return rounded(crossval.cv_summary(search.cross_validate_sharpe(panels.line_smooth(spark, sf_dir))))


def _sweep_sql() -> str:
    out = []
    for n in (10, 20):
        o.scored(f"mom{n}", o.R, o.rolled("sum", "ret", n))
        for g in (0.5, 1.0):
            name = f"sw_{n}_{int(g * 10)}"
            o.ranked(f"{name}_w", f"mom{n}", g)
            o.simulated(f"{name}_s", f"{name}_w")
            o.equity(f"{name}_e", f"{name}_s")
            o.parts(name, f"{name}_e")
            out.append((name, f"SELECT {n} AS lookback, {g}::DOUBLE AS max_gross, {o.summary('backtest')} FROM {name}"))
    return o.render(" UNION ALL ".join(s for _, s in out), *[n for n, _ in out])


@query("sweep", _sweep_sql())
def sweep(spark, sf_dir):
    return rounded(search.sweep(panels.line_smooth(spark, sf_dir), "momentum", [10, 20], [0.5, 1.0]))


@query("sweep_matrix", f"SELECT lookback, max(CASE WHEN max_gross = 0.5 THEN sharpe END) AS gross_0_5, max(CASE WHEN max_gross = 1.0 THEN sharpe END) AS gross_1_0 FROM ({_sweep_sql()}) GROUP BY lookback")
def sweep_matrix(spark, sf_dir):
    return rounded(sinks.sweep_matrix(search.sweep(panels.line_smooth(spark, sf_dir), "momentum", [10, 20], [0.5, 1.0]), [0.5, 1.0]))


@query("optimize_ewma", o.render("SELECT place, round(avg(sharpe), 6) + 0.0 AS mean, round(median(sharpe), 6) + 0.0 AS median FROM (SELECT 0::INT AS place, sharpe FROM span10_f UNION ALL SELECT 1::INT, sharpe FROM span20_f) GROUP BY place", "span10_f", "span20_f"))
def optimize_ewma(spark, sf_dir):
    return rounded(search.optimize_ewma(panels.line_smooth(spark, sf_dir), [10, 20]).scores)


@query("search_lookbacks", o.render("SELECT place::INT AS place, round(avg(sharpe), 6) + 0.0 AS mean, round(median(sharpe), 6) + 0.0 AS median FROM look_f GROUP BY place", "look_f"))
def search_lookbacks(spark, sf_dir):
    """Twenty lookbacks of the momentum, scored over the folds in one plan."""
    return rounded(search.optimize_parameter(panels.line_smooth(spark, sf_dir), "momentum", "lookback", _LOOKBACKS).scores)


_LOOKBACKS = list(range(5, 101, 5))
#: The normal distribution function by its series, term by term.
_PHI = "0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(120), lambda k: list_product(list_transform(range(k + 1), lambda j: z * CASE WHEN j = 0 THEN 1 ELSE z / (2 * j + 1) END))))"
_BEST20 = metrics.expected_best(20)
_DSR = (
    "SELECT place, year, n, sharpe, CASE WHEN v > 0 THEN sharpe / sqrt(v) - " + repr(_BEST20) + "::DOUBLE ELSE 0.0 END AS z FROM (SELECT place, year, n, s AS sharpe, (1 - g * s + k / 4 * s * s) / (n - 1) AS v FROM "
    "(SELECT pos // 1000000 AS place, year(ts) AS year, count(net) AS n, avg(net) / stddev_samp(net) AS s, skewness(net) AS g, kurtosis(net) AS k FROM look_sim GROUP BY 1, 2))"
)


@query("deflated_sharpe", o.render(f"SELECT 5 * (place + 1)::INT AS lookback, year::INT AS year, n::BIGINT AS n, round(sharpe, 6) + 0.0 AS sharpe, round({_BEST20!r}::DOUBLE, 6) AS best, round(z, 6) + 0.0 AS z, round({_PHI}, 6) + 0.0 AS dsr FROM ({_DSR})", "look_sim"))
def deflated_sharpe(spark, sf_dir):
    """Each of twenty lookbacks in each year, judged against the best that twenty would reach by chance."""
    daily = search.candidate_returns(panels.line_smooth(spark, sf_dir), "momentum", "lookback", _LOOKBACKS)
    table = metrics.deflated_sharpe_table(daily.withColumn("year", F.year("ts")), len(_LOOKBACKS), "value", "year")
    return rounded(table.select(F.col("value").alias("lookback"), "year", "n", "sharpe", "best", "z", "dsr"))


# --- labels, features, models, differencing


@query("tb_events", o.render(f"SELECT asset, {o.day('t0')} AS t0, {o.day('t1')} AS t1, {o.r6('ln(pt)')} AS log_pt, {o.r6('ln(sl)')} AS log_sl FROM bar_ev", "bar_ev"))
def tb_events(spark, sf_dir):
    ev = labels.barrier_events(panels.line_smooth(spark, sf_dir), 5)
    return ev.select("asset", day("t0").alias("t0"), day("t1").alias("t1"), r6(F.ln("pt")).alias("log_pt"), r6(F.ln("sl")).alias("log_sl"))


@query("tb_labels", o.render(f"SELECT asset, {o.day('t0')} AS t0, {o.day('t1')} AS t1, y FROM labels_y", "labels_y"))
def tb_labels(spark, sf_dir):
    return labels.triple_barrier(panels.line_smooth(spark, sf_dir)).select("asset", day("t0").alias("t0"), day("t1").alias("t1"), "y")


_SPAN = "SELECT asset || ':' || pos || ':{0}' AS event_id, asset, t0, CASE pos % 3 WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t0 + 400 END AS t1, pt * {1} AS pt, sl * {2} AS sl FROM bar_ev"
_ANY_SPAN = _SPAN.format("a", 1.01, 1.0) + " UNION ALL " + _SPAN.format("b", 1.2, 1.005)
_TOUCHES = (
    "SELECT e.event_id, e.asset, e.t0, e.t1, min(CASE WHEN v.price >= e.pt THEN v.ts END) AS up, min(CASE WHEN v.price <= e.sl THEN v.ts END) AS down, arg_min(v.price, v.ts) AS p0, arg_max(v.price, v.ts) AS p1 "
    f"FROM ({_ANY_SPAN}) e LEFT JOIN vols v ON v.asset = e.asset AND v.price IS NOT NULL AND v.ts BETWEEN e.t0 AND e.t1 GROUP BY ALL"
)


@query(
    "label_events",
    o.render(
        f"SELECT event_id, asset, {o.day('t0')} AS t0, {o.day('t1')} AS t1, CASE WHEN t1 <= t0 THEN 0 WHEN up IS NOT NULL AND (down IS NULL OR up <= down) THEN 1 "
        f"WHEN down IS NOT NULL THEN -1 ELSE sign(p1 - p0) END::INT AS y FROM ({_TOUCHES})",
        "bar_ev", "vols",
    ),
)
def label_events(spark, sf_dir):
    """Events of unequal spans, two with different barriers on each: a third end where they begin, a third 400 days on."""
    panel = panels.line_smooth(spark, sf_dir)
    t1 = F.when(F.col("pos") % 3 == 0, F.col("t0")).when(F.col("pos") % 3 == 1, F.col("t1")).otherwise(F.date_add("t0", 400))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(u).alias("up"), F.lit(d).alias("down")) for k, u, d in (("a", 1.01, 1.0), ("b", 1.2, 1.005))])).alias("k")
    events = labels.barrier_events(panel, 5).withColumn("t1", t1).select("asset", "pos", "t0", "t1", "pt", "sl", kinds)
    events = events.select(F.concat_ws(":", "asset", "pos", "k.kind").alias("event_id"), "asset", "t0", "t1", (F.col("pt") * F.col("k.up")).alias("pt"), (F.col("sl") * F.col("k.down")).alias("sl"))
    return labels.label_events(panel, events).select("event_id", "asset", day("t0").alias("t0"), day("t1").alias("t1"), "y")


@query("meta_labels", o.render(f"SELECT asset, {o.day('t0')} AS t0, round(realised, 6) + 0.0 AS realised, CASE WHEN y <> 0 AND sign(realised) = y THEN 1 ELSE 0 END::INT AS meta FROM labels_y", "labels_y"))
def meta_labels(spark, sf_dir):
    out = labels.meta_labels(labels.triple_barrier(panels.line_smooth(spark, sf_dir)))
    return out.select("asset", day("t0").alias("t0"), r6("realised").alias("realised"), "meta")


@query("features", cells_sql("feats", "momentum", "volatility", "mean_rev"))
def features(spark, sf_dir):
    return cells(labels.build_features(panels.line_smooth(spark, sf_dir)), "momentum", "volatility", "mean_rev")


@query("fracdiff", o.render(f"SELECT asset, {o.day()} AS day, {o.r6('value / price')} AS value FROM fd", "fd"))
def fracdiff_values(spark, sf_dir):
    return cells(fracdiff.fracdiff(panels.line_smooth(spark, sf_dir), 0.4).withColumn("value", F.col("value") / F.col("price")), "value")


@query("fracdiff_forward", o.render(f"SELECT asset, {o.day()} AS day, {o.r6('value / price')} AS value FROM fd_ahead", "fd_ahead"))
def fracdiff_forward(spark, sf_dir):
    return cells(fracdiff.fracdiff(panels.line_smooth(spark, sf_dir), 0.4, mode="forward").withColumn("value", F.col("value") / F.col("price")), "value")


@query("min_order")
def min_order(spark, sf_dir):
    """The order, its p-value and, as text, every order tried with its p-value."""
    tried = F.array_join(F.transform(F.array_sort(F.map_entries("tested")), lambda e: F.format_string("%.1f:%.6f", e["key"], e["value"])), ",")
    return fracdiff.least_order(panels.line_smooth(spark, sf_dir)).select("asset", "d", r6("p_value").alias("p_value"), "stationary", tried.alias("tested"))


@query("meta_model")
def meta_model(spark, sf_dir):
    return rounded(model.meta_model(panels.line_smooth(spark, sf_dir)))


@query("synthetic_panel")
def synthetic_panel(spark, sf_dir):
    return cells(loaders.synthetic_prices(spark, 5, 300), "price")


@query("bt_supplier", o.render(f"SELECT {o.summary('backtest')} FROM p_supp", "p_supp"))
def bt_supplier(spark, sf_dir):
    """The widest panel: one asset per supplier."""
    return rounded(bt.backtest(panels.supplier_smooth(spark, sf_dir)).metrics)

