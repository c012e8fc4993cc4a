"""SQL for the queries over panels, put together from named common table expressions.

``render(select, *names)`` puts the expressions that ``names`` need in front of a select.  Windows: ``al`` is
an asset in time, ``ac`` a date across assets, ``th`` the portfolio through time.
"""

from __future__ import annotations

from panelloom.operators.fracdiff import kernel

AL = "PARTITION BY asset ORDER BY pos"
TH = "ORDER BY pos"
EVER = f"{AL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def last(n: int, w: str = AL) -> str:
    return f"{w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def rolled(fn: str, x: str, n: int, least: int | None = None, w: str = AL) -> str:
    return f"CASE WHEN count({x}) OVER ({last(n, w)}) >= {n if least is None else least} THEN {fn}({x}) OVER ({last(n, w)}) END"


def spread(x: str, n: int, least: int | None = None, w: str = AL) -> str:
    s = rolled("stddev_samp", x, n, least, w)
    return f"(CASE WHEN {s} < 1e-12 THEN 0.0::DOUBLE ELSE {s} END)"


def dense(name: str, table: str, asset: str, ts: str, value: str) -> dict[str, tuple[tuple[str, ...], str]]:
    return {
        f"{name}_cells": ((), f"SELECT {asset} AS asset, {ts} AS ts, avg({value}) AS price FROM {table} GROUP BY 1, 2"),
        f"{name}_dates": ((f"{name}_cells",), f"SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM {name}_cells)"),
        name: ((f"{name}_dates",), f"SELECT a.asset, d.ts, d.pos, c.price FROM {name}_dates d CROSS JOIN (SELECT DISTINCT asset FROM {name}_cells) a LEFT JOIN {name}_cells c ON c.asset = a.asset AND c.ts = d.ts"),
        f"{name}_filled": ((name,), f"SELECT asset, ts, pos, last_value(price IGNORE NULLS) OVER ({EVER}) AS price FROM {name}"),
        f"{name}_smooth": ((f"{name}_filled",), f"SELECT asset, ts, pos, avg(price) OVER ({last(28)}) AS price FROM {name}_filled"),
        f"{name}_ret": ((f"{name}_smooth",), f"SELECT *, price / nullif(lag(price) OVER ({AL}), 0) - 1 AS ret FROM {name}_smooth"),
    }


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    **dense("line", "lineitem", "l_returnflag || l_linestatus", "l_shipdate::DATE", "l_extendedprice"),
    **dense("orders_d", "orders", "o_orderpriority", "o_orderdate::DATE", "o_totalprice"),
    **dense("orders_w", "orders", "o_orderpriority", "date_trunc('week', o_orderdate)::DATE", "o_totalprice"),
    **dense("events_d", "events", "event_type", "ts::DATE", "value"),
}


def cte(name: str, needs: tuple[str, ...], body: str) -> str:
    CTES[name] = (needs, body)
    return name


def render(select: str, *names: str) -> str:
    done: list[str] = []

    def visit(name: str) -> None:
        for n in CTES[name][0]:
            visit(n)
        if name not in done:
            done.append(name)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + "\n" + select


def day(c: str = "ts") -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def scored(name: str, base: str, raw: str, extra: str = "") -> str:
    """A signal: the expression ``raw`` over ``base``, lagged."""
    cte(f"{name}_raw", (base,), f"SELECT *, {raw} AS s {extra} FROM {base}")
    return cte(name, (f"{name}_raw",), f"SELECT asset, ts, pos, price, ret, lag(s) OVER ({AL}) AS score FROM {name}_raw")


R = "line_ret"
scored("momentum", R, rolled("sum", "ret", 20))
cte("mean_reversion", ("momentum",), "SELECT asset, ts, pos, price, ret, -score AS score FROM momentum")
scored("skip_month", R, f"lag(price, 21) OVER ({AL}) / nullif(lag(price, 252) OVER ({AL}), 0) - 1")
scored("volatility", R, f"-({rolled('avg', 'ret * ret', 20)})")
scored("vol_scaled", R, f"({rolled('sum', 'ret', 20)}) / ({spread('ret', 20)} + 1e-8)")
scored("ma_cross", R, f"({rolled('avg', 'price', 10)}) - ({rolled('avg', 'price', 50)})")
cte("market", (R,), f"SELECT *, avg(ret) OVER (PARTITION BY pos) AS m FROM {R}")
cte("paired", ("market",), "SELECT *, CASE WHEN ret IS NOT NULL THEN m END AS mp FROM market")
cte(
    "resid", ("paired",),
    f"SELECT *, ret - (CASE WHEN count(ret) OVER ({last(252)}) >= 126 THEN covar_samp(ret, mp) OVER ({last(252)}) END) / greatest({rolled('var_samp', 'm', 252, 126)}, 1e-10) * m AS e FROM paired",
)
scored("residual", "resid", f"({rolled('sum', 'e', 252, 126)}) - ({rolled('sum', 'e', 21, 1)})")
cte("regime_parts", (R,), f"SELECT *, {rolled('sum', 'ret', 20)} AS mom, {spread('ret', 20)} AS vol FROM {R}")
cte("regime_mean", ("regime_parts",), "SELECT *, avg(vol) OVER (PARTITION BY pos) AS level FROM regime_parts")
scored("regime", "regime_mean", "CASE WHEN level < 0.02 THEN mom ELSE -mom END")
# The deviation has the longer window here, so there are dates with momentum and no level.
cte("slow_parts", (R,), f"SELECT *, {rolled('sum', 'ret', 5)} AS mom, {spread('ret', 20)} AS vol FROM {R}")
cte("slow_mean", ("slow_parts",), "SELECT *, avg(vol) OVER (PARTITION BY pos) AS level FROM slow_parts")
scored("regime_slow", "slow_mean", "CASE WHEN level < 0.02 THEN mom WHEN level >= 0.02 THEN -mom END")


def ewm(name: str, base: str, x: str, span: int) -> str:
    """Exponential mean from the first value, as one sum of scaled values; for series that do not overflow it."""
    a = repr(2 / (span + 1))
    cte(f"{name}_in", (base,), f"SELECT *, {x} AS x, count({x}) OVER ({EVER}) AS seen FROM {base}")
    q = repr(1 - 2 / (span + 1))
    scaled = f"(CASE WHEN seen = 1 THEN x ELSE {a}::DOUBLE * x END) * pow({q}::DOUBLE, -(seen - 1))"
    return cte(name, (f"{name}_in",), f"SELECT *, CASE WHEN seen > 0 THEN pow({q}::DOUBLE, seen - 1) * sum({scaled}) OVER ({EVER}) END AS y FROM {name}_in")


ewm("ewm20", R, "ret", 20)
scored("ewma", "ewm20", "y")
SIGNALS = {"momentum": "momentum", "mean_reversion": "mean_reversion", "skip_month": "skip_month", "residual": "residual", "volatility": "volatility", "vol_scaled": "vol_scaled", "regime": "regime", "ewma": "ewma", "ma_cross": "ma_cross"}


def ewm_deviation(name: str, base: str, span: int) -> str:
    a = 2 / (span + 1)
    q = 1 - a
    ewm(f"{name}_m", base, "ret", span)
    cte(f"{name}_n", (f"{name}_m",), f"SELECT asset, ts, pos, price, ret, y AS m FROM {name}_m")
    ewm(f"{name}_s", f"{name}_n", "ret * ret", span)
    k = "(seen - 1)"
    var = f"greatest(y - m * m, 0.0) / (1 - (pow({q!r}::DOUBLE, 2 * {k}) + {a * a!r}::DOUBLE * (1 - pow({q!r}::DOUBLE, 2 * {k})) / {1 - q * q!r}::DOUBLE))"
    return cte(name, (f"{name}_s",), f"SELECT asset, ts, pos, price, ret, CASE WHEN seen >= 2 THEN sqrt({var}) END AS v FROM {name}_s")


ewm_deviation("dev50", R, 50)
ewm_deviation("dev100", R, 100)


def ranked(name: str, base: str, gross: float = 1.0) -> str:
    cte(f"{name}_s", (base,), f"SELECT *, round(score, 12) AS k FROM {base}")
    cte(f"{name}_r", (f"{name}_s",), "SELECT *, CASE WHEN k IS NOT NULL THEN rank() OVER (PARTITION BY pos, k IS NULL ORDER BY k) + (count(*) OVER (PARTITION BY pos, k) - 1) / 2.0::DOUBLE END AS rk FROM " + f"{name}_s")
    cte(f"{name}_c", (f"{name}_r",), f"SELECT *, rk - avg(rk) OVER (PARTITION BY pos) AS c FROM {name}_r")
    return cte(name, (f"{name}_c",), f"SELECT asset, ts, pos, price, ret, score, coalesce(c / nullif(sum(abs(c)) OVER (PARTITION BY pos), 0), 0.0) * {gross}::DOUBLE AS weight FROM {name}_c")


ranked("w_rank", "momentum")
cte("w_lev", ("w_rank",), "SELECT * EXCLUDE (weight), CASE WHEN g > 0 THEN weight * least(0.5::DOUBLE / g, 1.0) ELSE 0.0 END AS weight FROM (SELECT *, sum(abs(weight)) OVER (PARTITION BY pos) AS g FROM w_rank)")
for freq, due in (("weekly", "isodow(ts) = 1"), ("monthly", "day(ts) = 1")):
    cte(f"w_{freq}", ("w_rank",), f"SELECT * EXCLUDE (weight), coalesce(last_value(CASE WHEN {due} THEN weight END IGNORE NULLS) OVER ({EVER}), 0.0) AS weight FROM w_rank")


def z(name: str, base: str) -> str:
    s = "stddev_samp(score) OVER (PARTITION BY pos)"
    return cte(name, (base,), f"SELECT asset, ts, pos, price, ret, coalesce((score - avg(score) OVER (PARTITION BY pos)) / CASE WHEN {s} > 1e-12 THEN {s} END, 0.0) AS score FROM {base}")


def l1(name: str, base: str) -> str:
    g = "sum(abs(score)) OVER (PARTITION BY pos)"
    return cte(name, (base,), f"SELECT *, coalesce(score / CASE WHEN {g} > 1e-12 THEN {g} END, 0.0) AS weight FROM {base}")


for n in ("momentum", "ewma", "volatility", "mean_reversion"):
    z(f"z_{n}", n)
l1("w_l1", "z_momentum")


def simulated(name: str, base: str, rate: float = 0.001, sqrt: bool = False) -> str:
    """name: ts, pos, gross, turnover, cost, net."""
    cte(f"{name}_lag", (base,), f"SELECT *, lag(weight) OVER ({AL}) AS w1 FROM {base}")
    cost = "sqrt(turnover)" if sqrt else "turnover"
    cte(f"{name}_sum", (f"{name}_lag",), f"SELECT ts, pos, coalesce(sum(w1 * ret), 0.0) AS gross, coalesce(sum(abs(weight - w1)), 0.0) AS turnover FROM {name}_lag GROUP BY ts, pos")
    return cte(name, (f"{name}_sum",), f"SELECT *, {cost} * {rate}::DOUBLE AS cost, gross - {cost} * {rate}::DOUBLE AS net FROM {name}_sum")


def equity(name: str, base: str) -> str:
    cte(f"{name}_e", (base,), f"SELECT *, product(1 + net) OVER (ORDER BY pos) AS equity FROM {base}")
    return cte(name, (f"{name}_e",), f"SELECT *, equity / nullif(max(equity) OVER (ORDER BY pos), 0) - 1 AS drawdown FROM {name}_e")


simulated("sim", "w_rank")
equity("bt", "sim")
simulated("sim_sqrt", "w_rank", sqrt=True)
cte("stop", ("bt",), "SELECT ts, pos, gross, turnover, cost, CASE WHEN max(drawdown < -0.05) OVER (ORDER BY pos) THEN 0.0 ELSE net END AS net, max(drawdown < -0.05) OVER (ORDER BY pos) AS stopped FROM bt")
equity("bt_stop", "stop")
cte("b_eqw", (R,), f"SELECT ts, pos, avg(ret) AS net FROM {R} GROUP BY ts, pos")
cte("wealth", (R,), f"SELECT *, product(1 + coalesce(ret, 0)) OVER ({AL}) AS wealth FROM {R}")
cte("bh_w", ("wealth",), "SELECT *, wealth / sum(wealth) OVER (PARTITION BY pos) AS weight FROM wealth")
cte("bh_l", ("bh_w",), f"SELECT *, lag(weight) OVER ({AL}) * ret AS g FROM bh_w")
cte("b_bh", ("bh_l",), "SELECT ts, pos, coalesce(sum(g), 0.0) AS net FROM bh_l GROUP BY ts, pos")
cte("iv_i", (R,), f"SELECT *, 1 / ({spread('ret', 20)} + 1e-8) AS i FROM {R}")
cte("iv_w", ("iv_i",), "SELECT *, coalesce(i / nullif(sum(i) OVER (PARTITION BY pos), 0), 0.0) AS weight FROM iv_i")
cte("iv_l", ("iv_w",), f"SELECT *, lag(weight) OVER ({AL}) * ret AS g FROM iv_w")
cte("b_ivol", ("iv_l",), "SELECT ts, pos, coalesce(sum(g), 0.0) AS net FROM iv_l GROUP BY ts, pos")


def parts(name: str, base: str, keys: str = "") -> str:
    """The sums that the summaries draw on; base has equity and drawdown."""
    by, group = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return cte(
        name, (base,),
        f"SELECT {by}count(net)::BIGINT AS n, avg(net) AS mean, CASE WHEN stddev_samp(net) > 1e-12 THEN stddev_samp(net) ELSE 0.0 END AS sd, arg_max(equity, pos) AS last, arg_min(equity, pos) AS first, "
        "min(drawdown) AS max_dd, count(*) FILTER (net > 0) AS wins, count(*) FILTER (net < 0) AS losses, avg(net) FILTER (net > 0) AS avg_win, avg(net) FILTER (net < 0) AS avg_loss, avg(turnover) AS turnover "
        f"FROM {base}{group}",
    )


parts("p_bt", "bt")
for _name in ("b_eqw", "b_bh", "b_ivol"):
    cte(f"{_name}_n", (_name,), f"SELECT *, NULL::DOUBLE AS turnover FROM {_name} WHERE net IS NOT NULL")
    equity(f"{_name}_q", f"{_name}_n")
    parts(f"p_{_name}", f"{_name}_q")
SHARPE = "coalesce(mean / nullif(sd, 0) * sqrt(252), 0.0)"
CAGR = "CASE WHEN last > 0 THEN pow(last, 252.0 / n) - 1 ELSE -1.0 END"


def summary(kind: str) -> str:
    calmar = lambda c, other: f"CASE WHEN max_dd <> 0 THEN ({c}) / abs(max_dd) ELSE {other} END"
    vol = "sd * sqrt(252)"
    hit = "coalesce(wins::DOUBLE / nullif(wins + losses, 0), 0.0)"
    ratio = "coalesce(abs(coalesce(avg_win, 0) / nullif(avg_loss, 0)), 0.0)"
    blend = "CASE WHEN last / first > 0 THEN pow(last / first, 252.0 / n) - 1 END"
    walk = "CASE WHEN last > 0 THEN pow(last, 252.0 / n) - 1 END"
    columns = {
        "backtest": {"days": "n", "cagr": CAGR, "ann_vol": vol, "sharpe": SHARPE, "max_dd": "max_dd", "calmar": calmar(CAGR, "0.0"), "hit_rate": hit, "win_loss_ratio": ratio, "turnover_daily": "turnover"},
        "blend": {"days": "n", "cagr": blend, "ann_vol": vol, "sharpe": SHARPE, "max_dd": "max_dd", "calmar": calmar(blend, "NULL"), "hit_rate": "wins::DOUBLE / n", "win_loss_ratio": "coalesce(avg_win, 0) / coalesce(abs(avg_loss), 1.0)", "turnover_daily": "turnover"},
        "walk": {"oos_days": "n", "oos_cagr": walk, "oos_ann_vol": vol, "oos_sharpe": SHARPE, "oos_max_dd": "max_dd", "oos_calmar": calmar(walk, "NULL")},
        "fold": {"n_days": "n", "cagr": CAGR, "ann_vol": vol, "sharpe": SHARPE, "max_drawdown": "max_dd", "calmar": calmar(CAGR, "0.0"), "hit_rate": hit, "avg_win": "coalesce(avg_win, 0.0)", "avg_loss": "coalesce(avg_loss, 0.0)", "win_loss_ratio": ratio, "turnover": "turnover"},
    }[kind]
    return ", ".join(f"{v} AS {k}" if v == "n" else f"{r6(v)} AS {k}" for k, v in columns.items())


# Risk model, on the z-scored momentum: clip 1, half-life 5, 20 and 63 dates.
def smooth(name: str, base: str, q: float) -> str:
    cte(f"{name}_k", (base,), f"SELECT *, row_number() OVER ({AL}) - 1 AS k FROM {base}")
    num = f"sum(coalesce(score, 0.0) * pow({q!r}::DOUBLE, -k)) OVER ({EVER})"
    den = f"sum(CASE WHEN score IS NULL THEN 0.0 ELSE pow({q!r}::DOUBLE, -k) END) OVER ({EVER})"
    return cte(name, (f"{name}_k",), f"SELECT asset, ts, pos, price, ret, CASE WHEN {den} > 0 THEN {num} / {den} END AS score FROM {name}_k")


def inverse(name: str, base: str, n: int, floor: float) -> str:
    v = f"greatest({spread('ret', n, max(n // 2, 2))} * sqrt(252), {floor}::DOUBLE)"
    return cte(name, (base,), f"SELECT asset, ts, pos, price, ret, CASE WHEN count(ret) OVER ({last(n)}) >= {max(n // 2, 2)} THEN score / {v} ELSE 0.0 END AS score FROM {base}")


def targeted(name: str, base: str, target: float, n: int, floor: float, most: float, w: str = "ORDER BY pos") -> str:
    cte(f"{name}_l", (base,), f"SELECT *, lag(weight) OVER ({AL}) * ret AS g FROM {base}")
    cte(f"{name}_p", (f"{name}_l",), f"SELECT pos, coalesce(sum(g), 0.0) AS p FROM {name}_l GROUP BY pos")
    v = f"greatest({spread('p', n, max(n // 2, 2), w)} * sqrt(252), {floor}::DOUBLE)"
    cte(f"{name}_s", (f"{name}_p",), f"SELECT pos, CASE WHEN count(p) OVER ({last(n, w)}) >= {max(n // 2, 2)} THEN least({target}::DOUBLE / {v}, {most}::DOUBLE) END AS scale FROM {name}_p")
    return cte(name, (base, f"{name}_s"), f"SELECT b.* EXCLUDE (weight), b.weight * s.scale AS weight FROM {base} b JOIN {name}_s s USING (pos)")


Q5 = 0.5 ** (1 / 5)


def risk(name: str, base: str, clip: float = 2.0, w: str = "ORDER BY pos") -> str:
    cte(f"{name}_c", (base,), f"SELECT asset, ts, pos, price, ret, least(greatest(score, {-clip}::DOUBLE), {clip}::DOUBLE) AS score FROM {base} ")
    smooth(f"{name}_sm", f"{name}_c", Q5)
    inverse(f"{name}_iv", f"{name}_sm", 20, 0.01)
    l1(f"{name}_n", f"{name}_iv")
    return targeted(name, f"{name}_n", 0.15, 63, 0.01, 2.0, w)


cte("z_clip", ("z_momentum",), "SELECT asset, ts, pos, price, ret, least(greatest(score, -1.0::DOUBLE), 1.0::DOUBLE) AS score FROM z_momentum")
smooth("z_smooth", "z_momentum", Q5)
inverse("z_inv", "z_momentum", 20, 0.01)
targeted("w_target", "w_l1", 0.15, 63, 0.01, 2.0)
risk("w_risk", "z_momentum")
cte("blended", ("z_momentum", "z_ewma", "z_volatility"), "SELECT a.asset, a.ts, a.pos, a.price, a.ret, (a.score + b.score + c.score) / 3 AS score FROM z_momentum a JOIN z_ewma b USING (asset, pos) JOIN z_volatility c USING (asset, pos)")
l1("blend_w", "blended")
simulated("blend_sim", "blend_w")
equity("blend_bt", "blend_sim")
parts("p_blend", "blend_bt")
risk("blend_rw", "blended")
simulated("blend_rsim", "blend_rw")
equity("blend_rbt", "blend_rsim")
parts("p_rblend", "blend_rbt")

# Cross-validation over the dates of the panel: horizon 5, 5 folds.
cte("ev_all", ("line_dates",), "SELECT pos AS eid, ts AS t0, lead(ts, 5) OVER (ORDER BY ts) AS t1 FROM line_dates")
cte("ev", ("ev_all",), "SELECT * FROM ev_all WHERE t1 IS NOT NULL")
cte("folds", ("ev",), "SELECT *, ntile(5) OVER (ORDER BY eid) - 1 AS fold FROM ev")


def purged(name: str, tests: str, embargo: float) -> str:
    cte(f"{name}_b", (tests, "ev"), f"SELECT split, epoch(min(t0)) - {embargo}::DOUBLE * (SELECT epoch(max(t1)) - epoch(min(t0)) FROM ev) AS low, epoch(max(t1)) + {embargo}::DOUBLE * (SELECT epoch(max(t1)) - epoch(min(t0)) FROM ev) AS high FROM {tests} GROUP BY split")
    return cte(
        name, (f"{name}_b", tests),
        f"SELECT split, eid, 'train' AS role FROM ev JOIN {name}_b ON epoch(t0) > high OR epoch(t1) < low UNION ALL SELECT split, eid, 'test' FROM {tests}",
    )


cte("tests_k", ("folds",), "SELECT fold AS split, eid, t0, t1 FROM folds")
purged("kfold", "tests_k", 0.02)
_pairs = ", ".join(f"({k}, {f})" for k, c in enumerate((a, b) for a in range(5) for b in range(a + 1, 5)) for f in c)
cte("tests_c", ("folds",), f"SELECT c.split, eid, t0, t1 FROM folds JOIN (VALUES {_pairs}) c(split, f) ON fold = f")
purged("cpcv", "tests_c", 0.01)
cte("cv_ret", ("bt", "folds"), "SELECT fold AS split, pos, net FROM bt JOIN folds ON bt.ts = folds.t0")
cte("cv_sharpe", ("cv_ret",), "SELECT split, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(252) ELSE 0.0 END AS sharpe FROM cv_ret GROUP BY split")

# Labels: span 100, horizon 5, both barriers at one deviation.
cte("vols", ("dev100",), f"SELECT asset, ts, pos, price, ret, first_value(v IGNORE NULLS) OVER ({AL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vol FROM dev100 WHERE price IS NOT NULL")
cte("ends", ("vols",), f"SELECT *, coalesce(lead(ts, 5) OVER ({AL}), max(ts) OVER (PARTITION BY asset)) AS t1, coalesce(lead(price, 5) OVER ({AL}), last_value(price) OVER ({AL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p1 FROM vols")
cte("bar_ev", ("ends",), "SELECT asset, pos, ts AS t0, price AS p0, t1, p1, price * (1 + vol) AS pt, price * (1 - vol) AS sl FROM ends WHERE vol > 0")
cte(
    "touched", ("bar_ev", "vols"),
    "SELECT e.asset, e.pos, e.t0, e.t1, e.p0, e.p1, min(CASE WHEN v.price >= e.pt THEN v.ts END) AS up, min(CASE WHEN v.price <= e.sl THEN v.ts END) AS down "
    "FROM bar_ev e JOIN vols v ON v.asset = e.asset AND v.ts BETWEEN e.t0 AND e.t1 WHERE e.t0 < e.t1 GROUP BY ALL",
)
cte("labels_y", ("touched",), "SELECT *, CASE WHEN up IS NOT NULL AND (down IS NULL OR up <= down) THEN 1 WHEN down IS NOT NULL THEN -1 ELSE sign(p1 - p0) END::INT AS y, (p1 - p0) / nullif(p0, 0) AS realised FROM touched")
cte("feats_raw", ("dev50",), f"SELECT asset, ts, pos, price / nullif(lag(price, 20) OVER ({AL}), 0) - 1 AS mom, v, (price - ({rolled('avg', 'price', 20)})) / nullif({spread('price', 20)}, 0) AS rev FROM dev50")
cte("feats", ("feats_raw",), f"SELECT asset, ts, pos, lag(mom) OVER ({AL}) AS momentum, lag(v) OVER ({AL}) AS volatility, lag(rev) OVER ({AL}) AS mean_rev FROM feats_raw")
_k = kernel(0.4)
cte("taps", (), "SELECT * FROM (VALUES " + ", ".join(f"({j}, {w!r}::DOUBLE)" for j, w in enumerate(_k)) + ") t(j, w)")
cte(
    "fd", ("line_smooth", "taps"),
    f"SELECT a.asset, a.ts, a.pos, any_value(a.price) AS price, CASE WHEN count(b.price) >= {len(_k)} THEN sum(w * b.price ORDER BY j) END AS value FROM line_smooth a JOIN line_smooth b ON b.asset = a.asset AND b.pos BETWEEN a.pos - {len(_k) - 1} AND a.pos JOIN taps ON j = a.pos - b.pos GROUP BY a.asset, a.ts, a.pos",
)
cte(
    "fd_ahead", ("line_smooth", "taps"),
    f"SELECT a.asset, a.ts, a.pos, any_value(a.price) AS price, coalesce(sum(w * b.price ORDER BY j), 0.0) AS value FROM line_smooth a JOIN line_smooth b ON b.asset = a.asset AND b.pos BETWEEN a.pos AND a.pos + {len(_k) - 1} JOIN taps ON j = b.pos - a.pos GROUP BY a.asset, a.ts, a.pos",
)

# The widest panel: an asset per supplier.
CTES.update(dense("supp", "lineitem", "l_suppkey::VARCHAR", "l_shipdate::DATE", "l_extendedprice"))
scored("supp_mom", "supp_ret", rolled("sum", "ret", 20))
ranked("supp_w", "supp_mom")
simulated("supp_sim", "supp_w")
equity("supp_bt", "supp_sim")
parts("p_supp", "supp_bt")

# A search over the span of the exponential momentum, judged on the folds.
for _span in (10, 20):
    ewm(f"span{_span}_m", R, "ret", _span)
    scored(f"span{_span}_s", f"span{_span}_m", "y")
    ranked(f"span{_span}_w", f"span{_span}_s")
    simulated(f"span{_span}", f"span{_span}_w")
    cte(f"span{_span}_f", (f"span{_span}", "folds"), f"SELECT fold, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(252) ELSE 0.0 END AS sharpe FROM span{_span} b JOIN folds ON b.ts = folds.t0 GROUP BY fold")

# An autoregression of returns by exact likelihood: bisection on the sign of its slope in the coefficient, the mean
# solved for; all from sums.
def _ar_mean(f: str) -> str:
    return f"(((1 - {f} * {f}) * x1 + (1 - {f}) * (d - {f} * e)) / ((1 - {f} * {f}) + (n - 1) * (1 - {f}) * (1 - {f})))"


def _ar_slope(f: str, mu: str) -> str:
    both, back = f"(b - {mu} * (d + e) + (n - 1) * {mu} * {mu})", f"(c - 2 * {mu} * e + (n - 1) * {mu} * {mu})"
    own = f"(a - 2 * {mu} * d + (n - 1) * {mu} * {mu})"
    square = f"((1 - {f} * {f}) * (x1 - {mu}) * (x1 - {mu}) + {own} - 2 * {f} * {both} + {f} * {f} * {back})"
    return f"n * (-{f} * (x1 - {mu}) * (x1 - {mu}) - {both} + {f} * {back}) / {square} + {f} / (1 - {f} * {f})"


cte("ar_x", (R,), f"SELECT asset, pos, ret, lag(ret) OVER ({AL}) AS before FROM {R} WHERE ret IS NOT NULL")
cte("ar_sums", ("ar_x",), "SELECT asset, count(*) AS n, arg_min(ret, pos) AS x1, sum(ret * ret) FILTER (before IS NOT NULL) AS a, sum(ret * before) AS b, sum(before * before) AS c, sum(ret) FILTER (before IS NOT NULL) AS d, sum(before) AS e FROM ar_x GROUP BY asset")
cte(
    "ar_steps", ("ar_sums",),
    "SELECT * FROM (WITH RECURSIVE g AS (SELECT *, -0.9999::DOUBLE AS lo, 0.9999::DOUBLE AS hi, 0 AS k FROM ar_sums UNION ALL "
    f"SELECT * EXCLUDE (lo, hi, k, f, mu), CASE WHEN {_ar_slope('f', 'mu')} > 0 THEN lo ELSE f END, CASE WHEN {_ar_slope('f', 'mu')} > 0 THEN f ELSE hi END, k + 1 "
    f"FROM (SELECT *, {_ar_mean('f')} AS mu FROM (SELECT *, (lo + hi) / 2 AS f FROM g WHERE k < 90))) SELECT * FROM g WHERE k = 90)",
)
cte("ar_fit", ("ar_steps",), f"SELECT asset, (lo + hi) / 2 AS phi, {_ar_mean('((lo + hi) / 2)')} AS mu FROM ar_steps")
cte("ar_next", ("ar_x", "ar_fit"), "SELECT asset, pos, mu + coalesce(phi * (before - mu), 0.0) AS s FROM ar_x JOIN ar_fit USING (asset)")
cte("arima_1", (R, "ar_next"), f"SELECT r.asset, r.ts, r.pos, lag(s) OVER (PARTITION BY r.asset ORDER BY r.pos) AS score FROM {R} r LEFT JOIN ar_next a ON a.asset = r.asset AND a.pos = r.pos")

# A search over twenty lookbacks: the candidate goes into the names of assets and into positions, as below.
cte("look", (), "SELECT i AS place, 5 * (i + 1) AS n FROM range(20) t(i)")
cte("look_r", (R, "look"), f"SELECT place || ':' || asset AS asset, ts, place * 1000000 + pos AS pos, price, ret, n FROM {R}, look")
cte("look_m", ("look_r",), f"SELECT *, CASE WHEN count(ret) OVER w >= n THEN sum(ret) OVER w END AS s FROM look_r WINDOW w AS ({AL} ROWS BETWEEN n - 1 PRECEDING AND CURRENT ROW)")
cte("look_s", ("look_m",), f"SELECT asset, ts, pos, price, ret, lag(s) OVER ({AL}) AS score FROM look_m")
ranked("look_w", "look_s")
simulated("look_sim", "look_w")
cte("look_f", ("look_sim", "folds"), "SELECT pos // 1000000 AS place, fold, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(252) ELSE 0.0 END AS sharpe FROM look_sim b JOIN folds ON b.ts = folds.t0 GROUP BY 1, 2")

# Two signals at fixed weights, through the risk model.
cte("mixed", ("z_momentum", "z_ewma"), "SELECT a.asset, a.ts, a.pos, a.price, a.ret, 0.25::DOUBLE * a.score + 0.75::DOUBLE * b.score AS score FROM z_momentum a JOIN z_ewma b USING (asset, pos)")
risk("mixed_w", "mixed")
simulated("mixed_sim", "mixed_w")
equity("mixed_bt", "mixed_sim")

# Walk-forward: a run is a window and a combination of weights.  Its number goes into the names of assets and, times
# a million, into positions, so that every expression above keeps runs apart.
cte("wf_n", ("line_dates",), "SELECT count(*) AS n FROM line_dates")
cte("wf_win", ("wf_n",), "SELECT i AS win, i * 252 AS train_lo, i * 252 + 503 AS train_hi, i * 252 + 503 AS test_lo, i * 252 + 755 AS test_hi FROM wf_n, range(1000) t(i) WHERE i * 252 + 756 <= n")
cte("wf_z", ("z_momentum", "z_ewma"), "SELECT a.asset, a.ts, a.pos, a.price, a.score AS za, b.score AS zb FROM z_momentum a JOIN z_ewma b USING (asset, pos)")
cte("wf_grid", (), "SELECT i AS combo, i * 0.25::DOUBLE AS wa, 1 - i * 0.25::DOUBLE AS wb FROM range(5) t(i)")


def slices(name: str, part: str, runs: str) -> None:
    """Rows of the slice ``part`` of each of ``runs`` (win, run, bounds, weights), with returns begun anew."""
    cte(f"{name}_in", ("wf_z", runs), f"SELECT run || ':' || asset AS asset, ts, run * 1000000 + pos AS pos, price, wa * za + wb * zb AS score FROM wf_z JOIN {runs} ON pos BETWEEN {part}_lo AND {part}_hi")
    cte(name, (f"{name}_in",), f"SELECT asset, ts, pos, price, price / nullif(lag(price) OVER ({AL}), 0) - 1 AS ret, score FROM {name}_in")
    risk(f"{name}_w", name, w="PARTITION BY pos // 1000000 ORDER BY pos")
    simulated(f"{name}_sim", f"{name}_w")


cte("wf_trials", ("wf_win", "wf_grid"), "SELECT *, win * 100 + combo AS run FROM wf_win, wf_grid")
slices("wf_train", "train", "wf_trials")
cte("wf_tried", ("wf_train_sim",), "SELECT pos // 1000000 AS run, avg(net) / stddev_samp(net) AS s FROM wf_train_sim GROUP BY 1 HAVING count(net) >= 20 AND stddev_samp(net) > 1e-12")
cte("wf_best", ("wf_tried",), "SELECT run // 100 AS win, run % 100 AS combo FROM wf_tried QUALIFY row_number() OVER (PARTITION BY run // 100 ORDER BY s DESC, run) = 1")
cte("wf_tests", ("wf_win", "wf_best", "wf_grid"), "SELECT w.*, w.win AS run, coalesce(wa, 0.5) AS wa, coalesce(wb, 0.5) AS wb FROM wf_win w LEFT JOIN wf_best b ON b.win = w.win LEFT JOIN wf_grid g ON g.combo = b.combo")
slices("wf_test", "test", "wf_tests")
cte("wf_oos", ("wf_test_sim",), "SELECT ts, pos % 1000000 AS pos, turnover, net FROM wf_test_sim QUALIFY row_number() OVER (PARTITION BY pos % 1000000 ORDER BY pos) = 1")
equity("wf_bt", "wf_oos")


def newey_west_sql(lags: int, base: str = "bt") -> str:
    terms = "".join(f" + 2 * (1 - {k}.0 / {lags + 1}) * (SELECT sum(a.e * b.e) / any_value(a.n) FROM c a JOIN c b ON a.i = b.i + {k})" for k in range(1, lags + 1))
    rows = f"SELECT row_number() OVER (ORDER BY pos) AS i, net FROM {base} WHERE net IS NOT NULL"
    return f"c AS (SELECT i, net - avg(net) OVER () AS e, count(*) OVER () AS n, avg(net) OVER () AS mean FROM ({rows})), v AS (SELECT (SELECT sum(e * e) / any_value(n) FROM c){terms} AS variance)"
