"""Queries of the feature sets of exponential means; their SQL weighs every earlier close by powers, row against row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import ema_features as e
from tempora.sources.bars import BARS_SQL, bars_weekly


def _of(operator, digits: int = 5):
    def run(spark, sf_dir) -> DataFrame:
        df = operator(bars_weekly(spark, sf_dir))
        return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})

    return run


QUERIES = {"multi_macd": _of(e.multi_macd), "ema_derivatives": _of(e.mean_derivatives, 3), "price_ema_ratios": _of(e.price_to_means), "ema_relations": _of(e.mean_relations), "ema_momentum": _of(e.mean_momentum)}
_W = "OVER (PARTITION BY symbol ORDER BY bar_ts)"
_N = [str(p).replace(".", "_") for p in e.PERIODS]
_T = f"WITH {BARS_SQL}, t AS (SELECT symbol, bar_ts, close, row_number() {_W} AS n FROM bars)"


def _back(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY bar_ts ROWS {n - 1} PRECEDING)"


def _std(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_back(n)} = {n} THEN stddev_samp({x}) {_back(n)} END"


def _ema(p: float, name: str) -> str:
    a = 2 / (p + 1)
    return f"sum(b.close * CASE WHEN b.n = 1 THEN pow({1 - a!r}, a.n - 1) ELSE {a!r} * pow({1 - a!r}, a.n - b.n) END) AS e{name}"


def _ewm(x: str, n: int) -> str:
    q = 1 - 2 / (n + 1)
    return f"sum(b.{x} * pow({q!r}, a.n - b.n)) / sum(pow({q!r}, a.n - b.n))"


def _same(x: str) -> str:
    return f"CASE WHEN count({x}) {_back(5)} = 5 THEN len(list_filter(list({x}) {_back(5)}, lambda v: sign(v) = sign({x}))) / 5 END"


_E = f"{_T}, e AS (SELECT a.symbol, a.bar_ts, a.close, a.n, {', '.join(_ema(p, k) for p, k in zip(e.PERIODS, _N, strict=True))} FROM t a JOIN t b ON b.symbol = a.symbol AND b.n <= a.n GROUP BY 1, 2, 3, 4)"


def _select(columns: dict[str, str], table: str, digits: int = 5, whole: tuple[str, ...] = ()) -> str:
    return "SELECT symbol, bar_ts, " + ", ".join(f"{v} AS {k}" if k.startswith(whole) else f"round({v}, {digits}) AS {k}" for k, v in columns.items()) + f" FROM {table}"


def _macd_sql() -> str:
    spans = sorted({x for f, s, _ in e.MACDS for x in (f, s)})
    names = [f"{f}_{s}" for f, s, _ in e.MACDS]
    join = "FROM {0} a JOIN {0} b ON b.symbol = a.symbol AND b.n <= a.n GROUP BY 1, 2, 3, 4"
    head = f"{_T}, x AS (SELECT a.symbol, a.bar_ts, a.close, a.n, {', '.join(f'{_ewm("close", s)} AS e{s}' for s in spans)} {join.format('t')}), m AS (SELECT *, {', '.join(f'e{f} - e{s} AS m{f}_{s}' for f, s, _ in e.MACDS)} FROM x)"
    head += f", g AS (SELECT a.symbol, a.bar_ts, a.close, a.n, {', '.join(f'any_value(a.m{f}_{s}) AS m{f}_{s}, {_ewm(f"m{f}_{s}", k)} AS s{f}_{s}' for f, s, k in e.MACDS)} {join.format('m')}), h AS (SELECT *, {', '.join(f'm{k} - s{k} AS h{k}, m{k} - lag(m{k}) {_W} AS v{k}' for k in names)} FROM g)"
    out = {}
    for k in names:
        out |= {
            f"macd_{k}": f"m{k} / close", f"signal_{k}": f"s{k} / close", f"histogram_{k}": f"h{k} / close", f"cross_{k}": f"(m{k} > s{k})::INT", f"momentum_{k}": f"h{k} - lag(h{k}) {_W}",
            f"cycle_{k}": f"sin(2 * pi() * h{k} / nullif({_std(f'h{k}', 50)}, 0))", f"velocity_{k}": f"v{k}", f"acceleration_{k}": f"v{k} - lag(v{k}) {_W}",
        }
    return f"{head} {_select(out, 'h', whole=('cross_',))}"


def _derivative_sql() -> str:
    head = f"{_E}, s AS (SELECT *, {', '.join(f'e{k} - lag(e{k}, 2) {_W} AS slope_{k}' for k in _N)} FROM e), c AS (SELECT *, {', '.join(f'slope_{k} - lag(slope_{k}) {_W} AS curvature_{k}' for k in _N)} FROM s)"
    out = {f"slope_{k}": f"slope_{k}" for k in _N} | {f"curvature_{k}": f"curvature_{k}" for k in _N} | {f"strength_{k}": f"abs(slope_{k})" for k in _N} | {f"consistency_{k}": _same(f"slope_{k}") for k in _N}
    return f"{head} {_select(out | {f'inflection_{k}': f'(sign(curvature_{k}) <> lag(sign(curvature_{k})) {_W})::INT' for k in _N}, 'c', 3, ('inflection_',))}"


def _price_sql() -> str:
    head = f"{_E}, d AS (SELECT *, {', '.join(f'close / e{k} - 1 AS deviation_{k}' for k in _N)} FROM e)"
    out = {}
    for p, k in zip(e.PERIODS, _N, strict=True):
        run = lambda op, k=k: f"CASE WHEN close {op} e{k} THEN n - coalesce(max(CASE WHEN NOT close {op} e{k} THEN n END) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END::INT"
        out |= {f"ratio_{k}": f"close / e{k}", f"deviation_{k}": f"deviation_{k}", f"zscore_{k}": f"deviation_{k} / ({_std(f'deviation_{k}', 20)} + 1e-10)", f"distance_{k}": f"(close - e{k}) / ({_std('close', int(p))} + 1e-10)", f"rows_above_{k}": run(">"), f"rows_below_{k}": run("<")}
    return f"{head} {_select(out, 'd', whole=('rows_',))}"


def _relation_sql() -> str:
    both = list(zip(_N, _N[1:], strict=False))
    head = f"{_E}, d AS (SELECT *, {', '.join(f'(e{a} - e{b}) / close AS distance_{a}, (e{a} > e{b})::INT AS above_{a}' for a, b in both)} FROM e)"
    out = {}
    for a, _ in both:
        out |= {f"above_{a}": f"above_{a}", f"crossed_{a}": f"above_{a} - lag(above_{a}) {_W}", f"distance_{a}": f"distance_{a}", f"distance_change_{a}": f"distance_{a} - lag(distance_{a}) {_W}", f"converging_{a}": f"coalesce((abs(distance_{a}) < abs(lag(distance_{a}) {_W}))::INT, 0)"}
    return f"{head} {_select(out, 'd', whole=('above_', 'crossed_', 'converging_'))}"


def _momentum_sql() -> str:
    head = f"{_E}, m AS (SELECT *, close / lag(close) {_W} - 1 AS ret, {', '.join(f'e{k} / lag(e{k}) {_W} - 1 AS momentum_{k}' for k in _N)} FROM e)"
    out = {}
    for p, k in zip(e.PERIODS, _N, strict=True):
        out |= {f"momentum_{k}": f"momentum_{k}", f"acceleration_{k}": f"momentum_{k} - lag(momentum_{k}) {_W}", f"consistency_{k}": _same(f"momentum_{k}"), f"against_price_{k}": f"momentum_{k} - ret", f"by_volatility_{k}": f"momentum_{k} / ({_std('ret', int(p))} + 1e-10)"}
    return f"{head} {_select(out, 'm')}"


ORACLE_SQL = {"multi_macd": _macd_sql(), "ema_derivatives": _derivative_sql(), "price_ema_ratios": _price_sql(), "ema_relations": _relation_sql(), "ema_momentum": _momentum_sql()}
