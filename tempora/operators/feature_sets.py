"""Feature families over canonical bars, as tables of declarative expressions in stages.

A stage is a projection: names and SQL expressions over the bars and earlier stages.  Catalyst merges the windows of a
stage (all have one specification) behind a single exchange.  An expression is text, or, where engines spell a
function differently, a pair (Spark, DuckDB); `apply` uses the first, the oracle queries the second.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

Expr = str | tuple[str, str]
P = "PARTITION BY symbol ORDER BY bar_ts"


def over(n: int, end: int = 0) -> str:
    """A frame of n rows that ends `end` rows before the current one."""
    return f"OVER ({P} ROWS BETWEEN {n - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"


def roll(f: str, x: str, n: int, end: int = 0) -> str:
    return f"CASE WHEN count({x}) {over(n, end)} = {n} THEN {f}({x}) {over(n, end)} END"


def avg(x: str, n: int, end: int = 0) -> str:
    return roll("avg", x, n, end)


def std(x: str, n: int, end: int = 0) -> str:
    return roll("stddev_samp", x, n, end)


def total(x: str, n: int) -> str:
    return roll("sum", x, n)


def top(x: str, n: int, end: int = 0) -> str:
    return roll("max", x, n, end)


def bottom(x: str, n: int, end: int = 0) -> str:
    return roll("min", x, n, end)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({P})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({P})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def pct(x: str, n: int = 1) -> str:
    return f"({div(x, lag(x, n))} - 1)"


def z(x: str, n: int) -> str:
    return div(f"{x} - ({avg(x, n)})", std(x, n))


def cum(x: str) -> str:
    return f"sum({x}) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def corr(x: str, y: str, n: int, end: int = 0) -> str:
    both = f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN 1 END"
    w = over(n, end)
    return f"CASE WHEN count({both}) {w} = {n} THEN covar_samp({x}, {y}) {w} / nullif(stddev_samp({x}) {w} * stddev_samp({y}) {w}, 0) END"


def slope(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN regr_slope({x}, CAST(n AS DOUBLE)) {over(n)} END"


def skew(x: str, n: int) -> Expr:
    body = "CASE WHEN count({0}) {1} = {2} THEN {3} END"
    return body.format(x, over(n), n, f"skewness({x}) {over(n)} * {(n * (n - 1)) ** 0.5 / (n - 2)!r}"), body.format(x, over(n), n, f"skewness({x}) {over(n)}")


def kurt(x: str, n: int) -> Expr:
    body = "CASE WHEN count({0}) {1} = {2} THEN {3} END"
    return body.format(x, over(n), n, f"({n + 1} * kurtosis({x}) {over(n)} + 6) * {(n - 1) / ((n - 2) * (n - 3))!r}"), body.format(x, over(n), n, f"kurtosis({x}) {over(n)}")


def quantile(x: str, n: int, q: float, end: int = 0) -> Expr:
    body = "CASE WHEN count({0}) {1} = {2} THEN {3}({0}, {4}) {1} END"
    return tuple(body.format(x, over(n, end), n, f, q) for f in ("percentile", "quantile_cont"))


def rank(x: str, n: int) -> Expr:
    """Percent rank in the frame, ties averaged; the column is first collected under another name."""
    spark = f"(size(filter(collect_list({x}) {over(n)}, v -> v < {x})) + (size(filter(collect_list({x}) {over(n)}, v -> v = {x})) + 1) / 2) / {n}"
    duck = f"(len(list_filter(list({x}) {over(n)}, lambda v: v < {x})) + (len(list_filter(list({x}) {over(n)}, lambda v: v = {x})) + 1) / 2) / {n}"
    return tuple(f"CASE WHEN count({x}) {over(n)} = {n} THEN {e} END" for e in (spark, duck))


def run_group(x: str) -> str:
    """Number of changes of x up to here: the island a row is in."""
    return f"sum(CASE WHEN ({x}) = __before THEN 0 ELSE 1 END) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@dataclass(frozen=True)
class Family:
    """Stages of named expressions; out: the columns that are returned; digits: how the queries round them."""

    stages: tuple[dict[str, Expr], ...]
    out: tuple[str, ...]
    digits: int = 6


BASE: tuple[dict[str, Expr], ...] = (
    {"n": f"row_number() OVER ({P})", "c1": lag("close"), "o1": lag("open"), "v1": lag("volume"), "tp": "(high + low + close) / 3", "total_n": "count(*) OVER (PARTITION BY symbol)"},
    {"ret": div("close", "c1") + " - 1", "lret": "ln(close) - ln(c1)", "delta": "close - c1", "dv": "volume - v1", "vret": div("volume", "v1") + " - 1", "tr": "greatest(high - low, abs(high - c1), abs(low - c1))", "hl": "high - low", "gap": div("open", "c1") + " - 1"},
    {"gain": "CASE WHEN delta > 0 THEN delta ELSE 0.0 END", "loss": "CASE WHEN delta < 0 THEN -delta ELSE 0.0 END", "aret": "abs(ret)", "sgn": "sign(ret)", "ret1": lag("ret"), "lret1": lag("lret")},
)


def rsi(n: int) -> str:
    up, down = avg("gain", n), avg("loss", n)
    return f"CASE WHEN ({down}) = 0 AND ({up}) > 0 THEN 100.0 ELSE 100.0 - 100.0 / nullif(1 + ({up}) / nullif({down}, 0), 0) END"


LN = "ln({0} / nullif({1}, 0))"
FAMILIES: dict[str, Family] = {}

FAMILIES["feature_pipeline"] = Family(
    (
        {**{f"sma{k}": avg("close", k) for k in (5, 10, 20, 50)}, **{f"vol{k}": std("ret", k) for k in (5, 10, 20)}, **{f"rsi{k}": rsi(k) for k in (7, 14, 21)}, "s20": std("close", 20), "vma": avg("volume", 20), **{f"lag{k}": lag("close", k) for k in (1, 2, 3, 5)}, "pvt": cum("ret * volume")},
        {
            **{f"ratio{k}": div("close", f"sma{k}") for k in (5, 10, 20, 50)}, "realised": "vol20 * sqrt(252.0)", "position": div("close - (sma20 - 2 * s20)", "4 * s20"), "width": div("4 * s20", "sma20"), "volume_ratio": div("volume", "vma"),
            "price_position": div("close - low", "hl"), "daily_range": div("hl", "close"), "momentum5": div("close", lag("close", 5)), "sma5_20": div("sma5", "sma20"), "vol10_ratio": div("volume", avg("volume", 10)), "oc_return": div("close - open", "open"),
        },
    ),
    ("ret", "lret", "vol5", "vol10", "vol20", "rsi7", "rsi14", "rsi21", "ratio5", "ratio10", "ratio20", "ratio50", "realised", "position", "width", "volume_ratio", "price_position", "daily_range", "momentum5", "sma5_20", "vol10_ratio", "oc_return", "pvt", "lag1", "lag2", "lag3", "lag5"),
)

_MID = "(high + low) / 2"
FAMILIES["microstructure_spread_flow"] = Family(
    (
        {"spread": div("hl", "close"), "vz": z("volume", 20), "tick": f"CASE WHEN close > {_MID} THEN 1 WHEN close < {_MID} THEN -1 ELSE 0 END", "eff": "2 * aret", "body": div("abs(open - close)", "close"), "prod": "ret * volume"},
        {
            "spread_mean": avg("spread", 10), "spread_std": std("spread", 10), "spread_rank": rank("spread", 20), "signed": "tick * volume", "ofi": "sgn * vz", "vw_ret": div(total("prod", 10), total("volume", 10)),
            "buy": total("CASE WHEN ret > 0 THEN volume ELSE 0.0 END", 10), "sell": total("CASE WHEN ret < 0 THEN volume ELSE 0.0 END", 10), "v10": total("volume", 10),
        },
        {"spread_cv": div("spread_std", "spread_mean"), "net_flow": total("signed", 10), "buy_pressure": div("buy", "v10"), "sell_pressure": div("sell", "v10")},
        {"net_ratio": div("net_flow", "v10"), "flow_momentum": f"net_flow - {lag('net_flow', 10)}"},
    ),
    ("spread", "spread_mean", "spread_std", "spread_cv", "spread_rank", "eff", "body", "vw_ret", "ofi", "tick", "signed", "net_flow", "net_ratio", "flow_momentum", "buy_pressure", "sell_pressure"),
)

FAMILIES["microstructure_impact_volatility"] = Family(
    (
        {
            "intraday": div("close - open", "open"), "gk": f"0.5 * pow({LN.format('high', 'low')}, 2) - (2 * ln(2.0) - 1) * pow({LN.format('close', 'open')}, 2)",
            "rs": f"{LN.format('high', 'open')} * {LN.format('high', 'close')} + {LN.format('low', 'open')} * {LN.format('low', 'close')}", "on_ret": LN.format("open", "c1"), "oc_ret": LN.format("close", "open"),
            "impact": div("ret", "sqrt(volume)"), "amihud": div("aret", "close * volume"), "fut": lead("ret", 5), "cluster": "CASE WHEN close % 1 = 0 THEN 1.0 WHEN (close * 2) % 1 = 0 THEN 0.5 WHEN (close * 4) % 1 = 0 THEN 0.25 ELSE 0.0 END", "s2": roll("sum", "lret", 2),
        },
        {
            "yz": "on_ret * on_ret + (0.34 / (1.34 + (total_n + 1.0) / (total_n - 1.0))) * oc_ret * oc_ret + (1 - 0.34 / (1.34 + (total_n + 1.0) / (total_n - 1.0))) * rs",
            "amihud_mean": avg("amihud", 20), "permanent": corr("ret", "fut", 50), "autocorr": f"CASE WHEN count(ret) {over(20)} = 20 THEN {corr('ret', 'ret1', 19)} END",
            "cov1": f"CASE WHEN n > 50 THEN covar_samp(ret, ret1) {over(49, 1)} END",
            "kyle": f"CASE WHEN n > 50 THEN covar_samp(aret, volume) {over(50, 1)} / nullif(var_pop(volume) {over(50, 1)}, 0) END",
            "vratio": f"CASE WHEN count(lret) {over(20, 1)} = 20 THEN var_pop(s2) {over(19, 1)} / nullif(2 * var_pop(lret) {over(20, 1)}, 0) END",
            "trend": avg("ret", 10), "cv_corr": corr("close", "volume", 20), "intensity": div("volume", avg("volume", 20)), "big": f"CASE WHEN aret > 2 * ({std('ret', 20)}) THEN 1 ELSE 0 END",
        },
        {"roll_spread": "CASE WHEN cov1 < 0 THEN 2 * sqrt(-cov1) WHEN cov1 >= 0 THEN 0.0 END", "noise_x": "ret - trend", "reversal": f"CASE WHEN {lag('big')} = 1 AND sgn = -({lag('sgn')}) THEN 1 WHEN {lag('big')} = 1 THEN 0 END", "open_close": div("close", "open"), "hl_position": div("close - low", "hl"), "vap": "CASE WHEN close = high THEN volume WHEN close = low THEN -volume ELSE 0.0 END", "vslope": slope("volume", 10)},
        {"noise": f"CASE WHEN count(noise_x) {over(50)} = 50 THEN var_samp(noise_x) {over(50)} / nullif(var_samp(trend) {over(50)}, 0) END"},
    ),
    ("intraday", "gap", "impact", "permanent", "gk", "rs", "yz", "autocorr", "vratio", "noise", "cv_corr", "intensity", "cluster", "roll_spread", "reversal", "open_close", "hl_position", "vap", "vslope", "big"),
    5,
)

FAMILIES["bollinger_extended"] = Family(
    (
        {**{f"m{k}": avg("close", k) for k in (10, 20, 50)}, **{f"s{k}": std("close", k) for k in (10, 20, 50)}, "vshort": std("ret", 10), "vlong": std("ret", 50)},
        {**{f"pos{k}_{m}": f"(close - (m{k} - {m} * s{k})) / nullif(2 * {m} * s{k} + 0.0000000001, 0)" for k in (10, 20, 50) for m in (1, 2)}, **{f"width{k}": div(f"4 * s{k}", f"m{k}") for k in (10, 20, 50)}, "touch": "CASE WHEN close >= m20 + 2 * s20 OR close <= m20 - 2 * s20 THEN 1 ELSE 0 END", "adaptive": f"s20 * (0.5 + 0.5 * {div('vshort', 'vlong')})"},
        {"wmean": avg("width20", 50), "wstd": std("width20", 50), "island": cum("touch"), "dpos": f"pos20_2 - {lag('pos20_2')}", "wratio": div("width10", "width50"), "wrank": rank("width20", 50), "wmom": pct("width20"), "wdiff3": f"width20 - {lag('width20', 3)}", "aligned": "CASE WHEN (close > m10) = (close > m20) AND (close > m20) = (close > m50) THEN 1 ELSE 0 END", "ad_up": "m20 + 2 * adaptive", "ad_low": "m20 - 2 * adaptive"},
        {"squeeze": "CASE WHEN width20 < wmean - 0.5 * wstd THEN 1 ELSE 0 END", "squeeze_depth": div("wmean - width20", "wstd"), "since_touch": "row_number() OVER (PARTITION BY symbol, island ORDER BY bar_ts) - 1", "d2pos": f"dpos - {lag('dpos')}", "ad_pos": div("close - ad_low", "ad_up - ad_low")},
    ),
    ("pos10_1", "pos10_2", "pos20_1", "pos20_2", "pos50_1", "pos50_2", "width10", "width20", "width50", "touch", "since_touch", "dpos", "d2pos", "squeeze", "squeeze_depth", "wratio", "wrank", "wmom", "wdiff3", "aligned", "ad_pos"),
    5,
)

_PERIODS = (7, 14, 21)
FAMILIES["rsi_extended"] = Family(
    (
        {f"rsi{k}": rsi(k) for k in _PERIODS},
        {"smooth": avg("rsi14", 5), "zone": "CASE WHEN rsi14 >= 70 THEN 1 WHEN rsi14 <= 30 THEN -1 ELSE 0 END", "velocity": f"rsi14 - {lag('rsi14')}", **{f"slope{k}": slope("rsi14", k) for k in (3, 5, 8)}, "rz": z("rsi14", 20), "rrank": rank("rsi14", 20), "pslope": slope("close", 10), "rslope": slope("rsi14", 10), "spread7_14": "rsi7 - rsi14", "ratio7_14": div("rsi7", "rsi14"), "phase_sin": "sin(2 * pi() * rsi14 / 100)", "phase_cos": "cos(2 * pi() * rsi14 / 100)", "rvol": std("rsi14", 10), "ahead": lead("rsi14")},
        {"zone0": lag("zone"), "acceleration": f"velocity - {lag('velocity')}", "divergence": "CASE WHEN pslope > 0 AND rslope < 0 THEN -1 WHEN pslope < 0 AND rslope > 0 THEN 1 ELSE 0 END", "reversion": "CASE WHEN rz > 2 THEN -1 WHEN rz < -2 THEN 1 ELSE 0 END", "crossed": f"CASE WHEN spread7_14 > 0 AND {lag('spread7_14')} <= 0 THEN 1 WHEN spread7_14 < 0 AND {lag('spread7_14')} >= 0 THEN -1 ELSE 0 END", "peak": f"CASE WHEN rsi14 > {lag('rsi14')} AND rsi14 > ahead THEN 1 ELSE 0 END", "phase": "atan2(phase_sin, phase_cos)", "regime": "CASE WHEN rsi14 > 60 THEN 2 WHEN rsi14 > 40 THEN 1 ELSE 0 END", "vel_sign": "sign(velocity)"},
        {"jerk": f"acceleration - {lag('acceleration')}", "turning": f"CASE WHEN vel_sign <> {lag('vel_sign')} THEN 1 ELSE 0 END", "zone_id": f"sum(CASE WHEN zone = zone0 THEN 0 ELSE 1 END) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
        {"time_in_zone": "row_number() OVER (PARTITION BY symbol, zone_id ORDER BY bar_ts)"},
    ),
    ("rsi7", "rsi14", "rsi21", "smooth", "zone", "time_in_zone", "velocity", "acceleration", "jerk", "slope3", "slope5", "slope8", "turning", "rz", "rrank", "reversion", "divergence", "phase_sin", "phase_cos", "phase", "peak", "spread7_14", "ratio7_14", "crossed", "regime", "rvol"),
)

FAMILIES["micro_patterns"] = Family(
    (
        {**{f"r{k}": pct("close", k) for k in (1, 2, 3)}, **{f"mom{k}": f"close - {lag('close', k)}" for k in (2, 3, 5, 8)}, "body": "close - open", "upper": "high - greatest(open, close)", "lower": "least(open, close) - low", "s3": std("ret", 3), "s5": std("ret", 5), "sgn1": lag("sgn"), "d1": "delta"},
        {"rz": z("r1", 20), "accel": f"d1 - {lag('d1')}", "doji": "CASE WHEN abs(body) < 0.1 * hl THEN 1 ELSE 0 END", "hammer": "CASE WHEN lower > 2 * abs(body) AND upper < abs(body) THEN 1 ELSE 0 END", "star": "CASE WHEN upper > 2 * abs(body) AND lower < abs(body) THEN 1 ELSE 0 END", "gap_up": "CASE WHEN open > c1 THEN 1 ELSE 0 END", "filled": "CASE WHEN open > c1 AND low <= c1 THEN 1 WHEN open < c1 AND high >= c1 THEN 1 ELSE 0 END", "volvol": std("s5", 10), "vratio": div("s3", "s5"), "q80": quantile("s5", 50, 0.8), "run_id": f"sum(CASE WHEN sgn = sgn1 THEN 0 ELSE 1 END) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "flips": total("CASE WHEN sgn <> sgn1 THEN 1 ELSE 0 END", 10), "mcv": div(std("ret", 5), avg("ret", 5)), "mom_vs_vol": div("mom5", "s5")},
        {"jerk": f"accel - {lag('accel')}", "persistence": "row_number() OVER (PARTITION BY symbol, run_id ORDER BY bar_ts)", "turned": f"CASE WHEN sign(accel) <> {lag('sign(accel)')} THEN 1 ELSE 0 END", "clustered": "CASE WHEN s5 > q80 THEN 1 ELSE 0 END", "body_ratio": div("abs(body)", "hl"), "upper_ratio": div("upper", "hl"), "lower_ratio": div("lower", "hl"), "flip_rate": "flips / 10.0"},
    ),
    ("r1", "r2", "r3", "rz", "accel", "jerk", "turned", "persistence", "flip_rate", "doji", "hammer", "star", "gap_up", "filled", "body_ratio", "upper_ratio", "lower_ratio", "s3", "s5", "volvol", "vratio", "clustered"),
)

FAMILIES["liquidity_extended"] = Family(
    (
        {"spread": div("hl", "close"), "impact": div("abs(close - open)", "volume"), "next_open": lead("open"), "pv": "close * volume", **{f"l{k}": lag("ret", k) for k in (1, 2, 3, 5)}, "s2": roll("sum", "lret", 2), "s4": roll("sum", "lret", 4), "amihud": div("aret", "volume")},
        {"spread_ln": div("spread", "ln(volume + 1)"), "spread_rank": rank("spread", 50), "temporary": div("abs(next_open - close)", "close"), **{f"ac{k}": corr("ret", f"l{k}", 50) for k in (1, 2, 3, 5)}, "vr2": f"CASE WHEN count(lret) {over(50)} = 50 THEN var_samp(s2) {over(50)} / nullif(2 * var_samp(lret) {over(50)}, 0) END", "vr4": f"CASE WHEN count(lret) {over(50)} = 50 THEN var_samp(s4) {over(50)} / nullif(4 * var_samp(lret) {over(50)}, 0) END", "vwap20": div(total("pv", 20), total("volume", 20)), "rv_corr": corr("ret", "vret", 50), "vbreak": f"CASE WHEN volume > ({avg('volume', 20)}) + 2 * ({std('volume', 20)}) THEN 1 ELSE 0 END", "buy": "CASE WHEN close > open THEN volume ELSE 0.0 END", "amihud20": avg("amihud", 20), "pv_corr": corr("close", "volume", 10)},
        {"vwap_dev": div("close - vwap20", "vwap20"), "vwap_slope": pct("vwap20", 5), "roll": "CASE WHEN ac1 < 0 THEN 2 * sqrt(-ac1) ELSE 0.0 END", "buy20": div(total("buy", 20), total("volume", 20)), "turnover": div("volume", avg("volume", 50)), "touch": "CASE WHEN low <= vwap20 AND high >= vwap20 THEN 1 ELSE 0 END", "spread_regime": "CASE WHEN spread_rank > 0.8 THEN 2 WHEN spread_rank < 0.2 THEN 0 ELSE 1 END"},
    ),
    ("spread", "spread_ln", "spread_rank", "spread_regime", "temporary", "ac1", "ac2", "ac3", "ac5", "vr2", "vr4", "rv_corr", "pv_corr", "vbreak", "vwap_dev", "vwap_slope", "touch", "roll", "buy20", "turnover"),
    5,
)

_PK = "pow(" + LN.format("high", "low") + ", 2)"
FAMILIES["volatility_extended"] = Family(
    (
        {"s10": std("ret", 10), "s20": std("ret", 20), "s50": std("ret", 50), "pk": f"sqrt(({avg(_PK, 20)}) / (4 * ln(2.0)))", "sk": skew("ret", 20), "ku": kurt("ret", 20), "rv": f"sqrt({total('ret * ret', 20)})", "bv0": f"aret * {lag('aret')}", "var95": quantile("ret", 50, 0.05), "peak": f"max(close) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "growth": cum("ln(1 + ret)"), "eff0": f"abs({total('ret', 20)})", "eff1": total("aret", 20)},
        {"vov": std("s20", 20), "bv": f"(pi() / 2) * ({total('bv0', 20)})", "dd": div("close", "peak") + " - 1", "parametric": f"({avg('ret', 50)}) - 1.645 * s50", **{f"q{int(100 * k)}": quantile("s20", 100, k) for k in (0.2, 0.4, 0.6, 0.8)}, "forecast": f"0.05 * s50 * s50 + 0.1 * ret1 * ret1 + 0.85 * {lag('s20 * s20')}", "vmom": pct("s20", 5), "vrev": div("s20", "s50"), "efficiency": div("eff0", "eff1"), "vslope": slope("s20", 5), "shock": f"CASE WHEN aret > 2 * {lag('s20')} THEN 1 ELSE 0 END", "tail": f"CASE WHEN ret <= var95 THEN ret END"},
        {"jump": "greatest(rv - bv, 0.0)", "dd50": bottom("dd", 50), "vol_regime": "CASE WHEN s20 <= q20 THEN 0 WHEN s20 <= q40 THEN 1 WHEN s20 <= q60 THEN 2 WHEN s20 <= q80 THEN 3 WHEN s20 > q80 THEN 4 END", "fz": z("s20", 50)},
    ),
    ("s10", "s20", "s50", "vov", "pk", "sk", "ku", "rv", "bv", "jump", "var95", "parametric", "dd", "dd50", "vol_regime", "forecast", "vmom", "vrev", "vslope", "fz", "efficiency", "shock"),
    5,
)

FAMILIES["calendar_harmonics"] = Family(
    (
        {"hour": "hour(bar_ts)", "month": "month(bar_ts)", "quarter": "quarter(bar_ts)", "dom": "day(bar_ts)", "dow": ("weekday(bar_ts)", "isodow(bar_ts) - 1"), "week": ("weekofyear(bar_ts)", "weekofyear(bar_ts)"), "year": "year(bar_ts)"},
        {**{f"month_{f}{k}": f"{f}(2 * pi() * {k} * month / 12)" for f in ("sin", "cos") for k in (1, 2, 3)}, **{f"dow_{f}1": f"{f}(2 * pi() * dow / 7)" for f in ("sin", "cos")}, "is_month_start": "CASE WHEN dom = 1 THEN 1 ELSE 0 END", "is_month_end": ("CASE WHEN day(last_day(bar_ts)) = dom THEN 1 ELSE 0 END", "CASE WHEN day(last_day(bar_ts)) = dom THEN 1 ELSE 0 END"), "is_quarter_start": "CASE WHEN dom = 1 AND month % 3 = 1 THEN 1 ELSE 0 END", "is_year_start": "CASE WHEN dom = 1 AND month = 1 THEN 1 ELSE 0 END", **{f"cycle{k}": f"sin(2 * pi() * (n - 1) / {k})" for k in (5, 20, 60)}},
    ),
    ("hour", "month", "quarter", "dom", "dow", "week", "month_sin1", "month_sin2", "month_sin3", "month_cos1", "month_cos2", "month_cos3", "dow_sin1", "dow_cos1", "is_month_start", "is_month_end", "is_quarter_start", "is_year_start", "cycle5", "cycle20", "cycle60"),
)

_LEVELS = (0.236, 0.382, 0.5, 0.618)
FAMILIES["precision_features"] = Family(
    (
        {**{f"ma{k}": avg("close", k) for k in (8, 13, 21, 34, 55)}, "level": "floor(close / 10) * 10", "z20": z("close", 20), "prank": rank("close", 20), "med": quantile("close", 20, 0.5), "q25": quantile("close", 20, 0.25), "q75": quantile("close", 20, 0.75), "hi": top("high", 20), "lo": bottom("low", 20), "vpt": cum(f"volume * ({div('delta', 'c1')})"), "force": "delta * volume", **{f"pct{k}": pct("close", k) for k in (2, 3, 5, 10, 20, 50)}, "time_corr": corr("close", "CAST(n AS DOUBLE)", 20), "atr14": avg("tr", 14), "support": bottom("close", 20, 1), "resistance": top("close", 20, 1), "pos_flow": total("CASE WHEN delta > 0 THEN 1 ELSE 0 END", 10), "logp": "ln(close)", "rootp": "sqrt(close)"},
        {**{f"ratio{k}": div("close", f"ma{k}") for k in (8, 13, 21, 34, 55)}, "iqr": div("q75 - q25", "med"), "mad_pos": div("close - med", "q75 - q25"), **{f"fib{int(1000 * k)}": div(f"close - (hi - {k} * (hi - lo))", "close") for k in _LEVELS}, "force13": div(avg("force", 13), "close"), "maslope": div(f"ma21 - {lag('ma21', 5)}", "ma21"), "atr_norm": div("atr14", "close"), "sup_dist": div("close - support", "close"), "res_dist": div("resistance - close", "close"), "roc_ratio": div("pct5", "pct20"), "up_share": "pos_flow / 10.0", "interaction": "z20 * pct5", "higher_high": f"CASE WHEN high > {lag('high')} AND low > {lag('low')} THEN 1 WHEN high < {lag('high')} AND low < {lag('low')} THEN -1 ELSE 0 END"},
    ),
    ("ratio8", "ratio13", "ratio21", "ratio34", "ratio55", "level", "z20", "prank", "iqr", "mad_pos", "fib236", "fib382", "fib500", "fib618", "maslope", "atr_norm", "sup_dist", "res_dist", "roc_ratio", "up_share", "interaction", "time_corr", "higher_high", "pct2", "pct3", "pct5", "pct10", "pct20", "pct50", "logp", "rootp"),
    5,
)

FAMILIES["engineered_features"] = Family(
    (
        {"doji": "CASE WHEN abs(close - open) / nullif(open, 0) < 0.001 THEN 1 ELSE 0 END", "hammer": "CASE WHEN least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < 0.5 * abs(close - open) THEN 1 ELSE 0 END", "engulf": f"CASE WHEN c1 < o1 AND close > open AND open < c1 AND close > o1 THEN 1 WHEN c1 > o1 AND close < open AND open > c1 AND close < o1 THEN -1 ELSE 0 END", "sup": div(bottom("close", 20, 1), "close"), "res": div(top("close", 20, 1), "close"), "strength": corr("CAST(n AS DOUBLE)", "close", 20), "le_rank": (f"CASE WHEN count(close) {over(20)} = 20 THEN size(filter(collect_list(close) {over(20)}, v -> v <= close)) / 20 END", f"CASE WHEN count(close) {over(20)} = 20 THEN len(list_filter(list(close) {over(20)}, lambda v: v <= close)) / 20 END"), "z50": f"CASE WHEN ({std('close', 50)}) = 0 THEN 0.0 ELSE {z('close', 50)} END", "sk": skew("ret", 20), "ku": kurt("ret", 20), "mn": avg("ret", 20), "parkinson": f"sqrt(({total(_PK, 20)}) / (4 * ln(2.0) * 20))", "vprev": div("volume", avg("volume", 20, 1)), "cvc": corr("close", "volume", 20), "vol10": std("ret", 10), **{f"f{k}": lead("ret", k) for k in (1, 2)}},
        {"vol_regime": "CASE WHEN vol10 < avg(vol10) OVER (PARTITION BY symbol) - stddev_samp(vol10) OVER (PARTITION BY symbol) THEN 0 WHEN vol10 > avg(vol10) OVER (PARTITION BY symbol) + stddev_samp(vol10) OVER (PARTITION BY symbol) THEN 2 WHEN vol10 IS NOT NULL THEN 1 END", "ac_ahead1": corr("ret", "f1", 20), "ac_ahead2": corr("ret", "f2", 20), "vov": std("vol10", 10)},
    ),
    ("doji", "hammer", "engulf", "sup", "res", "strength", "le_rank", "z50", "sk", "ku", "mn", "parkinson", "vprev", "cvc", "vol_regime", "ac_ahead1", "ac_ahead2", "vov"),
    5,
)

_PREV = f"OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
FAMILIES["regimes"] = Family(
    (
        {"cumret": f"CASE WHEN count(ret) {over(20, 1)} = 20 THEN exp(sum(ln(1 + ret)) {over(20, 1)}) - 1 END", "vol20": std("ret", 20, 1), "m1": avg("close", 20, 1), "m2": avg("close", 20, 21), "s1": std("close", 20, 1), "s2": std("close", 20, 21), "slope20": f"CASE WHEN count(close) {over(20, 1)} = 20 THEN regr_slope(close, CAST(n AS DOUBLE)) {over(20, 1)} END", "r2": f"CASE WHEN count(close) {over(20, 1)} = 20 THEN regr_r2(close, CAST(n AS DOUBLE)) {over(20, 1)} END"},
        {"market": "CASE WHEN vol20 > 0.5 THEN 2 WHEN cumret > 0.05 THEN 1 WHEN cumret < -0.05 THEN -1 WHEN cumret IS NOT NULL THEN 0 END", "ql": (f"percentile(vol20, 0.25) {_PREV}", f"quantile_cont(vol20, 0.25) {_PREV}"), "qh": (f"percentile(vol20, 0.75) {_PREV}", f"quantile_cont(vol20, 0.75) {_PREV}"), "broke": "CASE WHEN abs(m1 - m2) > 2 * s2 OR s1 > 2 * s2 OR s1 < 0.5 * s2 THEN 1 WHEN m2 IS NOT NULL THEN 0 END", "trend": div("slope20", "m1")},
        {"vol_regime": "CASE WHEN vol20 > qh THEN 2 WHEN vol20 < ql THEN 0 WHEN ql IS NOT NULL AND vol20 IS NOT NULL THEN 1 END", "market0": lag("market"), "trend_regime": "CASE WHEN r2 > 0.5 AND trend > 0 THEN 1 WHEN r2 > 0.5 AND trend < 0 THEN -1 WHEN r2 IS NOT NULL THEN 0 END"},
        {"spell": f"sum(CASE WHEN market = market0 THEN 0 ELSE 1 END) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "stayed": "CASE WHEN market0 IS NOT NULL THEN CAST(CASE WHEN market = market0 THEN 1 ELSE 0 END AS DOUBLE) END"},
        {"persistence": "row_number() OVER (PARTITION BY symbol, spell ORDER BY bar_ts)", "stay_probability": "avg(stayed) OVER (PARTITION BY symbol, market0 ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"},
    ),
    ("cumret", "vol20", "market", "persistence", "vol_regime", "trend", "r2", "trend_regime", "broke", "stay_probability"),
    5,
)


def apply(bars: DataFrame, family: str) -> DataFrame:
    """bars with a family's columns; each stage is one projection."""
    for stage in BASE + FAMILIES[family].stages:
        bars = bars.selectExpr("*", *[f"{e if isinstance(e, str) else e[0]} AS `{k}`" for k, e in stage.items()])
    return bars
