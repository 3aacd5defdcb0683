"""Queries of the indicator families, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import indicators
from tempora.plans import sql as q
from tempora.sources.bars import BARS_SQL, bars_weekly


def rounded(df: DataFrame, columns: list[str], digits: int = 4, keys: tuple[str, ...] = ("symbol", "bar_ts")) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in columns])


_BASE = f"""WITH {BARS_SQL},
b1 AS (SELECT *, row_number() OVER ({q.P}) AS n, close - {q.lag('close')} AS delta, close / nullif({q.lag('close')}, 0) - 1 AS ret, ln(close) - ln({q.lag('close')}) AS log_ret,
 (high + low + close) / 3 AS tp, greatest(high - low, abs(high - {q.lag('close')}), abs(low - {q.lag('close')})) AS tr, {q.lag('close')} AS prev_close,
 high - {q.lag('high')} AS d_high, low - {q.lag('low')} AS d_low, (high + low) / 2 - {q.lag('(high + low) / 2')} AS d_mid FROM bars),
b AS (SELECT *, tp - {q.lag('tp')} AS d_tp, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain, CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss,
 CASE WHEN d_high > -d_low AND d_high > 0 THEN d_high ELSE 0 END AS dm_up, CASE WHEN -d_low > d_high AND -d_low > 0 THEN -d_low ELSE 0 END AS dm_down,
 close - least(low, coalesce(prev_close, low)) AS bp, ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS clv FROM b1)"""


def _rsi(n: int) -> str:
    up, down = q.avg("gain", n), q.avg("loss", n)
    return f"CASE WHEN ({down}) = 0 AND ({up}) > 0 THEN 100 ELSE 100 - 100 / nullif(1 + ({up}) / nullif({down}, 0), 0) END"


TREND = ["sma_10", "sma_20", "sma_50", "sma_200", "wma_10", "bb_mid", "bb_up", "bb_low", "tenkan", "kijun", "senkou_a", "senkou_b", "chikou", "don_up", "don_low", "don_mid", "vwap", "atr"]
OSCILLATORS = ["rsi_14", "rsi_21", "rsi_28", "stoch_k", "stoch_d", "williams", "cci", "mfi", "aroon_up", "aroon_down", "aroon_osc", "plus_di", "minus_di", "adx", "ultimate", "momentum", "roc", "bb_width", "bb_pos", "cross_signal"]
VOLUME = ["obv", "accumulation", "volume_roc", "ease", "hist_vol", "vol_of_vol"]


def technical_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: trend indicators of weekly bars."""
    return rounded(indicators.technical(bars_weekly(spark, sf_dir)), TREND, 5)


def oscillators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.technical(bars_weekly(spark, sf_dir)), OSCILLATORS)


def volume_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.technical(bars_weekly(spark, sf_dir)), VOLUME)


VARIANTS = "sma_back std_pop bbp_up bbp_low stoch_flat williams_flat rsi_full cci_flat atr_late obv_seeded vwap_safe momentum_diff roc_safe std_10 var_10 slope_10 pivot r1 s1 r2 s2 r3 s3".split()


def indicator_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rounded(indicators.variants(bars_weekly(spark, sf_dir)), VARIANTS, 5)
    return df.withColumn("var_10", F.round("var_10", 0))


def _wma(n: int) -> str:
    return "(" + " + ".join(f"{n - k} * {q.lag('close', k) if k else 'close'}" for k in range(n)) + f") / {n * (n + 1) / 2}"


def _mid(n: int) -> str:
    return f"(({q.high('high', n)}) + ({q.low('low', n)})) / 2"


def _mad(n: int) -> str:
    return f"CASE WHEN count(tp) {q.over(n)} = {n} THEN list_sum(list_transform(list(tp) {q.over(n)}, lambda v: abs(v - tp_mean))) / {n} END"


_TREND_SQL = f"""{_BASE}, c AS (SELECT *, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS mid52, {q.avg('close', 20)} AS m20, {q.std('close', 20)} AS s20 FROM b)
SELECT {q.rounded({
    **{f"sma_{n}": q.avg('close', n) for n in (10, 20, 50, 200)}, "wma_10": _wma(10), "bb_mid": "m20", "bb_up": "m20 + 2 * s20", "bb_low": "m20 - 2 * s20", "tenkan": "tenkan", "kijun": "kijun",
    "senkou_a": q.lag("(tenkan + kijun) / 2", 26), "senkou_b": q.lag("mid52", 26), "chikou": f"lead(close, 26) OVER ({q.P})", "don_up": q.high("high", 20), "don_low": q.low("low", 20), "don_mid": f"(({q.high('high', 20)}) + ({q.low('low', 20)})) / 2",
    "vwap": f"({q.cum('tp * volume')}) / nullif({q.cum('volume')}, 0)", "atr": q.avg("tr", 14)}, 5)} FROM c"""

_OSC_SQL = f"""{_BASE}, c AS (SELECT *, avg(tp) {q.over(20)} AS tp_mean, {q.avg('close', 20)} AS m20, {q.std('close', 20)} AS s20, 100 * (close - {q.low('low', 14)}) / nullif(({q.high('high', 14)}) - ({q.low('low', 14)}), 0) AS stoch_k,
 CASE WHEN d_tp > 0 THEN tp * volume ELSE 0 END AS mf_up, CASE WHEN d_tp < 0 THEN tp * volume ELSE 0 END AS mf_down,
 100 * ({q.avg('dm_up', 14)}) / nullif({q.avg('tr', 14)}, 0) AS plus_di, 100 * ({q.avg('dm_down', 14)}) / nullif({q.avg('tr', 14)}, 0) AS minus_di, ({q.avg('close', 10)}) - ({q.avg('close', 20)}) AS gap FROM b),
d0 AS (SELECT *, list(tp) {q.over(20)} AS tps, CASE WHEN count(high) {q.over(14)} = 14 THEN arg_max(n, {{'a': high, 'b': -n}}) {q.over(14)} END AS top, CASE WHEN count(low) {q.over(14)} = 14 THEN arg_min(n, {{'a': low, 'b': n}}) {q.over(14)} END AS bottom,
 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx, {q.total('mf_up', 14)} AS up14, {q.total('mf_down', 14)} AS down14, {q.lag('gap')} AS gap0 FROM c),
d AS (SELECT *, CASE WHEN len(tps) = 20 THEN list_sum(list_transform(tps, lambda v: abs(v - tp_mean))) / 20 END AS mad FROM d0)
SELECT {q.rounded({
    "rsi_14": _rsi(14), "rsi_21": _rsi(21), "rsi_28": _rsi(28), "stoch_k": "stoch_k", "stoch_d": q.avg("stoch_k", 3), "williams": f"-100 * (({q.high('high', 14)}) - close) / nullif(({q.high('high', 14)}) - ({q.low('low', 14)}), 0)",
    "cci": "(tp - tp_mean) / nullif(0.015 * mad, 0)", "mfi": "CASE WHEN down14 = 0 AND up14 > 0 THEN 100 ELSE 100 - 100 / nullif(1 + up14 / nullif(down14, 0), 0) END",
    "aroon_up": "100.0 * (14 - (n - top)) / 14", "aroon_down": "100.0 * (14 - (n - bottom)) / 14", "aroon_osc": "100.0 * (14 - (n - top)) / 14 - 100.0 * (14 - (n - bottom)) / 14",
    "plus_di": "plus_di", "minus_di": "minus_di", "adx": q.avg("dx", 14),
    "ultimate": f"100 * (4 * ({q.total('bp', 7)}) / nullif({q.total('tr', 7)}, 0) + 2 * ({q.total('bp', 14)}) / nullif({q.total('tr', 14)}, 0) + ({q.total('bp', 28)}) / nullif({q.total('tr', 28)}, 0)) / 7",
    "momentum": f"close / nullif({q.lag('close', 10)}, 0) - 1", "roc": f"100 * (close / nullif({q.lag('close', 10)}, 0) - 1)", "bb_width": "((m20 + 2 * s20) - (m20 - 2 * s20)) / nullif(m20, 0)", "bb_pos": "(close - (m20 - 2 * s20)) / nullif((m20 + 2 * s20) - (m20 - 2 * s20), 0)",
    "cross_signal": "CASE WHEN gap > 0 AND gap0 <= 0 THEN 1 WHEN gap < 0 AND gap0 >= 0 THEN -1 ELSE 0 END"})} FROM d"""

_VOLUME_SQL = f"""{_BASE}, c AS (SELECT *, {q.std('ret', 20)} AS vol20, d_mid / nullif(volume / nullif(high - low, 0), 0) AS eom FROM b)
SELECT {q.rounded({"obv": q.cum("sign(coalesce(delta, 0)) * volume"), "accumulation": q.cum("clv"), "volume_roc": f"100 * (volume / nullif({q.lag('volume', 14)}, 0) - 1)", "ease": q.avg("eom", 14), "hist_vol": "vol20 * sqrt(252)", "vol_of_vol": q.std("vol20", 20)})} FROM c"""

_VARIANT_SQL = f"""{_BASE}, c AS (SELECT *, {q.avg('close', 20)} AS m20, {q.agg('stddev_pop({})', 'close', 20)} AS p20, {q.low('low', 14)} AS l14, {q.high('high', 14)} AS h14, list(tp) {q.over(20)} AS tps, {q.avg('tp', 20)} AS tp_mean,
 CASE WHEN delta IS NULL THEN NULL ELSE gain END AS g, CASE WHEN delta IS NULL THEN NULL ELSE loss END AS l FROM b),
d AS (SELECT *, CASE WHEN len(tps) = 20 THEN list_sum(list_transform(tps, lambda v: abs(v - tp_mean))) / 20 END AS mad, {q.avg('g', 14)} AS up, {q.avg('l', 14)} AS down FROM c)
SELECT {q.rounded({
    "sma_back": f"first_value(m20 IGNORE NULLS) OVER ({q.P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "std_pop": "p20", "bbp_up": "m20 + 2 * p20", "bbp_low": "m20 - 2 * p20",
    "stoch_flat": "CASE WHEN h14 = l14 THEN 50 ELSE 100 * (close - l14) / nullif(h14 - l14, 0) END", "williams_flat": "CASE WHEN h14 = l14 THEN -50 ELSE -100 * (h14 - close) / nullif(h14 - l14, 0) END",
    "rsi_full": "CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / nullif(1 + up / nullif(down, 0), 0) END", "cci_flat": "CASE WHEN mad = 0 THEN 0 ELSE (tp - tp_mean) / nullif(0.015 * mad, 0) END", "atr_late": f"CASE WHEN n > 14 THEN {q.avg('tr', 14)} END",
    "obv_seeded": q.cum("CASE WHEN n = 1 THEN volume ELSE sign(delta) * volume END"), "vwap_safe": f"coalesce(({q.cum('tp * volume')}) / nullif({q.cum('volume')}, 0), tp)", "momentum_diff": f"close - {q.lag('close', 10)}",
    "roc_safe": f"CASE WHEN n > 10 THEN coalesce(100 * (close / nullif({q.lag('close', 10)}, 0) - 1), 0) END", "std_10": q.std("close", 10), "var_10": f"round({q.agg('var_samp({})', 'close', 10)}, 0)", "slope_10": f"CASE WHEN count(close) {q.over(10)} = 10 THEN regr_slope(close, n) {q.over(10)} END",
    "pivot": "tp", "r1": "2 * tp - low", "s1": "2 * tp - high", "r2": "tp + high - low", "s2": "tp - high + low", "r3": "high + 2 * (tp - low)", "s3": "low - 2 * (high - tp)"}, 5)} FROM d"""

QUERIES = {"technical_indicators": technical_indicators, "oscillators": oscillators, "volume_volatility": volume_volatility, "indicator_variants": indicator_variants}
ORACLE_SQL = {"technical_indicators": _TREND_SQL, "oscillators": _OSC_SQL, "volume_volatility": _VOLUME_SQL, "indicator_variants": _VARIANT_SQL}
