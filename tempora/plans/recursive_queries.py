"""Queries of the recursive indicators; the SQL steps through each series with a recursive common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import recursive
from tempora.plans import sql as q
from tempora.plans.indicator_queries import _BASE, rounded
from tempora.sources.bars import BARS_SQL, bars_weekly

OUT = ["ema12", "ema26", "macd", "signal", "hist", "keltner_up", "keltner_low", "trix", "chaikin", "garch_vol", "wilder_rsi", "kama", "ewm12", "ema_frac"]


def recursive_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.recursive_indicators(bars_weekly(spark, sf_dir)), OUT)


def parabolic_sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive.parabolic_sar(bars_weekly(spark, sf_dir)).withColumn("sar", F.round("sar", 6))


def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_weekly(spark, sf_dir)
    both = recursive.spectrum(bars).join(recursive.savitzky_golay(bars), ["symbol", "bar_ts"])
    return rounded(both, ["fourier_real", "fourier_imag", "smooth"], 3)


def _ema(v: str, x: str, alpha: str) -> str:
    return f"{alpha} * ({x}) + (1 - {alpha}) * e.{v}"


_E12, _E26 = _ema("ema12", "t.close", "(2.0 / 13)"), _ema("ema26", "t.close", "(2.0 / 27)")
_T1 = _ema("trix1", "t.close", "(2.0 / 15)")
_T2 = _ema("trix2", _T1, "(2.0 / 15)")
_SQL = _BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
t0 AS (SELECT *, coalesce({q.cum('clv')}, 0) AS ad, {q.avg('tr', 14)} AS atr, var_samp(ret) OVER (PARTITION BY symbol) AS long_var, {q.std('ret', 20)} AS vol20 FROM b),
t AS (SELECT *, least(greatest(0.1 * (1 + coalesce(vol20 / nullif(sqrt(long_var), 0), 1.0)), 0.01), 0.99) AS al FROM t0),
e AS (SELECT symbol, n, bar_ts, close::DOUBLE AS ema12, close::DOUBLE AS ema26, close::DOUBLE AS ema20, 0.0::DOUBLE AS macd, 0.0::DOUBLE AS signal, close::DOUBLE AS trix1, close::DOUBLE AS trix2, close::DOUBLE AS trix3, ad::DOUBLE AS ad3, ad::DOUBLE AS ad10, gain::DOUBLE AS up, loss::DOUBLE AS down, long_var::DOUBLE AS garch, close::DOUBLE AS kama, close::DOUBLE AS num, 1.0::DOUBLE AS den, close::DOUBLE AS ema_frac, atr::DOUBLE AS atr FROM t WHERE n = 1
 UNION ALL SELECT t.symbol, t.n, t.bar_ts, {_E12}, {_E26}, {_ema('ema20', 't.close', '(2.0 / 21)')}, ({_E12}) - ({_E26}), {_ema('signal', f'({_E12}) - ({_E26})', '0.2')}, {_T1}, {_T2}, {_ema('trix3', _T2, '(2.0 / 15)')},
 {_ema('ad3', 't.ad', '0.5')}, {_ema('ad10', 't.ad', '(2.0 / 11)')}, t.gain / 14 + 13.0 / 14 * e.up, t.loss / 14 + 13.0 / 14 * e.down, 0.05 * t.long_var + 0.1 * coalesce(t.ret, 0) * coalesce(t.ret, 0) + 0.85 * e.garch, t.al * t.close + (1 - t.al) * e.kama, t.close + 11.0 / 13 * e.num, 1 + 11.0 / 13 * e.den, {_ema('ema_frac', 't.close', '(2.0 / 9.5)')}, t.atr
 FROM e JOIN t ON t.symbol = e.symbol AND t.n = e.n + 1)
SELECT {q.rounded({"ema12": "ema12", "ema26": "ema26", "macd": "macd", "signal": "signal", "hist": "macd - signal", "keltner_up": "ema20 + 2 * atr", "keltner_low": "ema20 - 2 * atr", "trix": f"10000 * (trix3 / nullif({q.lag('trix3')}, 0) - 1)", "chaikin": "ad3 - ad10", "garch_vol": "sqrt(garch)", "wilder_rsi": "CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / nullif(1 + up / nullif(down, 0), 0) END", "kama": "kama", "ewm12": "num / den", "ema_frac": "ema_frac"})} FROM e"""


def _spectral_sql() -> str:
    import math

    import numpy as np

    n = 50
    real = " + ".join(f"{math.cos(2 * math.pi * (n - 1 - k) / n)!r} * {q.lag('close', k) if k else 'close'}" for k in range(n))
    imag = " + ".join(f"{-math.sin(2 * math.pi * (n - 1 - k) / n)!r} * {q.lag('close', k) if k else 'close'}" for k in range(n))
    weights = np.linalg.pinv(np.vander(np.arange(-10, 11), 4, increasing=True).astype(float))[0]
    smooth = " + ".join(f"{float(w)!r} * lead(close, {k}) OVER ({q.P})" for k, w in zip(range(-10, 11), weights, strict=True)).replace("lead(close, -", "lag(close, ")
    return f"WITH {BARS_SQL} SELECT {q.rounded({'fourier_real': real, 'fourier_imag': imag, 'smooth': smooth}, 3)} FROM bars"


def _sar_sql(start: float = 0.02, step: float = 0.02, most: float = 0.2) -> str:
    crossed = "CASE WHEN w.up THEN t.low < w.stop + w.speed * (w.extreme - w.stop) ELSE t.high > w.stop + w.speed * (w.extreme - w.stop) END"
    further = "CASE WHEN w.up THEN t.high > w.extreme ELSE t.low < w.extreme END"
    return f"""WITH RECURSIVE {BARS_SQL}, t AS (SELECT symbol, bar_ts, high::DOUBLE AS high, low::DOUBLE AS low, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n FROM bars),
w AS (SELECT symbol, bar_ts, n, low AS stop, true AS up, {start}::DOUBLE AS speed, high AS extreme FROM t WHERE n = 1
 UNION ALL SELECT t.symbol, t.bar_ts, t.n, CASE WHEN {crossed} THEN w.extreme ELSE w.stop + w.speed * (w.extreme - w.stop) END, CASE WHEN {crossed} THEN NOT w.up ELSE w.up END,
 CASE WHEN {crossed} THEN {start}::DOUBLE WHEN {further} THEN least(w.speed + {step}, {most})::DOUBLE ELSE w.speed END, CASE WHEN {crossed} THEN CASE WHEN w.up THEN t.low ELSE t.high END WHEN {further} THEN CASE WHEN w.up THEN t.high ELSE t.low END ELSE w.extreme END
 FROM w JOIN t ON t.symbol = w.symbol AND t.n = w.n + 1)
SELECT symbol, bar_ts, round(stop, 6) AS sar, (CASE WHEN up THEN 1 ELSE -1 END)::INT AS trend FROM w"""


QUERIES = {"recursive_indicators": recursive_indicators, "parabolic_sar": parabolic_sar, "spectral_features": spectral_features}
ORACLE_SQL = {"recursive_indicators": _SQL, "spectral_features": _spectral_sql(), "parabolic_sar": _sar_sql()}
