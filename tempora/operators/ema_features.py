"""Feature sets of exponential means: several MACDs, and slopes, ratios, relations and momentum of fractional-period means.

The means are linear scans over (symbol, n, bar_ts, close) alone; everything else is windows along the symbol's time.  A window
value is null until its frame is full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import rolling as r
from tempora.functions.rolling import div
from tempora.operators.recursive import ema, linear_scan, span

#: (fast, slow, signal) of the MACDs, and the periods of the fractional means: fixed values.
MACDS = ((8, 17, 9), (12, 26, 9), (19, 39, 9), (5, 13, 8), (21, 55, 13))
PERIODS = (2.5, 3.7, 5.2, 7.8, 10.3, 13.6, 18.4, 25.1, 34.2)


def _named(period: float) -> str:
    return str(period).replace(".", "_")


def _series(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "bar_ts", "close", F.row_number().over(r.order()).alias("n"))


def _weighted(x: str, n: int) -> tuple[Column, Column]:
    """The sum of x by powers of a span's decay; see _mean."""
    return F.lit(1 - span(n)), F.col(x)


def _mean(total: str, n: int) -> Column:
    """The bias-corrected mean: that sum over the sum of the weights, which is a geometric series and 1 at first."""
    a = span(n)
    return F.when(F.col("n") == 1, F.col(total)).otherwise(F.col(total) * a / (1 - F.pow(F.lit(1 - a), F.col("n").cast("double"))))


def multi_macd(bars: DataFrame, configs: tuple = MACDS) -> DataFrame:
    """Of each (fast, slow, signal): MACD, signal and histogram by the close, cross, histogram change, a sine of the histogram by its
    deviation over 50 rows, and first and second differences of the MACD."""
    spans = sorted({x for f, s, _ in configs for x in (f, s)})
    one = linear_scan(_series(bars), {f"e{x}": _weighted("close", x) for x in spans})
    one = one.select("symbol", "bar_ts", "close", "n", *[(_mean(f"e{f}", f) - _mean(f"e{s}", s)).alias(f"m{f}_{s}") for f, s, _ in configs])
    two = linear_scan(one, {f"t{f}_{s}": _weighted(f"m{f}_{s}", g) for f, s, g in configs})
    two = two.select("*", *[_mean(f"t{f}_{s}", g).alias(f"s{f}_{s}") for f, s, g in configs])
    two = two.select("*", *[(F.col(f"m{f}_{s}") - F.col(f"s{f}_{s}")).alias(f"h{f}_{s}") for f, s, _ in configs])
    two = two.select("*", *[r.diff(f"m{f}_{s}").alias(f"v{f}_{s}") for f, s, _ in configs])
    out = {}
    for f, s, _ in configs:
        k = f"{f}_{s}"
        out |= {
            f"macd_{k}": div(f"m{k}", "close"), f"signal_{k}": div(f"s{k}", "close"), f"histogram_{k}": div(f"h{k}", "close"), f"cross_{k}": (F.col(f"m{k}") > F.col(f"s{k}")).cast("int"), f"momentum_{k}": r.diff(f"h{k}"),
            f"cycle_{k}": F.sin(2 * math.pi * div(f"h{k}", r.std(f"h{k}", 50))), f"velocity_{k}": F.col(f"v{k}"), f"acceleration_{k}": r.diff(f"v{k}"),
        }
    return two.select("symbol", "bar_ts", *[c.alias(k) for k, c in out.items()])


def fractional_means(bars: DataFrame, periods: tuple = PERIODS) -> DataFrame:
    """(symbol, bar_ts, close, n, e of each period): exponential means from the first close."""
    return linear_scan(_series(bars), {f"e{_named(p)}": ema("close", span(p)) for p in periods}).select("symbol", "bar_ts", "close", "n", *[f"e{_named(p)}" for p in periods])


def _same_sign(x: str, n: int = 5) -> Column:
    """Share of the last n rows whose sign is the current one's."""
    sign = F.signum(x)
    count = lambda s: F.sum((sign == s).cast("int")).over(r.frame(n)) / n
    return r.full(F.col(x), n, F.when(sign > 0, count(1)).when(sign < 0, count(-1)).otherwise(count(0)))


def mean_derivatives(bars: DataFrame, periods: tuple = PERIODS) -> DataFrame:
    """Of each mean: slope over two rows, curvature, their sizes, the slope's consistency, and changes of the curvature's sign."""
    names = [_named(p) for p in periods]
    df = fractional_means(bars, periods)
    df = df.select("*", *[r.diff(f"e{k}", 2).alias(f"slope_{k}") for k in names])
    df = df.select("*", *[r.diff(f"slope_{k}").alias(f"curvature_{k}") for k in names])
    return df.select(
        "symbol", "bar_ts", *[f"slope_{k}" for k in names], *[f"curvature_{k}" for k in names], *[F.abs(f"slope_{k}").alias(f"strength_{k}") for k in names], *[_same_sign(f"slope_{k}").alias(f"consistency_{k}") for k in names],
        *[(F.signum(f"curvature_{k}") != r.lag(F.signum(f"curvature_{k}"))).cast("int").alias(f"inflection_{k}") for k in names],
    )


def price_to_means(bars: DataFrame, periods: tuple = PERIODS) -> DataFrame:
    """Of each mean: the close by it, the deviation, its z over 20 rows, the distance in deviations of the close, and rows spent above and below."""
    df = fractional_means(bars, periods)
    names = [_named(p) for p in periods]
    df = df.select("*", *[(div("close", f"e{k}") - 1).alias(f"deviation_{k}") for k in names])
    since = lambda c: F.when(c, F.col("n") - F.coalesce(F.max(F.when(~c, F.col("n"))).over(r.up_to()), F.lit(0))).otherwise(0)
    out = {}
    for p, k in zip(periods, names, strict=True):
        close, mean = F.col("close"), F.col(f"e{k}")
        out |= {
            f"ratio_{k}": div("close", f"e{k}"), f"deviation_{k}": F.col(f"deviation_{k}"), f"zscore_{k}": F.col(f"deviation_{k}") / (r.std(f"deviation_{k}", 20) + 1e-10), f"distance_{k}": (close - mean) / (r.std("close", int(p)) + 1e-10),
            f"rows_above_{k}": since(close > mean), f"rows_below_{k}": since(close < mean),
        }
    return df.select("symbol", "bar_ts", *[c.alias(k) for k, c in out.items()])


def mean_relations(bars: DataFrame, periods: tuple = PERIODS) -> DataFrame:
    """Of each two neighbouring means: which is above, its change, their distance by the close, its change, and whether they converge."""
    df = fractional_means(bars, periods)
    names = [_named(p) for p in sorted(periods)]
    both = list(zip(names, names[1:], strict=False))
    df = df.select("*", *[div(F.col(f"e{a}") - F.col(f"e{b}"), F.col("close")).alias(f"distance_{a}") for a, b in both], *[(F.col(f"e{a}") > F.col(f"e{b}")).cast("int").alias(f"above_{a}") for a, b in both])
    out = {}
    for a, _ in both:
        d = F.col(f"distance_{a}")
        out |= {f"above_{a}": F.col(f"above_{a}"), f"crossed_{a}": r.diff(f"above_{a}"), f"distance_{a}": d, f"distance_change_{a}": r.diff(f"distance_{a}"), f"converging_{a}": F.coalesce((F.abs(d) < F.abs(r.lag(f"distance_{a}"))).cast("int"), F.lit(0))}
    return df.select("symbol", "bar_ts", *[c.alias(k) for k, c in out.items()])


def mean_momentum(bars: DataFrame, periods: tuple = PERIODS) -> DataFrame:
    """Of each mean: relative change, its change, its consistency, against the close's change, and by its volatility."""
    df = fractional_means(bars, periods)
    names = [_named(p) for p in periods]
    df = df.select("*", r.change("close").alias("ret"), *[r.change(f"e{k}").alias(f"momentum_{k}") for k in names])
    out = {}
    for p, k in zip(periods, names, strict=True):
        m = F.col(f"momentum_{k}")
        out |= {f"momentum_{k}": m, f"acceleration_{k}": r.diff(f"momentum_{k}"), f"consistency_{k}": _same_sign(f"momentum_{k}"), f"against_price_{k}": m - F.col("ret"), f"by_volatility_{k}": m / (r.std("ret", int(p)) + 1e-10)}
    return df.select("symbol", "bar_ts", *[c.alias(k) for k, c in out.items()])
