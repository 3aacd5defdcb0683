"""Recursive indicators as linear scans: v[t] = a[t] * v[t-1] + b[t].

Such a recursion composes: a run of rows is one affine map.  `linear_scan` therefore cuts each series into chunks, runs
the recursion inside every chunk at once, chains only the chunks' maps in order, and adds the carry, so that one very
long series is not one task.  Exponential means, Wilder means, GARCH variance and adaptive means are all linear;
the parabolic SAR is not, and runs per series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import rolling as r
from tempora.operators.indicators import with_base

#: Rows of a series that one chunk holds.
CHUNK = 4096


def linear_scan(df: DataFrame, steps: dict[str, tuple[Column, Column]], chunk: int = CHUNK) -> DataFrame:
    """Adds, for each name, v[t] = a * v[t-1] + b over (symbol, n); where a is 0 or v[t-1] missing, v restarts at b.

    df needs symbol and n, the row number from 1.  A null a or b leaves v as it was.
    """
    names = list(steps)
    keyed = df.withColumn("__chunk", ((F.col("n") - 1) / chunk).cast("long"))
    inputs = keyed.select("*", *[F.coalesce(steps[k][i], F.lit(d)).cast("double").alias(f"{k}__{p}") for k in names for i, p, d in ((0, "v", 1.0), (1, "m", 0.0))])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        values, maps = [f"{k}__v" for k in names], [f"{k}__m" for k in names]
        a, v = pdf[values].to_numpy(float), pdf[maps].to_numpy(float)
        for i in range(1, len(v)):  # all recursions of a row at once
            v[i] += a[i] * v[i - 1]
        pdf[values], pdf[maps] = v, np.cumprod(a, axis=0)
        return pdf

    scanned = inputs.groupBy("symbol", "__chunk").applyInPandas(local, inputs.schema).persist()  # read by the chain and by the result
    last = F.max_by(F.struct(*[f"{k}__{p}" for k in names for p in "vm"]), "n")
    ends = scanned.groupBy("symbol", "__chunk").agg(last.alias("x")).select("symbol", "__chunk", "x.*")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")
        out = {"symbol": pdf["symbol"], "__chunk": pdf["__chunk"]}
        for k in names:
            carry, x = [], 0.0
            for v, m in zip(pdf[f"{k}__v"], pdf[f"{k}__m"], strict=True):
                carry.append(x)
                x = v + m * x
            out[f"{k}__c"] = carry
        return pd.DataFrame(out)

    carries = ends.groupBy("symbol").applyInPandas(chain, "symbol string, __chunk long, " + ", ".join(f"`{k}__c` double" for k in names))
    values = [(F.col(f"{k}__v") + F.col(f"{k}__m") * F.col(f"{k}__c")).alias(k) for k in names]
    return scanned.join(carries, ["symbol", "__chunk"]).select(*df.columns, *values)


def ema(x: str, alpha: float) -> tuple[Column, Column]:
    """Exponential mean without bias correction, from the first value."""
    first = F.col("n") == 1
    return F.when(first, F.lit(0.0)).otherwise(F.lit(1 - alpha)), F.when(first, F.col(x)).otherwise(alpha * F.col(x))


def span(n: float) -> float:
    return 2.0 / (n + 1)


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """MACD, Keltner, TRIX, Chaikin, Wilder RSI, GARCH variance, adaptive and bias-corrected means."""
    base = with_base(bars)
    clv = r.div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))
    gain, loss = F.greatest(F.coalesce("delta", F.lit(0.0)), F.lit(0.0)), F.greatest(-F.coalesce("delta", F.lit(0.0)), F.lit(0.0))
    base = base.select(
        "*", F.coalesce(r.cumulative(clv * F.col("volume")), F.lit(0.0)).alias("ad"), gain.alias("gain"), loss.alias("loss"), r.sma("tr", 14).alias("atr"), F.var_samp("ret").over(r.whole()).alias("long_var"), r.std("ret", 20).alias("vol20")
    )
    base = base.select("*", F.least(F.greatest(0.1 * (1 + F.coalesce(r.div("vol20", F.sqrt("long_var")), F.lit(1.0))), F.lit(0.01)), F.lit(0.99)).alias("alpha_t"))
    first = F.col("n") == 1
    wilder = lambda x: (F.when(first, F.lit(0.0)).otherwise(F.lit(13 / 14)), F.when(first, F.col(x)).otherwise(F.col(x) / 14))
    ret2 = F.pow(F.coalesce("ret", F.lit(0.0)), F.lit(2.0))
    one = linear_scan(
        base,
        {
            "ema12": ema("close", span(12)), "ema26": ema("close", span(26)), "ema20": ema("close", span(20)), "trix1": ema("close", span(14)), "ad3": ema("ad", span(3)), "ad10": ema("ad", span(10)),
            "up": wilder("gain"), "down": wilder("loss"),
            "garch": (F.when(first, F.lit(0.0)).otherwise(F.lit(0.85)), F.when(first, F.col("long_var")).otherwise(0.05 * F.col("long_var") + 0.1 * ret2)),
            "kama": (F.when(first, F.lit(0.0)).otherwise(1 - F.col("alpha_t")), F.when(first, F.col("close")).otherwise(F.col("alpha_t") * F.col("close"))),
            "num12": (F.lit(1 - span(12)), F.col("close")), "den12": (F.lit(1 - span(12)), F.lit(1.0)), "ema_frac": ema("close", span(8.5)),
        },
    )
    two = linear_scan(one.withColumn("macd", F.col("ema12") - F.col("ema26")), {"signal": ema("macd", span(9)), "trix2": ema("trix1", span(14))})
    three = linear_scan(two, {"trix3": ema("trix2", span(14))})
    return three.select(
        "*", (F.col("macd") - F.col("signal")).alias("hist"), (F.col("ema20") + 2 * F.col("atr")).alias("keltner_up"), (F.col("ema20") - 2 * F.col("atr")).alias("keltner_low"),
        (10000 * r.change("trix3")).alias("trix"), (F.col("ad3") - F.col("ad10")).alias("chaikin"), F.sqrt("garch").alias("garch_vol"), r.div("num12", "den12").alias("ewm12"),
        F.when(F.col("down") == 0, F.lit(100.0)).otherwise(100 - r.div(F.lit(100.0), 1 + r.div("up", "down"))).alias("wilder_rsi"),
    )


def parabolic_sar(bars: DataFrame, start: float = 0.02, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """(symbol, bar_ts, sar, trend): the stop follows the extreme point with growing speed and flips when crossed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_ts")
        high, low = pdf["high"].to_numpy(), pdf["low"].to_numpy()
        sar, trend = np.empty(len(pdf)), np.ones(len(pdf), np.int32)
        stop, up, speed, extreme = low[0], True, start, high[0]
        sar[0] = stop
        for i in range(1, len(pdf)):
            stop += speed * (extreme - stop)
            crossed = low[i] < stop if up else high[i] > stop
            if crossed:
                up, stop, speed = not up, extreme, start
                extreme = high[i] if up else low[i]
            else:
                further = high[i] > extreme if up else low[i] < extreme
                if further:
                    extreme, speed = (high[i] if up else low[i]), min(speed + step, most)
            sar[i], trend[i] = stop, 1 if up else -1
        return pd.DataFrame({"symbol": pdf["symbol"], "bar_ts": pdf["bar_ts"], "sar": sar, "trend": trend})

    return bars.groupBy("symbol").applyInPandas(run, "symbol string, bar_ts timestamp_ntz, sar double, trend int")


def spectrum(bars: DataFrame, window: int = 50) -> DataFrame:
    """(symbol, bar_ts, fourier_real, fourier_imag): the first Fourier bin of each window, as weighted sums of lags."""
    import math

    n = F.row_number().over(r.order())
    real, imag = F.lit(0.0), F.lit(0.0)
    for k in range(window):
        at = window - 1 - k
        x = r.lag("close", k)
        real, imag = real + x * math.cos(2 * math.pi * at / window), imag - x * math.sin(2 * math.pi * at / window)
    return bars.select("symbol", "bar_ts", F.when(n >= window, real).alias("fourier_real"), F.when(n >= window, imag).alias("fourier_imag"))


def savitzky_golay(bars: DataFrame, window: int = 21, degree: int = 3) -> DataFrame:
    """(symbol, bar_ts, smooth): centred polynomial smoothing as a fixed weighted sum; null at the edges; looks ahead."""
    half = window // 2
    design = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True).astype(float)
    weights = np.linalg.pinv(design)[0]
    out = F.lit(0.0)
    for k, w in zip(range(-half, half + 1), weights, strict=True):
        out = out + float(w) * (r.lag("close", -k) if k < 0 else r.lead("close", k))
    return bars.select("symbol", "bar_ts", out.alias("smooth"))
