"""Relations across symbols over time: volatility spillover, changes of correlation, quality scores, adaptive correlation weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import rolling as r
from tempora.functions.rolling import div
from tempora.operators.alignment import pairs
from tempora.operators.cross_asset import safe_corr, with_returns


def spillover(bars: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, bar_ts, mean_other, most_other, spillover): volatilities of the other symbols at the time, and the rolling correlation
    of their mean with the symbol's own.  The others' mean comes from sums over the time's row of symbols."""
    vol = bars.select("symbol", "bar_ts", r.change("close").alias("ret")).select("symbol", "bar_ts", r.std("ret", n).alias("vol")).where("vol is not null")
    at = Window.partitionBy("bar_ts")  # one row a symbol
    others = F.count(F.lit(1)).over(at) - 1
    ranked = vol.select("*", div(F.sum("vol").over(at) - F.col("vol"), others).alias("mean_other"), F.max(F.struct("vol", "symbol")).over(at).alias("first"))
    second = F.max(F.when(F.col("symbol") != F.col("first.symbol"), F.col("vol"))).over(at)
    ranked = ranked.select("symbol", "bar_ts", "vol", "mean_other", F.when(F.col("symbol") == F.col("first.symbol"), second).otherwise(F.col("first.vol")).alias("most_other"))
    w = r.frame(n)
    return ranked.select("symbol", "bar_ts", "mean_other", "most_other", F.when(F.count("mean_other").over(w) == n, safe_corr("vol", "mean_other", w)).alias("spillover"))


def correlation_changes(bars: DataFrame, n: int = 20, back: int = 10, threshold: float = 0.3) -> DataFrame:
    """(a, b, bar_ts, corr, change): times at which a pair's rolling correlation is more than the threshold from that `back` rows before."""
    w = Window.partitionBy("a", "b").orderBy("bar_ts")
    both = pairs(with_returns(bars))
    frame = w.rowsBetween(-(n - 1), 0)
    both = both.withColumn("corr", F.when(F.count("x").over(frame) == n, safe_corr("x", "y", frame)))
    both = both.withColumn("change", F.col("corr") - F.lag("corr", back).over(w))
    return both.where(F.abs("change") > threshold).select("a", "b", "bar_ts", "corr", "change")


def quality(bars: DataFrame) -> DataFrame:
    """(symbol, stability, max_drawdown, positive, skew, score): stability of returns, depth of falls, share of rises, skewness."""
    level = bars.select("symbol", "bar_ts", r.change("close").alias("ret"), (F.col("close") / F.max("close").over(r.up_to()) - 1).alias("drawdown"))
    one = level.groupBy("symbol").agg((1 / (1 + F.stddev_samp("ret"))).alias("stability"), F.min("drawdown").alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("positive"), F.skewness("ret").alias("skew"))
    return one.withColumn("score", 0.3 * F.col("stability") + 0.3 * (1 + F.col("max_drawdown")) + 0.2 * F.col("positive") + 0.2 * (0.5 + F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("skew") / 4))))


def adaptive_weights(bars: DataFrame, target: str, n: int = 20, blend: float = 0.3) -> DataFrame:
    """(symbol, correlation, stability, weight): the other symbols by their correlation with the target, more where it is stable,
    moved by `blend` from even weights."""
    both = pairs(with_returns(bars)).where((F.col("a") == target) | (F.col("b") == target))
    both = both.select(F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a")).alias("symbol"), "bar_ts", "x", "y")
    w = r.frame(n)
    both = both.withColumn("rolling", F.when(F.count("x").over(w) == n, safe_corr("x", "y", w)))
    one = both.groupBy("symbol").agg(safe_corr("x", "y").alias("correlation"), F.greatest(F.lit(0.0), 1 - F.coalesce(F.stddev_pop("rolling"), F.lit(0.0))).alias("stability"))
    whole = Window.partitionBy(F.lit(1))  # one row a symbol
    raw = F.abs("correlation") * (0.7 + 0.3 * F.col("stability"))
    return one.select("*", ((1 - blend) / F.count(F.lit(1)).over(whole) + blend * div(raw, F.sum(raw).over(whole))).alias("weight"))


def trend_forecast(bars: DataFrame, steps: int = 7) -> DataFrame:
    """(symbol, bar_ts, step, forecast): at every seventh row, the close moved on by the drift of the 5-row mean against the 20-row one."""
    base = bars.select("symbol", "bar_ts", "close", F.row_number().over(r.order()).alias("n"), (div(r.sma("close", 5), r.sma("close", 20)) - 1).alias("drift"))
    weekly = base.where((F.col("n") % 7 == 0) & F.col("drift").isNotNull())
    return weekly.select("symbol", "bar_ts", "close", "drift", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).select("symbol", "bar_ts", "step", (F.col("close") * F.pow(1 + F.col("drift") / steps, F.col("step").cast("double"))).alias("forecast"))


def kendall(bars: DataFrame) -> DataFrame:
    """(a, b, tau): Kendall's tau-b of every two symbols' returns; a group holds two columns of one pair and compares them a row at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        total = tied_x = tied_y = 0.0
        for i in range(1, len(x)):
            dx, dy = np.sign(x[:i] - x[i]), np.sign(y[:i] - y[i])
            total, tied_x, tied_y = total + float((dx * dy).sum()), tied_x + float((dx == 0).sum()), tied_y + float((dy == 0).sum())
        n = len(x) * (len(x) - 1) / 2
        scale = np.sqrt((n - tied_x) * (n - tied_y))
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "tau": [total / scale if scale else np.nan]})

    return pairs(with_returns(bars)).select("a", "b", "x", "y").groupBy("a", "b").applyInPandas(run, "a string, b string, tau double")


def ledoit_wolf(bars: DataFrame) -> DataFrame:
    """(a, b, cov, shrinkage): the population covariance of returns at times that all symbols have, shrunk towards an even diagonal by
    the Ledoit-Wolf intensity, which needs only each time's sum of squares."""
    returns = with_returns(bars).where("ret is not null").select("symbol", "bar_ts", "ret")
    symbols = F.broadcast(returns.agg(F.count_distinct("symbol").alias("p")))  # one row
    whole = returns.groupBy("bar_ts").agg(F.count(F.lit(1)).alias("n")).join(symbols).where("n = p").select("bar_ts", "p")
    centred = returns.join(whole, "bar_ts").withColumn("x", F.col("ret") - F.avg("ret").over(Window.partitionBy("symbol")))
    other = centred.select("bar_ts", F.col("symbol").alias("b"), F.col("x").alias("y"))
    cov = centred.select("bar_ts", F.col("symbol").alias("a"), "x", "p").join(other, "bar_ts").groupBy("a", "b").agg(F.avg(F.col("x") * F.col("y")).alias("s"), F.max("p").alias("p"))
    square = centred.groupBy("bar_ts").agg(F.sum(F.col("x") * F.col("x")).alias("q")).agg(F.avg(F.col("q") * F.col("q")).alias("fourth"), F.count(F.lit(1)).alias("n"))
    sums = cov.agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))) / F.max("p")).alias("mu"), F.sum(F.col("s") * F.col("s")).alias("norm"))
    both = cov.join(F.broadcast(sums)).join(F.broadcast(square))
    delta = F.col("norm") - F.col("p") * F.col("mu") * F.col("mu")
    rho = F.least(F.lit(1.0), F.greatest(F.lit(0.0), div((F.col("fourth") - F.col("norm")) / F.col("n"), delta)))
    return both.select("a", "b", ((1 - rho) * F.col("s") + F.when(F.col("a") == F.col("b"), rho * F.col("mu")).otherwise(0.0)).alias("cov"), rho.alias("shrinkage"))
