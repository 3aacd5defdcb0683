"""What follows a regime label: smoothing, distribution, performance and transitions.

Logs have (symbol, bar_ts, regime, prediction, actual).  Every window runs along one symbol's time, or one symbol's and
regime's, so all operators are one exchange and a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import rolling as r
from tempora.functions.rolling import div


def labelled_log(bars: DataFrame, n: int = 10, band: float = 0.05) -> DataFrame:
    """A log over bars: the last return predicts the next one; the regime is the close against its mean over n rows."""
    base = bars.select("symbol", "bar_ts", "close", r.change("close").alias("actual"), r.sma("close", n).alias("mean"))
    base = base.select("*", r.lag("actual").alias("prediction")).where("mean is not null and prediction is not null and actual is not null")
    regime = F.when(F.col("close") > (1 + band) * F.col("mean"), "bull").when(F.col("close") < (1 - band) * F.col("mean"), "bear").otherwise("sideways")
    return base.select("symbol", "bar_ts", regime.alias("regime"), "prediction", "actual")


def smoothed(log: DataFrame, n: int = 3) -> DataFrame:
    """(symbol, bar_ts, regime, smoothed, confidence_factor): a label gives way where the n before it agree on another; 0.8 of the confidence is left then."""
    before = r.order().rowsBetween(-n, -1)
    least, most = F.min("regime").over(before), F.max("regime").over(before)
    found = log.select("symbol", "bar_ts", "regime", F.when((F.count("regime").over(before) == n) & (least == most) & (least != F.col("regime")), least).alias("other"))
    return found.select("symbol", "bar_ts", "regime", F.coalesce("other", "regime").alias("smoothed"), F.when(F.col("other").isNull(), 1.0).otherwise(0.8).alias("confidence_factor"))


def distribution(log: DataFrame) -> DataFrame:
    """(symbol, regime, rows, percent)."""
    counted = log.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("percent", 100.0 * F.col("rows") / F.sum("rows").over(Window.partitionBy("symbol")))  # one row a regime


def performance(log: DataFrame) -> DataFrame:
    """Errors, direction, Sharpe, drawdown of the compounded predictions, and win rate by symbol and regime."""
    inside = Window.partitionBy("symbol", "regime").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, 0)
    level = log.withColumn("level", F.exp(F.sum(F.log1p("prediction")).over(inside)))
    level = level.withColumn("drawdown", F.col("level") / F.max("level").over(inside) - 1)
    e, p = F.col("prediction") - F.col("actual"), F.col("prediction")
    return level.groupBy("symbol", "regime").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.to_date("bar_ts")).alias("periods"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg((F.signum("prediction") == F.signum("actual")).cast("double"))).alias("direction"),
        F.coalesce(div(F.avg(p), F.stddev_pop(p)) * 252**0.5, F.lit(0.0)).alias("sharpe"),
        F.abs(F.min("drawdown")).alias("max_drawdown"),
        F.avg((p > 0).cast("double")).alias("win_rate"),
        F.avg(p).alias("mean_return"),
        (F.stddev_pop(p) * 252**0.5).alias("volatility"),
    )


def summary(log: DataFrame) -> DataFrame:
    """(symbol, rows, mae, direction, regimes, best, worst): best and worst regime by mean absolute error."""
    one = performance(log)
    weighted = lambda c: F.sum(F.col(c) * F.col("rows")) / F.sum("rows")
    return one.groupBy("symbol").agg(
        F.sum("rows").alias("rows"), weighted("mae").alias("mae"), weighted("direction").alias("direction"), F.count(F.lit(1)).alias("regimes"),
        F.min_by("regime", F.struct("mae", "regime")).alias("best"), F.max_by("regime", F.struct("mae", "regime")).alias("worst"),
    )


def transitions(log: DataFrame, n: int = 10) -> DataFrame:
    """(symbol, bar_ts, from_regime, to_regime, before_mae, after_mae, change): errors of the old regime in the n rows before a
    change, and of the new one in the n rows from it."""
    entry = F.struct("regime", F.abs(F.col("prediction") - F.col("actual")).alias("e"))
    near = log.select(
        "symbol", "bar_ts", r.lag("regime").alias("from_regime"), F.col("regime").alias("to_regime"),
        F.collect_list(entry).over(r.order().rowsBetween(-n, -1)).alias("before"), F.collect_list(entry).over(r.order().rowsBetween(0, n - 1)).alias("after"),
    ).where("from_regime != to_regime")

    def mean(xs: str, regime: str):
        own = F.filter(xs, lambda x: x["regime"] == F.col(regime))
        return F.aggregate(own, F.lit(0.0), lambda s, x: s + x["e"]) / F.size(own)

    found = near.select("symbol", "bar_ts", "from_regime", "to_regime", mean("before", "from_regime").alias("before_mae"), mean("after", "to_regime").alias("after_mae"))
    return found.withColumn("change", F.col("after_mae") - F.col("before_mae"))


def routed(log: DataFrame, least: int = 50) -> DataFrame:
    """(symbol, bar_ts, regime, forecast, own_model): a line of actual on prediction for each symbol and regime of `least` rows or more,
    and one of the whole symbol for the others."""
    fitted = lambda *by: log.groupBy(*by).agg(F.regr_slope("actual", "prediction").alias("a"), F.regr_intercept("actual", "prediction").alias("b"), F.count(F.lit(1)).alias("n"))
    own = fitted("symbol", "regime").where(F.col("n") >= least).select("symbol", "regime", F.struct("a", "b").alias("own"))
    whole = fitted("symbol").select("symbol", F.struct("a", "b").alias("whole"))
    both = log.join(own, ["symbol", "regime"], "left").join(whole, "symbol")
    model = F.coalesce("own", "whole")
    return both.select("symbol", "bar_ts", "regime", (model["a"] * F.col("prediction") + model["b"]).alias("forecast"), F.col("own").isNotNull().cast("int").alias("own_model"))
