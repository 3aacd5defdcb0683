"""Model weights that follow recent errors, from a prediction log (model_id, ts, event_id, period_id, prediction, actual, error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.rolling import div


def _shares(c: Column) -> Column:
    """Shares of one, over one row a model."""
    return div(c, F.sum(c).over(Window.partitionBy(F.lit(1))))


def _newest(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("model_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return log.select("*", F.row_number().over(w).alias("back"), F.count(F.lit(1)).over(Window.partitionBy("model_id")).alias("rows"))


def volatility_adjusted(log: DataFrame, aversion: float = 1.0) -> DataFrame:
    """(model_id, weight): performance, one over the error, by its volatility, to a power."""
    one = log.groupBy("model_id").agg(F.avg("error").alias("mae"), F.stddev_pop("error").alias("volatility"))
    return one.select("model_id", _shares(F.pow(div(F.lit(1.0), "mae") / (F.col("volatility") + 1e-8), F.lit(aversion))).alias("weight"))


def rolling_weights(log: DataFrame, last: int = 10) -> DataFrame:
    """(model_id, period_id, mae, weight): inverse of the mean error of the last evaluations, over the models of a period."""
    folds = log.groupBy("model_id", "period_id").agg(F.avg("error").alias("mae"))
    recent = folds.withColumn("recent", F.avg("mae").over(Window.partitionBy("model_id").orderBy("period_id").rowsBetween(-(last - 1), 0)))
    inverse = div(F.lit(1.0), "recent")
    return recent.select("model_id", "period_id", "mae", div(inverse, F.sum(inverse).over(Window.partitionBy("period_id"))).alias("weight"))


def smoothed_weights(log: DataFrame, last: int = 100, decay: float = 0.95) -> DataFrame:
    """(model_id, old, new, weight): inverse squared errors of all rows, moved towards those of the last ones."""
    marked = _newest(log)
    rmse = lambda c: F.sqrt(F.avg(F.when(c, F.col("error") * F.col("error"))))
    one = marked.groupBy("model_id").agg(rmse(F.lit(True)).alias("all"), rmse(F.col("back") <= last).alias("recent"))
    both = one.select("model_id", _shares(div(F.lit(1.0), "all")).alias("old"), _shares(div(F.lit(1.0), "recent")).alias("new"))
    return both.select("*", _shares(decay * F.col("old") + (1 - decay) * F.col("new")).alias("weight"))


def tail_weights(log: DataFrame, share: float = 0.2) -> DataFrame:
    """(model_id, tail, weight): the exponential of one less the mean relative error over the newest share of rows."""
    tail = _newest(log).where((F.col("back") <= F.ceil(share * F.col("rows"))) & (F.col("actual") != 0))
    one = tail.groupBy("model_id").agg(F.count(F.lit(1)).alias("tail"), F.avg(F.abs(F.col("error") / F.col("actual"))).alias("e"))
    return one.select("model_id", "tail", _shares(F.exp(1 - F.col("e"))).alias("weight"))


def bootstrap_interval(log: DataFrame, replicates: int = 200, level: float = 0.95, seed: int = 7) -> DataFrame:
    """(model_id, mean, low, high): of the mean error, by Poisson resampling: each row counts a Poisson(1) number of times in each
    replicate, drawn from a hash, so a replicate is an aggregate and no sample is collected."""
    u = (F.pmod(F.xxhash64("event_id", "replicate", F.lit(seed)), F.lit(1 << 52)) + 0.5) / (1 << 52)
    bounds, total, term = [], 0.0, 0.36787944117144233  # the distribution of a Poisson(1) number
    for k in range(10):
        total += term
        bounds.append(total)
        term /= k + 1
    times = sum(((u > b).cast("int") for b in bounds[1:]), (u > bounds[0]).cast("int"))
    drawn = log.select("model_id", "event_id", "error", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("times", times).where("times > 0")
    means = drawn.groupBy("model_id", "replicate").agg((F.sum(F.col("times") * F.col("error")) / F.sum("times")).alias("m"))
    out = means.groupBy("model_id").agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"))
    return log.groupBy("model_id").agg(F.avg("error").alias("mean")).join(out, "model_id")
