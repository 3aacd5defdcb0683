"""Validation of returns, feature vectors, training rows, portfolio weights, date ranges and parameters.  Issues are names in an array."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import rolling as r
from tempora.functions.rolling import div


def issues(*found: tuple[str, Column]) -> Column:
    """The names of the conditions that hold, joined by a semicolon; a null condition does not hold."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, name) for name, c in found])), ";")


def return_outliers(bars: DataFrame, most: float = 3.0) -> DataFrame:
    """(symbol, bar_ts, ret, z): returns more than `most` sample deviations from their symbol's mean."""
    whole = Window.partitionBy("symbol")
    ret = bars.select("symbol", "bar_ts", r.change("close").alias("ret"))
    z = ret.withColumn("z", div(F.col("ret") - F.avg("ret").over(whole), F.stddev_samp("ret").over(whole)))
    return z.where(F.abs("z") > most)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def feature_vector_issues(features: Column) -> Column:
    """Issues of an array of numbers: empty, null, not a number, infinite."""
    return issues(("empty", F.size(features) == 0), ("null", F.exists(features, lambda x: x.isNull())), ("nan", F.exists(features, lambda x: F.coalesce(F.isnan(x), F.lit(False)))), ("infinite", F.exists(features, lambda x: F.coalesce(F.abs(x) == float("inf"), F.lit(False)))))


def training_issues(open_: Column, high: Column, low: Column, close: Column, volume: Column, features: Column, target: Column) -> Column:
    """Issues of one training row: those of the bar, of the features, and of the target."""
    bar = issues(("price", (F.least(open_, high, low, close) <= 0) | F.greatest(open_, high, low, close).isNull()), ("range", (high < F.greatest(open_, close, low)) | (low > F.least(open_, close, high))), ("volume", volume < 0))
    return F.concat_ws(";", *[F.when(x != "", x) for x in (bar, feature_vector_issues(features), issues(("target", ~_finite(target))))])


def weight_issues(weights: DataFrame) -> DataFrame:
    """(portfolio, assets, total, negative, status, issues): weights sum to 1; 1e-6 apart warns, 0.01 apart is an error, negative ones warn."""
    out = weights.groupBy("portfolio").agg(F.count(F.lit(1)).alias("assets"), F.sum("weight").alias("total"), F.count_if(F.col("weight") < 0).alias("negative"))
    off = F.abs(F.col("total") - 1)
    status = F.when(off > 0.01, "error").when((off > 1e-6) | (F.col("negative") > 0), "warning").otherwise("valid")
    return out.select("*", status.alias("status"), issues(("sum", off > 0.01), ("sum_rounded", (off > 1e-6) & (off <= 0.01)), ("negative", F.col("negative") > 0)).alias("issues"))


def date_range_issues(start: Column, end: Column, now: Column) -> Column:
    """Issues of a date range: start not before end, end in the future, shorter than a day."""
    return issues(("order", start >= end), ("future", end > now), ("short", (start < end) & (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp")) < 86_400_000_000)))


def parameter_issues(name: str, value: object, least: float | None = None, most: float | None = None, integer: bool = False) -> list[str]:
    """Issues of one numeric parameter, on the driver."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or (isinstance(value, float) and not math.isfinite(value)):
        return [f"{name} must be a finite number"]
    out = [f"{name} must be a whole number"] if integer and float(value) != int(value) else []
    if least is not None and value < least:
        out.append(f"{name} must be at least {least}")
    if most is not None and value > most:
        out.append(f"{name} must be at most {most}")
    return out
