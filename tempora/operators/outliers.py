"""Outlier masks over (symbol, bar_ts, y): 1 keeps a row.  `strictness` in 0..1 narrows every fence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import rolling as r
from tempora.functions.rolling import div


def global_masks(df: DataFrame, strictness: float = 0.5) -> DataFrame:
    """z, modified z, quartile and percentile masks, and all of them together."""
    low, high = (5 + 10 * strictness) / 100, (95 - 10 * strictness) / 100
    stats = df.groupBy("symbol").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"), F.percentile("y", F.array(F.lit(0.15), F.lit(0.5), F.lit(0.85), F.lit(low), F.lit(high))).alias("q"))
    mad = df.join(stats, "symbol").groupBy("symbol").agg(F.percentile(F.abs(F.col("y") - F.col("q")[1]), F.lit(0.5)).alias("mad"))
    y, k = F.col("y"), 2 - strictness
    spread = 0.5 * k * (F.col("q")[2] - F.col("q")[0])
    out = df.join(stats, "symbol").join(mad, "symbol").select(
        "symbol", "bar_ts", "y",
        (F.abs(div(y - F.col("m"), "sd")) < 1.0 * k).cast("int").alias("z_keep"),
        (F.abs(0.6745 * div(y - F.col("q")[1], "mad")) < 1.5 * k).cast("int").alias("mad_keep"),
        y.between(F.col("q")[0] - spread, F.col("q")[2] + spread).cast("int").alias("iqr_keep"),
        y.between(F.col("q")[3], F.col("q")[4]).cast("int").alias("pct_keep"),
    )
    return out.withColumn("keep", F.least("z_keep", "mad_keep", "iqr_keep", "pct_keep"))


def temporal_masks(df: DataFrame) -> DataFrame:
    """Local median, spike, trend and regime masks."""
    local = r.order().rowsBetween(-10, 9)
    base = df.select(
        "symbol", "bar_ts", "y", F.row_number().over(r.order()).alias("n"), F.percentile("y", F.lit(0.5)).over(local).alias("med"), F.collect_list("y").over(local).alias("ys"),
        ((r.lag("y", 1) + r.lag("y", 2)) / 2).alias("left"), ((r.lead("y", 1) + r.lead("y", 2)) / 2).alias("right"), F.stddev_pop("y").over(r.whole()).alias("sd"), (div("y", r.lag("y")) - 1).alias("ret"),
    )
    spread = F.transform("ys", lambda v: F.abs(v - F.col("med")))
    ordered = F.array_sort(spread)
    k = F.size(ordered)
    mad = (F.get(ordered, F.floor((k - 1) / 2).cast("int")) + F.get(ordered, F.floor(k / 2).cast("int"))) / 2
    past = r.order().rowsBetween(-5, -1)
    x = F.col("n").cast("double")
    base = base.select("*", mad.alias("mad"), F.when(F.count("y").over(past) == 5, F.regr_intercept("y", x).over(past) + F.regr_slope("y", x).over(past) * x).alias("expected"), r.std("ret", 10).alias("vol"))
    base = base.withColumn("p70", F.percentile("vol", F.lit(0.7)).over(r.whole())).withColumn("wild", F.coalesce((F.col("vol") > F.col("p70")).cast("int"), F.lit(0)))
    return base.select(
        "symbol", "bar_ts", (F.abs(F.col("y") - F.col("med")) <= 2 * F.col("mad")).cast("int").alias("local_keep"),
        F.coalesce((~((F.abs(F.col("y") - F.col("left")) > 1 * F.col("sd")) & (F.abs(F.col("y") - F.col("right")) > 1 * F.col("sd")))).cast("int"), F.lit(1)).alias("spike_keep"),
        F.coalesce((F.abs(F.col("y") - F.col("expected")) <= 2 * F.col("sd")).cast("int"), F.lit(1)).alias("trend_keep"), (1 - F.max("wild").over(r.order().rowsBetween(-14, 5))).alias("regime_keep"),
    )


def runs(df: DataFrame) -> DataFrame:
    """(symbol, runs, longest, mean): runs of dropped rows."""
    marked = global_masks(df).withColumn("gone", 1 - F.col("keep"))
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    islands = marked.withColumn("b", F.lag("gone").over(w)).withColumn("i", F.sum(F.when(F.col("gone") == F.col("b"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.where("gone = 1").groupBy("symbol", "i").agg(F.count(F.lit(1)).alias("length")).groupBy("symbol").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.avg("length").alias("mean"))
