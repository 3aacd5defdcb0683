"""Validation, cleaning, scaling, splitting and sequence windows over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import rolling as r

PRICES = ("open", "high", "low", "close")


def validation(bars: DataFrame) -> DataFrame:
    """One row for each symbol: counts of broken rules (nulls, order of prices, negatives, jumps, duplicate times, gaps)."""
    marked = bars.select("*", F.abs(r.change("close")).alias("jump"), r.lag("bar_ts").alias("before"), F.count(F.lit(1)).over(Window.partitionBy("symbol", "bar_ts")).alias("same"))
    days = F.datediff("bar_ts", "before")
    marked = marked.withColumn("days", days)
    usual = marked.groupBy("symbol").agg(F.mode("days", True).alias("usual"))
    broken = {
        "null_prices": F.greatest(*[F.col(c).isNull().cast("int") for c in PRICES]) == 1,
        "high_below_low": F.col("high") < F.col("low"),
        "open_outside": (F.col("open") > F.col("high")) | (F.col("open") < F.col("low")),
        "close_outside": (F.col("close") > F.col("high")) | (F.col("close") < F.col("low")),
        "negative": F.least(*[F.col(c) for c in (*PRICES, "volume")]) < 0,
        "jumps": F.col("jump") > 0.5,
        "duplicate_times": F.col("same") > 1,
        "gaps": F.col("days") > 2 * F.col("usual"),
    }
    return marked.join(usual, "symbol").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), *[F.count_if(c).alias(k) for k, c in broken.items()])


def issue_list(bars: DataFrame) -> DataFrame:
    """(symbol, issue): a row for each kind of issue that a symbol has."""
    found = validation(bars)
    kinds = [c for c in found.columns if c not in ("symbol", "bars")]
    return found.select("symbol", F.explode(F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in kinds]))).alias("issue"))


def quality_score(bars: DataFrame) -> DataFrame:
    """(symbol, missing_pct, quality): share of missing cells, and 1 less that."""
    cells = [*PRICES, "volume"]
    missing = sum((F.count_if(F.col(c).isNull()) for c in cells[1:]), F.count_if(F.col(cells[0]).isNull()))
    share = missing / (F.count(F.lit(1)) * len(cells))
    return bars.groupBy("symbol").agg(share.alias("missing_pct"), F.greatest(F.lit(0.0), 1 - share).alias("quality"))


def drop_duplicates_first(bars: DataFrame, order: str) -> DataFrame:
    """The first row by `order` of each (symbol, bar_ts)."""
    w = Window.partitionBy("symbol", "bar_ts").orderBy(order)
    return bars.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def fences(bars: DataFrame, column: str, multiple: float = 1.5) -> DataFrame:
    """Per symbol: quartiles, fences, mean and deviation of a column; one row a symbol."""
    q = F.percentile(column, F.array(F.lit(0.05), F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    stats = bars.groupBy("symbol").agg(q.alias("q"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.stddev_pop(column).alias("sd_pop"), F.min(column).alias("least"), F.max(column).alias("most"))
    spread = F.col("q")[3] - F.col("q")[1]
    return stats.select("symbol", "mean", "sd", "sd_pop", "least", "most", F.col("q")[0].alias("p05"), F.col("q")[1].alias("q1"), F.col("q")[2].alias("median"), F.col("q")[3].alias("q3"), F.col("q")[4].alias("p95"), (F.col("q")[1] - multiple * spread).alias("low_fence"), (F.col("q")[3] + multiple * spread).alias("high_fence"))


def clean(bars: DataFrame, column: str = "close") -> DataFrame:
    """A column flagged and handled in every way: flags by fences and z-score, capped, winsorised, scaled three ways."""
    stats = fences(bars, column)
    x = F.col(column)
    z = r.div(x - F.col("mean"), "sd")
    return bars.join(stats, "symbol").select(
        "symbol",
        "bar_ts",
        ((x < F.col("low_fence")) | (x > F.col("high_fence"))).cast("int").alias("iqr_outlier"),
        (F.abs(z) > 3).cast("int").alias("z_outlier"),
        F.least(F.greatest(x, "low_fence"), "high_fence").alias("capped"),
        F.least(F.greatest(x, "p05"), "p95").alias("winsorised"),
        r.div(x - F.col("least"), F.col("most") - F.col("least")).alias("min_max"),
        r.div(x - F.col("mean"), "sd_pop").alias("standard"),
        r.div(x - F.col("median"), F.col("q3") - F.col("q1")).alias("robust"),
        (r.div(x - F.col("least"), F.col("most") - F.col("least")) * (F.col("most") - F.col("least")) + F.col("least")).alias("inverse"),
    )


def targets(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """Simple and log returns, next close, next return and direction (0 where nothing follows), and the split of a row."""
    ahead = r.lead("close", horizon)
    n, k = F.count(F.lit(1)).over(Window.partitionBy("symbol")), F.row_number().over(r.order())
    split = F.when(k <= F.floor(n * 0.7), "train").when(k <= F.floor(n * 0.85), "validation").otherwise("test")
    return bars.select("symbol", "bar_ts", r.change("close").alias("simple"), r.log_return("close").alias("log_return"), ahead.alias("next_close"), (r.div(ahead, "close") - 1).alias("next_return"), F.coalesce((ahead > F.col("close")).cast("int"), F.lit(0)).alias("direction"), split.alias("split"))


def sequences(bars: DataFrame, length: int = 10, columns: tuple[str, ...] = ("close", "volume")) -> DataFrame:
    """(symbol, bar_ts, features, target): the `length` rows before each row, and its close; full windows only."""
    before = F.collect_list(F.struct(*columns)).over(r.order().rowsBetween(-length, -1))
    return bars.select("symbol", "bar_ts", before.alias("features"), F.col("close").alias("target")).where(F.size("features") == length)


def last_sequence(bars: DataFrame, length: int = 10) -> DataFrame:
    """(symbol, closes): the last `length` closes in order; only these reach the group."""
    w = Window.partitionBy("symbol").orderBy(F.col("bar_ts").desc())
    tail = bars.withColumn("k", F.row_number().over(w)).where(F.col("k") <= length)
    return tail.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("bar_ts", "close"))), lambda x: x["close"]).alias("closes"))


def fill(column: str, method: str) -> Column:
    """Missing values by the last, the next, or the line between both."""
    last = F.last(column, True).over(r.up_to())
    following = F.last(column, True).over(r.onward())
    if method == "forward":
        return last
    if method == "backward":
        return following
    known = F.when(F.col(column).isNotNull(), F.col("__k"))
    a, b = F.last(known, True).over(r.up_to()), F.last(known, True).over(r.onward())
    return F.when(F.col(column).isNotNull(), F.col(column)).otherwise(last + (following - last) * r.div(F.col("__k") - a, b - a))


def spine_fill(bars: DataFrame, every_missing: int = 0) -> DataFrame:
    """All weeks by all symbols, with gaps filled forward, backward and by lines.

    The spine is symbols times weeks of one range, both dimension-sized.  `every_missing` removes every k-th week first.
    """
    limits = bars.agg(F.min("bar_ts").alias("a"), F.max("bar_ts").alias("b"))
    weeks = limits.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("bar_ts")).withColumn("week", F.datediff("bar_ts", F.lit("1990-01-01").cast("timestamp_ntz")) / 7)
    spine = bars.select("symbol").distinct().join(weeks)  # symbols by weeks
    kept = bars.withColumn("__week", (F.datediff("bar_ts", F.lit("1990-01-01").cast("timestamp_ntz")) / 7).cast("int"))
    if every_missing:
        kept = kept.where(F.col("__week") % every_missing != 0)
    wide = spine.join(kept.select("symbol", "bar_ts", "close", "volume"), ["symbol", "bar_ts"], "left").withColumn("__k", F.row_number().over(r.order()))
    return wide.select("symbol", "bar_ts", "close", fill("close", "forward").alias("forward"), fill("close", "backward").alias("backward"), fill("close", "linear").alias("linear"))


def summary(bars: DataFrame) -> DataFrame:
    """Counts, range, mean, deviation and extremes by symbol."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min("bar_ts").alias("first"), F.max("bar_ts").alias("last"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("sd"), F.min("close").alias("least"), F.max("close").alias("most"))
