"""What outlier masks say of a series (symbol, bar_ts, y): where outliers lie, local patterns, stress, volatility regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import rolling as r
from tempora.functions.rolling import div


def _numbered(df: DataFrame) -> DataFrame:
    """df with k, the row's place from 0, and n, the rows of its symbol."""
    return df.select("*", (F.row_number().over(r.order()) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"))


def patterns(masked: DataFrame) -> DataFrame:
    """(symbol, outliers, percent, mean, deviation, least, most, first_tenth, middle, last_tenth) of the rows that `keep` = 0 drops."""
    out = F.col("keep") == 0
    x = F.when(out, F.col("y"))
    tenth = F.when(F.col("k") < 0.1 * F.col("n"), 0).when(F.col("k") >= 0.9 * F.col("n"), 2).otherwise(1)
    at = lambda t: F.count_if(out & (tenth == t))
    return _numbered(masked).groupBy("symbol").agg(
        F.count_if(out).alias("outliers"), (100 * F.avg(out.cast("double"))).alias("percent"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"), F.min(x).alias("least"), F.max(x).alias("most"),
        at(0).alias("first_tenth"), at(1).alias("middle"), at(2).alias("last_tenth"),
    )


def local_patterns(df: DataFrame, block: int = 20) -> DataFrame:
    """(symbol, blocks, mean_cv, trend_changes, spikes): coefficients of variation of whole blocks, changes of sign between the
    slopes of half-overlapping blocks, and rows more than three deviations from the mean of their last five."""
    half = block // 2
    base = _numbered(df)
    cv = base.groupBy("symbol", F.floor(F.col("k") / block).alias("b")).agg(div(F.stddev_pop("y"), F.avg("y")).alias("cv"), F.count(F.lit(1)).alias("size")).where(F.col("size") == block)
    cv = cv.groupBy("symbol").agg(F.count(F.lit(1)).alias("blocks"), F.avg("cv").alias("mean_cv"))
    # block j has rows [half * j, half * j + block); a row is in two of them
    j = F.floor(F.col("k") / half)
    slopes = base.select("symbol", "k", "y", F.explode(F.array(j - 1, j)).alias("j")).where("j >= 0").groupBy("symbol", "j").agg(F.regr_slope("y", F.col("k").cast("double")).alias("slope"), F.count(F.lit(1)).alias("size")).where(F.col("size") == block)
    order = Window.partitionBy("symbol").orderBy("j")
    turns = slopes.withColumn("turn", F.signum("slope") != F.lag(F.signum("slope")).over(order)).groupBy("symbol").agg(F.count_if("turn").alias("trend_changes"))
    spikes = base.withColumn("spike", F.abs(F.col("y") - r.sma("y", 5)) > 3 * r.std("y", 5)).groupBy("symbol").agg(F.count_if("spike").alias("spikes"))
    return cv.join(turns, "symbol", "left").join(spikes, "symbol", "left").fillna(0, ["trend_changes", "spikes"])


def stress(df: DataFrame) -> DataFrame:
    """(symbol, bar_ts, stress): 1 from three rows before a return of more than three deviations to six after it, and around three
    or more returns in a row of more than two."""
    base = df.select("symbol", "bar_ts", r.change("y").alias("ret"))
    spread = F.stddev_pop("ret").over(Window.partitionBy("symbol"))
    base = base.select("symbol", "bar_ts", F.coalesce(F.abs("ret") > 3 * spread, F.lit(False)).cast("int").alias("large"), F.coalesce(F.abs("ret") > 2 * spread, F.lit(False)).cast("int").alias("wild"))
    run = base.withColumn("island", F.sum(1 - F.col("wild")).over(r.up_to()))
    long = ((F.col("wild") == 1) & (F.sum("wild").over(Window.partitionBy("symbol", "island")) >= 3)).cast("int")
    run = run.withColumn("long", long)
    near = lambda c, a, b: F.max(c).over(r.order().rowsBetween(a, b))
    return run.select("symbol", "bar_ts", F.greatest(near("large", -6, 3), near("long", -3, 2)).alias("stress"))


def volatility_regimes(df: DataFrame, n: int = 20, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(symbol, above_25.., transitions): rows whose rolling deviation of returns is above its own quantiles, and changes across the 70% one."""
    base = df.select("symbol", "bar_ts", r.change("y").alias("ret")).select("symbol", "bar_ts", r.std("ret", n).alias("vol"))
    q = base.groupBy("symbol").agg(F.percentile("vol", F.array(*[F.lit(s) for s in shares], F.lit(0.7))).alias("q"))
    both = base.where("vol is not null").join(q, "symbol").withColumn("high", (F.col("vol") > F.get("q", F.lit(len(shares)))).cast("int"))
    both = both.withColumn("turn", F.col("high") != r.lag("high"))
    return both.groupBy("symbol").agg(*[F.count_if(F.col("vol") > F.get("q", F.lit(k))).alias(f"above_{round(100 * s)}") for k, s in enumerate(shares)], F.count_if("turn").alias("transitions"))


def simulation_mask(df: DataFrame) -> DataFrame:
    """(symbol, bar_ts, keep): within three deviations of the mean, and within 1.5 quartile ranges of the quartiles."""
    s = df.groupBy("symbol").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"), F.percentile("y", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = F.col("q")[1] - F.col("q")[0]
    keep = (F.abs(div(F.col("y") - F.col("m"), "sd")) < 3) & F.col("y").between(F.col("q")[0] - 1.5 * spread, F.col("q")[1] + 1.5 * spread)
    return df.join(s, "symbol").select("symbol", "bar_ts", F.coalesce(keep, F.lit(False)).cast("int").alias("keep"))
