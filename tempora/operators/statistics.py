"""Reductions and ordered statistics of one value column by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.rolling import div


def corrected_skewness(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def corrected_kurtosis(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 3, ((n + 1.0) * F.kurtosis(x) + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0)))


def describe(df: DataFrame, by: str, x: str) -> DataFrame:
    """Moments, quantiles, range, tails and Jarque-Bera of x by group."""
    c = F.col(x)
    q = F.percentile(c, F.array(F.lit(0.05), F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s, k = F.skewness(c), F.kurtosis(c)
    jb = F.count(c) / 6 * (s * s + k * k / 4)
    out = df.groupBy(by).agg(
        F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), q.alias("q"), F.stddev_samp(c).alias("sd"), F.stddev_pop(c).alias("sd_pop"), F.var_samp(c).alias("var"), corrected_skewness(x).alias("skew"), corrected_kurtosis(x).alias("kurt"),
        F.min(c).alias("least"), F.max(c).alias("most"), jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jb_p"), F.mode(c, True).alias("mode"),
    )
    q = F.col("q")
    return out.select("*", q[1].alias("q1"), q[2].alias("median"), q[3].alias("q3"), (q[3] - q[1]).alias("iqr"), (-q[0]).alias("value_at_risk"), (F.col("most") - F.col("least")).alias("extent"), div("sd", "mean").alias("cv")).drop("q")


def expected_shortfall(df: DataFrame, by: str, x: str, level: float = 0.95) -> DataFrame:
    """Less the mean of values at or below the lower quantile."""
    q = df.groupBy(by).agg(F.percentile(x, F.lit(1 - level)).alias("q"))
    return df.join(q, by).where(F.col(x) <= F.col("q")).groupBy(by).agg((-F.avg(x)).alias("shortfall"))


def autocorrelations(df: DataFrame, by: str, order: list[str], x: str, lags: int = 5) -> DataFrame:
    """(by, lag, acf): correlation of each series with itself some rows earlier."""
    w = Window.partitionBy(by).orderBy(*order)
    wide = df.select(by, F.col(x).alias("x"), *[F.lag(x, k).over(w).alias(f"y{k}") for k in range(1, lags + 1)])
    long = wide.select(by, "x", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"y{k}").alias("y")) for k in range(1, lags + 1)])).alias("p")).select(by, "x", "p.lag", "p.y").where("y is not null")
    return long.groupBy(by, "lag").agg(div(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("acf"))


def level_drawdown(df: DataFrame, by: str, order: list[str], x: str) -> DataFrame:
    """(by, drawdown, at): the deepest fall below the running peak, and the row where it is reached."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.select(by, F.row_number().over(Window.partitionBy(by).orderBy(*order)).alias("k"), div(F.col(x) - F.max(x).over(w), F.max(x).over(w)).alias("d"))
    return d.groupBy(by).agg(F.min("d").alias("drawdown"), F.min_by("k", F.struct("d", "k")).alias("at"))


def standardised(df: DataFrame, by: str, key: str, x: str) -> DataFrame:
    """(key, min_max, z, total, product): scaled values (0 where flat) and running sum and product of 1 + x / 1e6."""
    w, run = Window.partitionBy(by), Window.partitionBy(by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(x)
    return df.select(key, F.coalesce(div(c - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0)).alias("min_max"), F.coalesce(div(c - F.avg(c).over(w), F.stddev_samp(c).over(w)), F.lit(0.0)).alias("z"), F.sum(c).over(run).alias("total"), (F.exp(F.sum(F.ln(1 + c / 1e6)).over(run)) - 1).alias("product"))


def modes(df: DataFrame, by: str, x: Column) -> DataFrame:
    """(by, value): all most frequent values."""
    counted = df.groupBy(by, x.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("k", F.rank().over(Window.partitionBy(by).orderBy(F.col("n").desc()))).where("k = 1").select(by, "value", "n")
