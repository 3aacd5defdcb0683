"""Uncertainty, confidence and risk scores: projections and reductions over a calibration table (uncertainty, error in 0..1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.rolling import div

Z95, Z90 = 1.959963984540054, 1.6448536269514722


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, centre, n, confidence, accuracy): right-closed bins of confidence 1 - uncertainty; empty bins stay."""
    spark = df.sparkSession
    confidence, accuracy = 1 - F.col("uncertainty"), 1 - F.col("error")
    binned = df.select(F.least(F.greatest(F.ceil(confidence * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"), confidence.alias("c"), accuracy.alias("a"))
    found = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("confidence"), F.avg("a").alias("accuracy"))
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    centre = (F.col("bin") + 0.5) / bins
    return spine.join(found, "bin", "left").select("bin", centre.alias("centre"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confidence", centre).alias("confidence"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def calibration(df: DataFrame) -> DataFrame:
    """(ece, sharpness, coverage): expected calibration error, mean uncertainty, share of errors within 1.96 uncertainty."""
    bins = reliability(df)
    ece = bins.agg(div(F.sum(F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")), F.sum("n")).alias("ece"))
    rest = df.agg(F.avg("uncertainty").alias("sharpness"), F.avg((F.col("error") <= Z95 * F.col("uncertainty")).cast("double")).alias("coverage"))
    return ece.join(rest)


def intervals(log: DataFrame, sd: Column) -> DataFrame:
    """Normal intervals and quantiles around predictions, and temperature scaling."""
    p = F.col("prediction")
    return log.select("event_id", p.alias("prediction"), (p - Z95 * sd).alias("low95"), (p + Z95 * sd).alias("high95"), (p - Z90 * sd).alias("low90"), (p + Z90 * sd).alias("high90"), (p / 1.5).alias("scaled"))


def split_uncertainty(samples: DataFrame, by: str, mean: str, variance: str) -> DataFrame:
    """(by, epistemic, aleatoric, total): variance of the means, mean of the variances, root of both."""
    e = samples.groupBy(by).agg(F.var_samp(mean).alias("epistemic"), F.avg(variance).alias("aleatoric"))
    return e.withColumn("total", F.sqrt(F.col("epistemic") + F.col("aleatoric")))


def bucket(x: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """The name of the first limit that x is at or below."""
    out = None
    for limit, name in limits:
        out = F.when(x <= limit, name) if out is None else out.when(x <= limit, name)
    return out.otherwise(last)


def assess(log: DataFrame) -> DataFrame:
    """Confidence, risk, position size, warnings and recommendation for rows (uncertainty, error, agreement, volatility in 0..1)."""
    u, a, v = F.col("uncertainty"), F.col("agreement"), F.col("volatility")
    confidence = 0.45 * (1 - u) + 0.30 * a + 0.25 * (1 - F.col("error"))
    out = log.withColumn("confidence", F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))
    risk = 0.4 * u + 0.35 * (1 - F.col("confidence")) + 0.25 * v
    out = out.withColumn("risk", F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0)))
    kelly = F.least(F.greatest(div(F.col("confidence") * 1.5 - (1 - F.col("confidence")), F.lit(1.5)), F.lit(0.0)), F.lit(0.25))
    size = F.least(F.greatest(kelly * F.col("confidence") * (1 - F.col("risk")), F.lit(0.01)), F.lit(0.1))
    warnings = F.array_compact(F.array(F.when(u > 0.5, F.lit("high uncertainty")), F.when(F.col("confidence") < 0.4, F.lit("low confidence")), F.when(v > 0.6, F.lit("volatile")), F.when(a < 0.3, F.lit("models disagree"))))
    levels = bucket(F.col("confidence"), [(0.2, "very_low"), (0.4, "low"), (0.6, "medium"), (0.8, "high")], "very_high")
    risks = bucket(F.col("risk"), [(0.2, "low"), (0.4, "moderate"), (0.6, "high")], "extreme")
    out = out.select("*", kelly.alias("kelly"), size.alias("size"), warnings.alias("warnings"), levels.alias("confidence_level"), risks.alias("risk_level"))
    action = F.when((F.col("confidence") > 0.6) & (F.col("risk") <= 0.4), "buy").when((F.col("confidence") > 0.4) & (F.col("risk") <= 0.6), "hold").otherwise("avoid")
    return out.withColumn("action", action)
