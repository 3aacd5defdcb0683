"""Ensemble weights and combinations over a table of model scores and predictions, and feature scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.rolling import div


def _share(x: Column, by: list[str]) -> Column:
    """x over its sum in the group; equal shares where the sum is 0."""
    w = Window.partitionBy(*by)
    return F.coalesce(div(x, F.sum(x).over(w)), 1.0 / F.count(F.lit(1)).over(w))


def weights(scores: DataFrame, by: list[str]) -> DataFrame:
    """Weights of models from (by, model_id, rmse, mae, r2, direction) in every scheme; each adds up to 1 in a group."""
    w = Window.partitionBy(*by)
    e = F.col("rmse")
    raw = {
        "w_inverse": div(F.lit(1.0), e), "w_mae": div(F.lit(1.0), "mae"), "w_r2": F.greatest("r2", F.lit(0.01)), "w_direction": F.col("direction"), "w_equal": F.lit(1.0), "w_exp": F.exp(-div(e, F.max(e).over(w))),
        "w_softmax": F.exp(-(e - F.min(e).over(w)) / 10), "w_decay": F.pow(F.lit(0.95), F.row_number().over(w.orderBy(e, "model_id")) - 1),
    }
    out = scores.select("*", *[_share(c, by).alias(k) for k, c in raw.items()])
    floor = F.greatest("w_softmax", F.lit(0.05))
    out = out.withColumn("w_floor", _share(floor, by))
    return out.withColumn("w_blend", 0.7 * F.col("w_inverse") + 0.3 * F.col("w_r2"))


def combine(predictions: DataFrame, by: str, weight: str = "weight") -> DataFrame:
    """(by, mean, weighted, spread, low, high, confidence): combinations over models of (by, prediction, weight)."""
    p, w = F.col("prediction"), F.col(weight)
    out = predictions.groupBy(by).agg(F.count(F.lit(1)).alias("models"), F.avg(p).alias("mean"), div(F.sum(p * w), F.sum(w)).alias("weighted"), F.stddev_pop(p).alias("spread"), div(F.sum(w * p * p), F.sum(w)).alias("__sq"))
    deviation = F.sqrt(F.greatest(F.col("__sq") - F.col("weighted") ** 2, F.lit(0.0)))
    return out.select(by, "models", "mean", "weighted", "spread", (F.col("mean") - 1.96 * F.col("spread")).alias("low"), (F.col("mean") + 1.96 * F.col("spread")).alias("high"), (F.col("weighted") - 1.96 * deviation).alias("weighted_low"), F.greatest(1 - div("spread", F.abs("mean")), F.lit(0.0)).alias("confidence"))


def feature_scores(df: DataFrame, features: list[str], target: str, bins: int = 8) -> DataFrame:
    """(feature, rho, f_score, mi): correlation, univariate F and mutual information over equal-frequency bins.

    One pass makes the long table of features; nothing loops over rows.
    """
    n = F.count(F.lit(1))
    long = df.select(F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("p")).select("y", "p.feature", "p.x").dropna()
    rho = long.groupBy("feature").agg(n.alias("n"), div(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("rho"))
    rho = rho.select("feature", "n", "rho", ((F.col("n") - 2) * div(F.col("rho") ** 2, 1 - F.col("rho") ** 2)).alias("f_score"))
    cuts = lambda c: F.percentile(c, F.array(*[F.lit(k / bins) for k in range(1, bins)]))
    limits = long.groupBy("feature").agg(cuts("x").alias("cx"), cuts("y").alias("cy"))
    at = lambda c, v: F.size(F.filter(c, lambda t: t < F.col(v)))
    cells = long.join(F.broadcast(limits), "feature").groupBy("feature", at("cx", "x").alias("bx"), at("cy", "y").alias("by")).agg(n.alias("c"))  # a row a feature
    f, fx, fy = Window.partitionBy("feature"), Window.partitionBy("feature", "bx"), Window.partitionBy("feature", "by")
    p = F.col("c") / F.sum("c").over(f)
    cells = cells.select("feature", (p * F.ln(p / (F.sum("c").over(fx) / F.sum("c").over(f) * (F.sum("c").over(fy) / F.sum("c").over(f))))).alias("part"))
    return rho.join(cells.groupBy("feature").agg(F.sum("part").alias("mi")), "feature")


def correlation_prune(df: DataFrame, features: list[str], limit: float = 0.95) -> list[str]:
    """Features left when, of each pair correlated above the limit, the later one goes; one aggregate gives all pairs."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    row = df.agg(*[div(F.covar_samp(features[i], features[j]), F.stddev_samp(features[i]) * F.stddev_samp(features[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    gone: set[int] = set()
    for i, j in pairs:
        if i not in gone and j not in gone and abs(row[f"c{i}_{j}"] or 0) > limit:
            gone.add(j)
    return [f for k, f in enumerate(features) if k not in gone]


def pareto(df: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """Rows that no other row beats strictly in every objective (smaller is better), by a running minimum for two
    objectives; ordered once, without pairing rows."""
    a, b = objectives
    firsts = df.groupBy(a).agg(F.min(b).alias("__b"))
    run = firsts.withColumn("__best", F.min("__b").over(Window.orderBy(a).rowsBetween(Window.unboundedPreceding, -1))).select(a, "__best")
    return df.join(run, a).where(F.col("__best").isNull() | (F.col(b) <= F.col("__best"))).select(key, *objectives)


def top_k(df: DataFrame, by: str, order: Column, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__k") <= k).drop("__k")
