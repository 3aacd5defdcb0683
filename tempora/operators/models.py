"""Learning steps on MLlib: regressors by fold, tree importances and spread, calibration, clusters, searches."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df.where(F.col(target).isNotNull())).withColumn("label", F.col(target).cast("double"))


def regressor(kind: str, **options):
    """A regressor by name: forest, linear, ridge or lasso."""
    if kind == "forest":
        return RandomForestRegressor(seed=7, **{"numTrees": 20, "maxDepth": 5, **options})
    penalty = {"linear": (0.0, 0.0), "ridge": (0.1, 0.0), "lasso": (0.01, 1.0)}[kind]
    return LinearRegression(**{"regParam": penalty[0], "elasticNetParam": penalty[1], **options})


def compare(df: DataFrame, features: list[str], target: str, train: str, kinds: tuple[str, ...] = ("forest", "linear", "ridge", "lasso")) -> DataFrame:
    """(model, rmse, mae, r2) of each regressor, fitted where `train` holds and scored elsewhere."""
    rows = assembled(df, features, target)
    fit, test = rows.where(train).persist(), rows.where(f"not ({train})").persist()
    out = None
    for kind in kinds:
        scored = regressor(kind).fit(fit).transform(test)
        e = F.col("prediction") - F.col("label")
        row = scored.agg(F.lit(kind).alias("model"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop("label") * F.count(F.lit(1)))).alias("r2"))
        out = row if out is None else out.unionByName(row)
    return out


def importances(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, importance, rank, cumulative) of a random forest."""
    from pyspark.sql import Window

    model = regressor("forest").fit(assembled(df, features, target))
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    w = Window.orderBy(F.col("importance").desc(), "feature")  # one row a feature
    return table.select("*", F.row_number().over(w).alias("rank"), F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def recursive_elimination(df: DataFrame, features: list[str], target: str, keep: int) -> list[str]:
    """Features left when a forest drops its least important one again and again."""
    rows = df.persist()
    left = list(features)
    while len(left) > keep:
        model = regressor("forest", numTrees=8).fit(assembled(rows, left, target))
        left.pop(int(model.featureImportances.toArray().argmin()))
    return left


def isotonic(df: DataFrame, x: str, y: str) -> DataFrame:
    """(boundary, value): the isotonic fit of y on x."""
    model = IsotonicRegression(featuresCol="x", labelCol="y").fit(df.select(F.col(x).alias("x"), F.col(y).alias("y")))
    rows = list(zip([float(v) for v in model.boundaries], [float(v) for v in model.predictions], strict=True))
    return df.sparkSession.createDataFrame(rows, "boundary double, value double")


def clusters(df: DataFrame, key: str, features: list[str], most: int = 4) -> DataFrame:
    """(key, cluster, k, silhouette): k-means with the k of the best silhouette; clusters are numbered by their least key."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df).persist()
    best = None
    for k in range(2, most + 1):
        scored = KMeans(k=k, seed=7).fit(rows).transform(rows)
        score = ClusteringEvaluator().evaluate(scored) if scored.select("prediction").distinct().count() > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, k, scored)
    names = best[2].groupBy("prediction").agg(F.min(key).alias("cluster"))
    return best[2].join(names, "prediction").select(key, "cluster", F.lit(best[1]).alias("k"), F.lit(float(best[0])).alias("silhouette"))


def principal_components(df: DataFrame, features: list[str], k: int = 2) -> DataFrame:
    """(component, feature, loading, explained): of standardised columns; |loading|, as signs are arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler

    rows = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(df)
    rows = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="scaled", outputCol="pc").fit(rows)
    m = model.pc.toArray()
    out = [(c, f, float(abs(m[i, c])), float(model.explainedVariance[c])) for c in range(k) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(out, "component int, feature string, loading double, explained double")


def grid_search(df: DataFrame, features: list[str], target: str, train: str, grid: list[dict]) -> DataFrame:
    """(trial, params, rmse) of forests over a grid, best first by rank."""
    from pyspark.sql import Window

    rows = assembled(df, features, target)
    fit, test = rows.where(train).persist(), rows.where(f"not ({train})").persist()
    found = []
    for k, options in enumerate(grid):
        e = F.col("prediction") - F.col("label")
        rmse = regressor("forest", **options).fit(fit).transform(test).agg(F.sqrt(F.avg(e * e))).first()[0]
        found.append((k, str(sorted(options.items())), None if rmse is None else float(rmse)))  # none without test rows
    fit.unpersist()
    test.unpersist()
    table = df.sparkSession.createDataFrame(found, "trial int, params string, rmse double")
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.col("rmse").asc_nulls_last(), "trial")))  # one row a trial


def as_array(df: DataFrame) -> DataFrame:
    """The assembled vector as an array, for export."""
    return df.withColumn("features", vector_to_array("features"))
