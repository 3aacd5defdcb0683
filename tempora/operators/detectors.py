"""Detectors that SQL has no words for: isolation forest, local outlier factor, unit-root test.

The forest is grown on the driver from a bounded sample chosen by a hash (`trees` times `sample` rows), and scores all rows in
Arrow batches; its size is fixed by the parameters.  The others work on one bounded history or one series a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.tracking import bounded_history


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, float]]:
    """One tree as rows (feature, cut, left, right, length): inner rows have a feature, leaves -1 and a path length."""
    tree: list[tuple[int, float, int, int, float]] = []

    def add(rows: np.ndarray, level: int) -> int:
        at = len(tree)
        tree.append((-1, 0.0, -1, -1, level + float(_path(len(rows)))))
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(x.shape[1])
        if level < depth and len(rows) > 1 and spread.any():
            feature = int(rng.choice(np.flatnonzero(spread)))
            cut = float(rng.uniform(rows[:, feature].min(), rows[:, feature].max()))
            below = rows[:, feature] < cut
            left, right = add(rows[below], level + 1), add(rows[~below], level + 1)
            tree[at] = (feature, cut, left, right, 0.0)
        return at

    add(x, 0)
    return tree


def isolation(trees: list[list[tuple]], x: np.ndarray, sample: int) -> np.ndarray:
    """Scores in 0 to 1; near 1 is alone."""
    total = np.zeros(len(x))
    for tree in trees:
        feature, cut, left, right, length = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            f = feature[at[inner]]
            at[inner] = np.where(x[inner, f] < cut[at[inner]], left[at[inner]], right[at[inner]])
        total += length[at]
    return 2.0 ** (-total / len(trees) / max(float(_path(sample)), 1e-9))


def isolation_forest(df: DataFrame, key: str, features: list[str], trees: int = 50, sample: int = 256, seed: int = 7) -> DataFrame:
    """(key, score) of all rows without missing features; the forest is grown from the rows with the smallest hashes of their keys."""
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    drawn = rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(trees * sample).select(*features).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(drawn))
    depth = int(np.ceil(np.log2(max(size, 2))))
    forest = [grow(drawn[rng.choice(len(drawn), size, replace=False)], rng, depth) for _ in range(trees)] if size else []
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "score": isolation(shared.value, pdf[features].to_numpy(float), size)})

    return rows.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, score double")


def local_outlier_factors(x: np.ndarray, k: int) -> np.ndarray:
    """Of each value of a line: the mean density of its k neighbours by its own; about 1 inside, larger outside."""
    k = min(k, len(x) - 1)
    if k < 1:
        return np.ones(len(x))
    apart = np.abs(x[:, None] - x[None, :])
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, axis=1, kind="stable")[:, :k]
    reach = np.take_along_axis(apart, near, axis=1)
    density = 1 / np.maximum(np.maximum(reach, reach[near, -1]).mean(axis=1), 1e-12)
    return density[near].mean(axis=1) / density


def local_outliers(stream: DataFrame, keep: int = 500, k: int = 20, most: float = 1.5) -> DataFrame:
    """(metric_name, model_id, event_id, factor, outlier) of each series' newest `keep` rows, which one group holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        factor = local_outlier_factors(pdf["metric_value"].to_numpy(float), k)
        return pd.DataFrame({"metric_name": pdf["metric_name"], "model_id": pdf["model_id"], "event_id": pdf["event_id"], "factor": factor, "outlier": (factor > most).astype(int)})

    slim = bounded_history(stream, keep).select("metric_name", "model_id", "event_id", "metric_value")
    return slim.groupBy("metric_name", "model_id").applyInPandas(run, "metric_name string, model_id long, event_id long, factor double, outlier int")


def unit_root_statistic(x: np.ndarray, lags: int = 1) -> tuple[float, float]:
    """(t of the level, its 5% bound) of the augmented Dickey-Fuller regression with a constant; the bound by MacKinnon's response surface."""
    d = np.diff(x)
    n = len(d) - lags
    if n < lags + 5 or np.ptp(x) == 0:
        return float("nan"), float("nan")
    design = np.column_stack([x[lags:-1], *[d[lags - j : len(d) - j] for j in range(1, lags + 1)], np.ones(n)])
    inverse = np.linalg.pinv(design.T @ design)
    beta = inverse @ design.T @ d[lags:]
    rest = d[lags:] - design @ beta
    return float(beta[0] / np.sqrt(rest @ rest / (n - design.shape[1]) * inverse[0, 0])), -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3


def stationarity(bars: DataFrame, column: str = "close", lags: int = 1) -> DataFrame:
    """(symbol, statistic, bound, stationary): one series a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, bound = unit_root_statistic(pdf.sort_values("bar_ts")[column].to_numpy(float), lags)
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "statistic": [t], "bound": [bound], "stationary": [int(t < bound)]})

    return bars.select("symbol", "bar_ts", column).dropna().groupBy("symbol").applyInPandas(run, "symbol string, statistic double, bound double, stationary int")
