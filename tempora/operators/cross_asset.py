"""Features across symbols: correlations, sectors, market breadth, covariance, portfolios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import rolling as r
from tempora.functions.rolling import div
from tempora.operators.alignment import pairs


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.select("*", r.change("close").alias("ret"))


def safe_corr(x: str, y: str, w=None) -> Column:
    """Pearson correlation, null where either is constant."""
    parts = [F.covar_samp(x, y), F.stddev_samp(x), F.stddev_samp(y)]
    c, sx, sy = [p.over(w) for p in parts] if w is not None else parts
    return div(c, sx * sy)


def pair_correlations(bars: DataFrame, n: int = 20) -> DataFrame:
    """(a, b, pearson, spearman, beta, rolling mean, deviation, extremes, stability) of every two symbols' returns."""
    both = pairs(with_returns(bars))
    rank = lambda c: F.avg("__o").over(Window.partitionBy("a", "b", c))
    for c in ("x", "y"):
        both = both.withColumn("__o", F.row_number().over(Window.partitionBy("a", "b").orderBy(c)).cast("double")).withColumn(f"rank_{c}", rank(c)).drop("__o")
    w = Window.partitionBy("a", "b").orderBy("bar_ts").rowsBetween(-(n - 1), 0)
    both = both.withColumn("rolling", F.when(F.count("x").over(w) == n, safe_corr("x", "y", w)))
    out = both.groupBy("a", "b").agg(
        safe_corr("x", "y").alias("pearson"), safe_corr("rank_x", "rank_y").alias("spearman"), div(F.covar_samp("x", "y"), F.var_samp("y")).alias("beta"), F.avg("rolling").alias("rolling_mean"), F.stddev_samp("rolling").alias("rolling_sd"), F.min("rolling").alias("rolling_min"), F.max("rolling").alias("rolling_max")
    )
    return out.withColumn("stability", 1 - F.col("rolling_sd"))


def correlation_features(bars: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, bar_ts, mean, most, least, spread, momentum) of a symbol's rolling correlations with all others."""
    p = pairs(with_returns(bars))
    both = p.select(F.col("a").alias("symbol"), F.col("b").alias("other"), "bar_ts", "x", "y").unionByName(p.select(F.col("b").alias("symbol"), F.col("a").alias("other"), "bar_ts", F.col("y").alias("x"), F.col("x").alias("y")))
    w = Window.partitionBy("symbol", "other").orderBy("bar_ts").rowsBetween(-(n - 1), 0)
    c = both.select("symbol", "bar_ts", F.when(F.count("x").over(w) == n, safe_corr("x", "y", w)).alias("c"))
    wide = c.groupBy("symbol", "bar_ts").agg(F.avg("c").alias("mean"), F.max("c").alias("most"), F.min("c").alias("least"), F.stddev_pop("c").alias("spread"))
    return wide.withColumn("momentum", F.col("mean") - F.lag("mean", 5).over(r.order()))


def market(bars: DataFrame, n: int = 10) -> DataFrame:
    """(bar_ts, market_ret, dispersion, breadth, market_vol, market_volume): equal weights; breadth over the last n rows."""
    before = r.order().rowsBetween(-n, -1)
    base = with_returns(bars).select("symbol", "bar_ts", "ret", "volume", F.when(F.count("ret").over(before) == n, (F.avg("ret").over(before) > 0).cast("double")).alias("rising"))
    daily = base.groupBy("bar_ts").agg(F.avg("ret").alias("market_ret"), F.stddev_pop("ret").alias("dispersion"), F.avg("rising").alias("breadth"), F.sum("volume").alias("market_volume"))
    w = Window.orderBy("bar_ts").rowsBetween(-(n - 1), 0)  # one row a time, of all symbols together
    return daily.withColumn("market_vol", F.when(F.count("market_ret").over(w) == n, F.stddev_samp("market_ret").over(w)))


def sectors(bars: DataFrame, sector: Column, n: int = 10) -> DataFrame:
    """(sector, bar_ts, momentum, dispersion, members): mean momentum of sectors of two members or more, less the market's."""
    m = bars.select("symbol", sector.alias("sector"), "bar_ts", r.change("close", n).alias("momentum"))
    all_ = m.groupBy("bar_ts").agg(F.avg("momentum").alias("market"))
    by = m.groupBy("sector", "bar_ts").agg(F.avg("momentum").alias("momentum"), F.stddev_pop("momentum").alias("dispersion"), F.count("momentum").alias("members")).where("members >= 2")
    return by.join(all_, "bar_ts").select("sector", "bar_ts", "momentum", (F.col("momentum") - F.col("market")).alias("relative"), "dispersion", "members")


def covariance(bars: DataFrame, tail: int = 252) -> DataFrame:
    """(a, b, cov, corr): empirical covariance of the last `tail` complete rows, all pairs and the diagonal."""
    ret = with_returns(bars).where("ret is not null").select("symbol", "bar_ts", "ret")
    symbols = ret.select(F.count_distinct("symbol").alias("m"))
    last = ret.groupBy("bar_ts").agg(F.count(F.lit(1)).alias("c")).join(symbols).where("c = m").orderBy(F.col("bar_ts").desc()).limit(tail).select("bar_ts")
    kept = ret.join(F.broadcast(last), "bar_ts")  # `tail` rows
    one, two = kept.select("bar_ts", F.col("symbol").alias("a"), F.col("ret").alias("x")), kept.select("bar_ts", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    return one.join(two, "bar_ts").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"), safe_corr("x", "y").alias("corr"))


def shrunk_covariance(bars: DataFrame, tail: int = 252, method: str = "oas") -> DataFrame:
    """(a, b, cov): the empirical covariance drawn towards a scaled identity, by moments of it alone."""
    cov = covariance(bars, tail)
    m = F.count_if(F.col("a") == F.col("b"))
    s = cov.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("cov"))).alias("trace"), F.sum(F.col("cov") ** 2).alias("square"), m.alias("m"))
    n = F.lit(float(tail))
    rho = F.least(F.lit(1.0), div((1 - 2.0 / F.col("m")) * F.col("square") + F.col("trace") ** 2, (n + 1 - 2.0 / F.col("m")) * (F.col("square") - F.col("trace") ** 2 / F.col("m"))))
    if method != "oas":
        rho = F.lit(float(method))
    joined = cov.join(s.withColumn("rho", rho))
    return joined.select("a", "b", ((1 - F.col("rho")) * F.col("cov") + F.when(F.col("a") == F.col("b"), F.col("rho") * F.col("trace") / F.col("m")).otherwise(F.lit(0.0))).alias("cov"), "rho")


def portfolio_risk(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(symbol, weight, marginal, contribution, share) of a portfolio's variance."""
    a = weights.select(F.col("symbol").alias("a"), F.col("weight").alias("wa"))
    b = weights.select(F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    marginal = cov.join(b, "b").groupBy("a").agg(F.sum(F.col("cov") * F.col("wb")).alias("marginal")).join(a, "a")
    out = marginal.select(F.col("a").alias("symbol"), F.col("wa").alias("weight"), "marginal", (F.col("wa") * F.col("marginal")).alias("contribution"))
    return out.withColumn("share", div("contribution", F.sum("contribution").over(Window.partitionBy(F.lit(1)))))


def ranking(bars: DataFrame) -> DataFrame:
    """Composite rank of symbols: min-max scores of return, return over risk, momentum over 21, 63 and 126 rows, drawdown."""
    base = with_returns(bars).select("*", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("bar_ts").desc())).alias("back"), (F.col("close") / F.max("close").over(r.up_to()) - 1).alias("dd"))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    s = base.groupBy("symbol").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.min("dd").alias("dd"), *[(at(1) / at(k) - 1).alias(f"m{k}") for k in (21, 63, 126)])
    s = s.select("symbol", F.col("mu").alias("ret_raw"), div("mu", "sd").alias("risk_raw"), ((F.col("m21") + F.col("m63") + F.col("m126")) / 3).alias("mom_raw"), F.col("dd").alias("dd_raw"))
    whole = Window.partitionBy(F.lit(1))  # one row a symbol
    score = lambda c: F.coalesce(div(F.col(c) - F.min(c).over(whole), F.max(c).over(whole) - F.min(c).over(whole)), F.lit(0.5))
    s = s.select("symbol", *[score(f"{k}_raw").alias(k) for k in ("ret", "risk", "mom", "dd")])
    s = s.withColumn("score", 0.3 * F.col("ret") + 0.3 * F.col("risk") + 0.2 * F.col("mom") + 0.2 * F.col("dd"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "symbol")))


def correlation_components(bars: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(symbol, cluster): connected components of the graph of correlations above a threshold, by repeated least labels."""
    edges = pair_correlations(bars).where(F.abs("pearson") > threshold).select("a", "b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = bars.select("symbol").distinct().withColumn("cluster", F.col("symbol"))
    both = both.persist()
    while True:
        near = both.join(labels, F.col("a") == F.col("symbol")).groupBy(F.col("b").alias("symbol")).agg(F.min("cluster").alias("c"))
        after = labels.join(near, "symbol", "left").select("symbol", F.least("cluster", F.coalesce("c", "cluster")).alias("cluster")).persist()
        moved = after.join(labels.withColumnRenamed("cluster", "old"), "symbol").where("cluster != old").limit(1).count()
        labels = after
        if not moved:
            return labels


def rolling_pca(bars: DataFrame, symbols: list[str], n: int = 50) -> DataFrame:
    """(bar_ts, symbol, loading, explained): first principal component of each window of standardised returns.

    Windows are collected as arrays by a frame and decomposed a batch of rows at a time; |loading|, as signs are arbitrary.
    Only times at which every symbol has a return count; loadings are null until a window has n of these.
    """
    wide = with_returns(bars).groupBy("bar_ts").pivot("symbol", symbols).agg(F.first("ret"))
    names = [f"s{k}" for k in range(len(symbols))]
    wide = wide.select("bar_ts", F.array(*[F.col(f"`{s}`") for s in symbols]).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    w = Window.orderBy("bar_ts").rowsBetween(-(n - 1), 0)  # one row a time
    framed = wide.select("bar_ts", F.collect_list("x").over(w).alias("xs"))

    def run(batches):
        for pdf in batches:
            rows = []
            for t, xs in zip(pdf["bar_ts"], pdf["xs"], strict=True):
                if len(xs) < n:
                    rows += [(t, s, None, None) for s in symbols]
                    continue
                x = np.array([list(v) for v in xs])
                x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
                _, s, v = np.linalg.svd(x, full_matrices=False)
                rows += [(t, symbols[k], float(abs(v[0, k])), float(s[0] ** 2 / (s**2).sum())) for k in range(len(names))]
            out = pd.DataFrame(rows, columns=["bar_ts", "symbol", "loading", "explained"])
            yield out.astype({"loading": "float64", "explained": "float64"})

    return framed.mapInPandas(run, "bar_ts timestamp_ntz, symbol string, loading double, explained double")


def optimise(mu: np.ndarray, cov: np.ndarray, objective: str = "max_sharpe", most: float = 1.0, steps: int = 4000) -> np.ndarray:
    """Long-only weights within [0, most] that sum to 1, by projected gradient steps; for asset counts that fit a driver."""
    m = len(mu)
    w = np.full(m, 1.0 / m)

    def project(v: np.ndarray) -> np.ndarray:
        lo, hi = v.min() - most, v.max()
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(v - mid, 0, most).sum() > 1 else (lo, mid)
        return np.clip(v - hi, 0, most)

    scale = max(np.abs(cov).max(), 1e-12)
    for k in range(steps):
        var = w @ cov @ w
        if objective == "min_variance":
            g = 2 * cov @ w / scale
        elif objective == "max_return":
            g = -mu / max(np.abs(mu).max(), 1e-12)
        else:
            sd = np.sqrt(max(var, 1e-18))
            g = -(mu / sd - (w @ mu) * (cov @ w) / sd**3)
            g = g / max(np.abs(g).max(), 1e-12)
        w = project(w - 0.5 / (1 + k / 20) * g)
    return w / w.sum()
