"""Queries across assets and of uncertainty, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.operators import cross_asset, uncertainty
from tempora.plans.relational_queries import SYMBOLS
from tempora.sources.bars import BARS_SQL, bars_weekly, read


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cross_asset.pair_correlations(bars_weekly(spark, sf_dir)))


def correlation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cross_asset.correlation_features(bars_weekly(spark, sf_dir)))


def market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cross_asset.market(bars_weekly(spark, sf_dir)))


def sector_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cross_asset.sectors(bars_weekly(spark, sf_dir), F.when(F.col("symbol") < "3", "fast").otherwise("slow")))


def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cross_asset.covariance(bars_weekly(spark, sf_dir)))


def shrunk_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cross_asset.shrunk_covariance(bars_weekly(spark, sf_dir)))


def portfolio_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_weekly(spark, sf_dir)
    weights = bars.groupBy("symbol").agg(F.sum("volume").alias("v")).withColumn("weight", F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(1))))
    return _round(cross_asset.portfolio_risk(weights.select("symbol", "weight"), cross_asset.covariance(bars)))


def asset_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cross_asset.ranking(bars_weekly(spark, sf_dir)))


def correlation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_asset.correlation_components(bars_weekly(spark, sf_dir))


def rolling_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_asset.rolling_pca(bars_weekly(spark, sf_dir), SYMBOLS)


def optimal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(objective, symbol, weight): one row an asset and objective; the covariance of the assets goes to the driver."""
    import numpy as np

    bars = bars_weekly(spark, sf_dir)
    cov = cross_asset.covariance(bars).orderBy("a", "b").collect()  # assets squared
    mu = {row["symbol"]: row["m"] for row in cross_asset.with_returns(bars).groupBy("symbol").agg(F.avg("ret").alias("m")).collect()}
    names = sorted(mu)
    matrix = np.array([row["cov"] for row in cov]).reshape(len(names), len(names))
    rows = [(o, s, float(w)) for o in ("max_sharpe", "min_variance", "max_return") for s, w in zip(names, cross_asset.optimise(np.array([mu[s] for s in names]), matrix, o), strict=True)]
    return spark.createDataFrame(rows, "objective string, symbol string, weight double")


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    top = e.agg(F.max("value").alias("top"))
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return e.select("*", F.lag("value").over(w).alias("before")).where("before is not null").join(top).select("event_id", "event_type", (F.col("value") / F.col("top")).alias("uncertainty"), (F.abs(F.col("value") - F.col("before")) / F.col("top")).alias("error"), (F.col("user_id") % 10 / 10).alias("agreement"), (F.col("before") / F.col("top")).alias("volatility"))


def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(uncertainty.reliability(_calibration(spark, sf_dir)))


def calibration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(uncertainty.calibration(_calibration(spark, sf_dir)))


def confidence_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = uncertainty.assess(_calibration(spark, sf_dir)).select("event_id", "confidence", "risk", "kelly", "size", F.array_join("warnings", ";").alias("warnings"), "confidence_level", "risk_level", "action")
    return _round(found)


def prediction_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _calibration(spark, sf_dir).select("event_id", F.col("uncertainty").alias("prediction"), "error")
    return _round(uncertainty.intervals(c, F.col("error")))


def uncertainty_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _calibration(spark, sf_dir).withColumn("variance", F.col("error") * F.col("error"))
    return _round(uncertainty.split_uncertainty(c, "event_type", "uncertainty", "variance"))


QUERIES = {
    f.__name__: f
    for f in (pair_correlations, correlation_features, market_features, sector_momentum, covariance_matrix, shrunk_covariance, portfolio_risk, asset_ranking, correlation_clusters, rolling_pca, optimal_weights, reliability_bins, calibration_scores, confidence_risk, prediction_intervals, uncertainty_split)
}
_B = f"WITH {BARS_SQL}, r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY bar_ts), 0) - 1 AS ret FROM bars)"
_PAIRS = f"{_B}, p AS (SELECT x.symbol AS a, y.symbol AS b, x.bar_ts, x.ret AS x, y.ret AS y FROM r x JOIN r y ON x.bar_ts = y.bar_ts AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL)"
_W = "OVER (PARTITION BY a, b ORDER BY bar_ts ROWS 19 PRECEDING)"
_COV = f"""{_B}, t AS (SELECT bar_ts FROM r WHERE ret IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM r WHERE ret IS NOT NULL) ORDER BY 1 DESC LIMIT 252), k AS (SELECT symbol, bar_ts, ret FROM r JOIN t USING (bar_ts) WHERE ret IS NOT NULL),
c AS (SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) AS cov, covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0) AS corr FROM k x JOIN k y USING (bar_ts) GROUP BY 1, 2)"""
_CAL = """WITH e AS (SELECT event_id, user_id, event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before, max(value) OVER () AS top FROM events),
c AS (SELECT event_id, event_type, value / top AS uncertainty, abs(value - before) / top AS error, user_id % 10 / 10 AS agreement, before / top AS volatility FROM e WHERE before IS NOT NULL)"""
_BINS = """b AS (SELECT least(greatest(ceil((1 - uncertainty) * 10) - 1, 0), 9)::INT AS bin, 1 - uncertainty AS c, 1 - error AS a FROM c), f AS (SELECT bin, count(*) AS n, avg(c) AS confidence, avg(a) AS accuracy FROM b GROUP BY 1),
s AS (SELECT i::INT AS bin, (i + 0.5) / 10 AS centre, coalesce(n, 0) AS n, coalesce(confidence, (i + 0.5) / 10) AS confidence, coalesce(accuracy, 0.0) AS accuracy FROM range(10) t(i) LEFT JOIN f ON f.bin = i)"""
_RISK = f"""{_CAL}, a AS (SELECT *, least(greatest(0.45 * (1 - uncertainty) + 0.30 * agreement + 0.25 * (1 - error), 0), 1) AS confidence FROM c), b AS (SELECT *, least(greatest(0.4 * uncertainty + 0.35 * (1 - confidence) + 0.25 * volatility, 0), 1) AS risk, least(greatest((confidence * 1.5 - (1 - confidence)) / 1.5, 0), 0.25) AS kelly FROM a)
SELECT event_id, round(confidence, 6) AS confidence, round(risk, 6) AS risk, round(kelly, 6) AS kelly, round(least(greatest(kelly * confidence * (1 - risk), 0.01), 0.1), 6) AS size, concat_ws(';', CASE WHEN uncertainty > 0.5 THEN 'high uncertainty' END, CASE WHEN confidence < 0.4 THEN 'low confidence' END, CASE WHEN volatility > 0.6 THEN 'volatile' END, CASE WHEN agreement < 0.3 THEN 'models disagree' END) AS warnings,
CASE WHEN confidence <= 0.2 THEN 'very_low' WHEN confidence <= 0.4 THEN 'low' WHEN confidence <= 0.6 THEN 'medium' WHEN confidence <= 0.8 THEN 'high' ELSE 'very_high' END AS confidence_level, CASE WHEN risk <= 0.2 THEN 'low' WHEN risk <= 0.4 THEN 'moderate' WHEN risk <= 0.6 THEN 'high' ELSE 'extreme' END AS risk_level, CASE WHEN confidence > 0.6 AND risk <= 0.4 THEN 'buy' WHEN confidence > 0.4 AND risk <= 0.6 THEN 'hold' ELSE 'avoid' END AS action FROM b"""
ORACLE_SQL = {
    "pair_correlations": f"""{_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY x) AS ox, row_number() OVER (PARTITION BY a, b ORDER BY y) AS oy, CASE WHEN count(x) {_W} = 20 THEN covar_samp(x, y) {_W} / nullif(stddev_samp(x) {_W} * stddev_samp(y) {_W}, 0) END AS rl FROM p), q AS (SELECT *, avg(ox) OVER (PARTITION BY a, b, x) AS rx, avg(oy) OVER (PARTITION BY a, b, y) AS ry FROM k)
 SELECT a, b, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) AS pearson, round(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0), 6) AS spearman, round(covar_samp(x, y) / nullif(var_samp(y), 0), 6) AS beta, round(avg(rl), 6) AS rolling_mean, round(stddev_samp(rl), 6) AS rolling_sd, round(min(rl), 6) AS rolling_min, round(max(rl), 6) AS rolling_max, round(1 - stddev_samp(rl), 6) AS stability FROM q GROUP BY a, b""",
    "correlation_features": f"""{_PAIRS}, u AS (SELECT a AS symbol, b AS other, bar_ts, x, y FROM p UNION ALL SELECT b, a, bar_ts, y, x FROM p), c AS (SELECT symbol, bar_ts, CASE WHEN count(x) {_W.replace('a, b', 'symbol, other')} = 20 THEN covar_samp(x, y) {_W.replace('a, b', 'symbol, other')} / nullif(stddev_samp(x) {_W.replace('a, b', 'symbol, other')} * stddev_samp(y) {_W.replace('a, b', 'symbol, other')}, 0) END AS c FROM u),
 g AS (SELECT symbol, bar_ts, avg(c) AS mean, max(c) AS most, min(c) AS least, stddev_pop(c) AS spread FROM c GROUP BY 1, 2) SELECT symbol, bar_ts, round(mean, 6) AS mean, round(most, 6) AS most, round(least, 6) AS least, round(spread, 6) AS spread, round(mean - lag(mean, 5) OVER (PARTITION BY symbol ORDER BY bar_ts), 6) AS momentum FROM g""",
    "market_features": f"""{_B}, x AS (SELECT *, CASE WHEN count(ret) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) = 10 THEN CASE WHEN avg(ret) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) > 0 THEN 1.0 ELSE 0.0 END END AS rising FROM r), d AS (SELECT bar_ts, avg(ret) AS market_ret, stddev_pop(ret) AS dispersion, avg(rising) AS breadth, sum(volume) AS market_volume FROM x GROUP BY 1)
 SELECT bar_ts, round(market_ret, 6) AS market_ret, round(dispersion, 6) AS dispersion, round(breadth, 6) AS breadth, round(market_volume, 6) AS market_volume, CASE WHEN count(market_ret) OVER (ORDER BY bar_ts ROWS 9 PRECEDING) = 10 THEN round(stddev_samp(market_ret) OVER (ORDER BY bar_ts ROWS 9 PRECEDING), 6) END AS market_vol FROM d""",
    "sector_momentum": f"""{_B}, m AS (SELECT CASE WHEN symbol < '3' THEN 'fast' ELSE 'slow' END AS sector, bar_ts, close / nullif(lag(close, 10) OVER (PARTITION BY symbol ORDER BY bar_ts), 0) - 1 AS mo FROM bars), a AS (SELECT bar_ts, avg(mo) AS market FROM m GROUP BY 1)
 SELECT sector, m.bar_ts, round(avg(mo), 6) AS momentum, round(avg(mo) - max(market), 6) AS relative, round(stddev_pop(mo), 6) AS dispersion, count(mo) AS members FROM m JOIN a ON a.bar_ts = m.bar_ts GROUP BY 1, 2 HAVING count(mo) >= 2""",
    "covariance_matrix": f"{_COV} SELECT a, b, round(cov, 6) AS cov, round(corr, 6) AS corr FROM c",
    "shrunk_covariance": f"""{_COV}, s AS (SELECT sum(CASE WHEN a = b THEN cov END) AS tr, sum(cov * cov) AS sq, count_if(a = b) AS m FROM c), h AS (SELECT *, least(1.0, ((1 - 2.0 / m) * sq + tr * tr) / nullif((252 + 1 - 2.0 / m) * (sq - tr * tr / m), 0)) AS rho FROM s) SELECT a, b, round((1 - rho) * cov + CASE WHEN a = b THEN rho * tr / m ELSE 0 END, 6) AS cov, round(rho, 6) AS rho FROM c, h""",
    "portfolio_risk": f"""{_COV}, w AS (SELECT symbol, sum(volume) / sum(sum(volume)) OVER () AS weight FROM bars GROUP BY 1), g AS (SELECT a, sum(cov * weight) AS marginal FROM c JOIN w ON w.symbol = c.b GROUP BY 1) SELECT a AS symbol, round(weight, 6) AS weight, round(marginal, 6) AS marginal, round(weight * marginal, 6) AS contribution, round(weight * marginal / nullif(sum(weight * marginal) OVER (), 0), 6) AS share FROM g JOIN w ON w.symbol = g.a""",
    "asset_ranking": f"""{_B}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS back, close / max(close) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM r),
 s AS (SELECT symbol, avg(ret) AS ret0, avg(ret) / nullif(stddev_samp(ret), 0) AS risk0, min(dd) AS dd0, (max(close) FILTER (back = 1) / max(close) FILTER (back = 21) - 1 + max(close) FILTER (back = 1) / max(close) FILTER (back = 63) - 1 + max(close) FILTER (back = 1) / max(close) FILTER (back = 126) - 1) / 3 AS mom0 FROM b GROUP BY 1),
 n AS (SELECT symbol, {', '.join(f'coalesce(({k}0 - min({k}0) OVER ()) / nullif(max({k}0) OVER () - min({k}0) OVER (), 0), 0.5) AS {k}' for k in ('ret', 'risk', 'mom', 'dd'))} FROM s), z AS (SELECT *, 0.3 * ret + 0.3 * risk + 0.2 * mom + 0.2 * dd AS score FROM n)
 SELECT symbol, round(ret, 6) AS ret, round(risk, 6) AS risk, round(mom, 6) AS mom, round(dd, 6) AS dd, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, symbol)::INT AS rank FROM z""",
    "reliability_bins": f"{_CAL}, {_BINS} SELECT bin, round(centre, 6)::DOUBLE AS centre, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM s",
    "calibration_scores": f"{_CAL}, {_BINS} SELECT (SELECT round(sum(abs(accuracy - confidence) * n) / sum(n), 6) FROM s) AS ece, round(avg(uncertainty), 6) AS sharpness, round(avg(CASE WHEN error <= 1.959963984540054 * uncertainty THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM c",
    "confidence_risk": _RISK,
    "prediction_intervals": f"{_CAL} SELECT event_id, round(uncertainty, 6) AS prediction, round(uncertainty - 1.959963984540054 * error, 6) AS low95, round(uncertainty + 1.959963984540054 * error, 6) AS high95, round(uncertainty - 1.6448536269514722 * error, 6) AS low90, round(uncertainty + 1.6448536269514722 * error, 6) AS high90, round(uncertainty / 1.5, 6) AS scaled FROM c",
    "uncertainty_split": f"{_CAL} SELECT event_type, round(var_samp(uncertainty), 6) AS epistemic, round(avg(error * error), 6) AS aleatoric, round(sqrt(var_samp(uncertainty) + avg(error * error)), 6) AS total FROM c GROUP BY 1",
}
