"""Queries of scalars, statistics, ensembles, selection, models and registries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import scalars as s
from tempora.operators import ensembles, metrics, models, statistics
from tempora.operators.feature_sets import apply
from tempora.plans.feature_queries import ORACLE_SQL as _FEATURE_SQL
from tempora.plans.metric_queries import _D
from tempora.sources import sinks
from tempora.sources.bars import BARS_SQL, bars_weekly, predictions, read


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_size") % 12).alias("k"))
    x, y, k = F.col("x"), F.col("y"), F.col("k")
    out = p.select(
        "p_partkey", s.safe_log(x - 10).alias("log"), s.safe_sqrt(x - 10).alias("root"), s.percentage_change(x + 1, y).alias("change"), s.log_return(x + 1, y).alias("log_return"), s.cagr(x + 1, y, k + 1.0).alias("cagr"), s.annualise_return(x / 1000, k + 1.0, 12).alias("annual"), s.annualise_volatility(x / 1000).alias("vol"),
        s.interpolate(x, F.lit(0.0), F.lit(1.0), F.lit(50.0), F.lit(3.0)).alias("line"), s.clamp(x, F.lit(10.0), F.lit(40.0)).alias("clamped"), s.approximately_equal(x, F.lit(20.0), 0.5).cast("int").alias("near"), s.round_up_half(x / 8 - 3, 1).alias("rounded"), s.factorial(k).alias("factorial"),
        s.combination(F.lit(12), k).alias("combination"), s.permutation(F.lit(8), k).alias("permutation"), s.gcd(x, F.lit(36)).alias("gcd"), s.lcm(x.cast("long"), F.lit(36)).alias("lcm"), F.size(s.half_open_range(F.lit(0.0), x, F.lit(7.0))).alias("steps"),
        F.aggregate(s.linspace(F.lit(0.0), x, 5), F.lit(0.0), lambda a, v: a + v).alias("lin"), F.get(s.logspace(F.lit(0.0), x / 25, 3), F.lit(1)).alias("logmid"),
    )
    return _round(out)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")


def descriptive_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.describe(_values(spark, sf_dir), "event_type", "value"), 5)


def expected_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.expected_shortfall(_values(spark, sf_dir), "event_type", "value"))


def autocorrelation_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.autocorrelations(_values(spark, sf_dir), "event_type", ["ts", "event_id"], "value"))


def level_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.level_drawdown(_values(spark, sf_dir), "event_type", ["ts", "event_id"], "value"))


def standardised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.standardised(_values(spark, sf_dir), "event_type", "event_id", "value"))


def value_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.modes(_values(spark, sf_dir), "event_type", F.floor("value"))


def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ensembles.weights(metrics.by_fold(predictions(spark, sf_dir)).withColumn("r2", 1 - F.col("rmse") / 100).select("period_id", "model_id", "rmse", "mae", "r2", "direction"), ["period_id"]).drop("rmse", "mae", "r2", "direction"))


def combined_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("period_id", "prediction", (1 / (1 + F.col("error"))).alias("weight"))
    return _round(ensembles.combine(p, "period_id"))


FEATURES = ["rsi14", "position", "width", "volume_ratio", "price_position", "daily_range", "ratio5", "ratio20"]


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = apply(bars_weekly(spark, sf_dir), "feature_pipeline")
    return wide.select("symbol", "bar_ts", "n", *FEATURES, F.expr("lead(ret) OVER (PARTITION BY symbol ORDER BY bar_ts)").alias("target")).dropna()


def feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ensembles.feature_scores(_table(spark, sf_dir), FEATURES, "target"))


def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, stage): features that survive correlation pruning, and those that recursive elimination keeps."""
    table = _table(spark, sf_dir).persist()
    left = ensembles.correlation_prune(table, FEATURES, 0.6)
    kept = models.recursive_elimination(table, left, "target", 3)
    return spark.createDataFrame([(f, "pruned") for f in left] + [(f, "kept") for f in kept], "feature string, stage string")


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.compare(_table(spark, sf_dir), FEATURES, "target", "n <= 250")


def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.importances(_table(spark, sf_dir), FEATURES, "target")


def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return models.isotonic(p.select((F.col("prediction") / 500).alias("x"), (F.col("error") / 500).alias("y")), "x", "y")


def asset_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = statistics.describe(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal"), "nation", "c_acctbal")
    return models.clusters(stats.fillna(0.0), "nation", ["mean", "sd", "skew"])


def factor_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.principal_components(_table(spark, sf_dir), FEATURES)


def hyperparameter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.grid_search(_table(spark, sf_dir), FEATURES, "target", "n <= 250", [{"numTrees": a, "maxDepth": b} for a in (5, 10) for b in (2, 4)])


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("cost"), (100 - F.col("p_size")).alias("loss"))
    return ensembles.pareto(p, "p_partkey", ["cost", "loss"])


def latest_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest orders of each customer (keep-latest-k)."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("saved"))
    return sinks.retained(o, "o_custkey", "saved", 3).select("o_custkey", "o_orderkey")


def config_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as configurations, line items as their records, the best price of each."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("config_id"), "p_brand")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("config_id"), F.col("l_extendedprice").alias("mse"))
    return sinks.best_records(parts, lines, "mse")


def asset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.metadata(bars_weekly(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (scalar_functions, descriptive_statistics, expected_shortfall, autocorrelation_function, level_drawdown, standardised_values, value_modes, ensemble_weights, combined_predictions, feature_scores, selected_features, model_comparison, forest_importance, isotonic_calibration, asset_clusters, factor_loadings, hyperparameter_search, pareto_front, latest_per_name, config_records, asset_metadata)
}
_WT = {
    "w_inverse": "1.0 / nullif(rmse, 0)", "w_mae": "1.0 / nullif(mae, 0)", "w_r2": "greatest(r2, 0.01)", "w_direction": "direction", "w_equal": "1.0", "w_exp": "exp(-rmse / nullif(max(rmse) OVER (PARTITION BY period_id), 0))",
    "w_softmax": "exp(-(rmse - min(rmse) OVER (PARTITION BY period_id)) / 10)", "w_decay": "pow(0.95, row_number() OVER (PARTITION BY period_id ORDER BY rmse, model_id) - 1)",
}
_G = "PARTITION BY period_id"
_TABLE = "WITH RECURSIVE " + _FEATURE_SQL["feature_pipeline"].split("\nSELECT symbol")[0].removeprefix("WITH ") + f", tb0 AS (SELECT symbol, bar_ts, {', '.join(FEATURES)}, lead(ret) OVER (PARTITION BY symbol ORDER BY bar_ts) AS target FROM s4_), tb AS (SELECT * FROM tb0 WHERE target IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)})"
_LONG = ", lg AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS x, target AS y FROM tb" for f in FEATURES) + ")"
ORACLE_SQL = {
    "asset_metadata": f"WITH {BARS_SQL} SELECT symbol, count(*) AS row_count, min(bar_ts) AS start_date, max(bar_ts) AS end_date, avg(((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT) / 5) AS missing_data_pct, 1 - avg(((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT) / 5) AS data_quality_score FROM bars GROUP BY 1",
    "scalar_functions": """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y, p_size % 12 AS k FROM part)
 SELECT p_partkey, round(CASE WHEN x > 10 THEN ln(x - 10) END, 6) AS log, round(CASE WHEN x >= 10 THEN sqrt(x - 10) END, 6) AS root, round((y - x - 1) / abs(x + 1), 6) AS change, round(ln(y / (x + 1)), 6) AS log_return, round(pow(y / (x + 1), 1.0 / (k + 1)) - 1, 6) AS cagr, round(pow(1 + x / 1000, 12.0 / (k + 1)) - 1, 6) AS annual, round(x / 1000 * sqrt(252), 6) AS vol,
 round(1 + 2 * x / 50, 6) AS line, least(greatest(x, 10), 40)::DOUBLE AS clamped, (abs(x - 20) < 0.5)::INT AS near, round(floor((x / 8 - 3) * 10 + 0.5) / 10, 6) AS rounded, factorial(k::INT)::DOUBLE AS factorial, (factorial(12) / (factorial(k::INT) * factorial((12 - k)::INT)))::DOUBLE AS combination, CASE WHEN k > 8 THEN 0.0 ELSE (factorial(8) / factorial(greatest(8 - k, 0)::INT))::DOUBLE END AS permutation,
 gcd(x::BIGINT, 36)::BIGINT AS gcd, lcm(x::BIGINT, 36)::BIGINT AS lcm, ceil(x / 7)::INT AS steps, round(x * 2.5, 6) AS lin, round(pow(10, x / 50), 6) AS logmid FROM p""",
    "descriptive_statistics": """WITH v AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS mu FROM events), md AS (SELECT event_type, value AS mode FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, value) AS k FROM events GROUP BY 1, 2) WHERE k = 1),
 a AS (SELECT event_type, count(value) AS n, sum(value) AS total, avg(value) AS mean, stddev_samp(value) AS sd, stddev_pop(value) AS sd_pop, var_samp(value) AS var, skewness(value) AS skew, kurtosis(value) AS kurt, min(value) AS least, max(value) AS most, avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) AS s, avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3 AS k, quantile_cont(value, 0.05) AS q0, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY 1)
 SELECT event_type, n, round(total, 5) AS total, round(a.mean, 5) AS mean, round(sd, 5) AS sd, round(sd_pop, 5) AS sd_pop, round(var, 5) AS var, round(skew, 5) AS skew, round(kurt, 5) AS kurt, round(least, 5) AS least, round(most, 5) AS most, round(n / 6 * (s * s + k * k / 4), 5) AS jarque_bera, round(exp(-(n / 6 * (s * s + k * k / 4)) / 2), 5) AS jb_p, round(mode, 5) AS mode, round(q1, 5) AS q1, round(md, 5) AS median, round(q3, 5) AS q3, round(q3 - q1, 5) AS iqr, round(-q0, 5) AS value_at_risk, round(most - least, 5) AS extent, round(sd / nullif(a.mean, 0), 5) AS cv FROM a JOIN md USING (event_type)""",
    "expected_shortfall": "WITH q AS (SELECT event_type, quantile_cont(value, 1 - 0.95) AS q FROM events GROUP BY 1) SELECT event_type, round(-avg(value), 6) AS shortfall FROM events JOIN q USING (event_type) WHERE value <= q GROUP BY 1",
    "autocorrelation_function": "WITH x AS (SELECT event_type, value, " + ", ".join(f"lag(value, {k}) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS y{k}" for k in range(1, 6)) + " FROM events), l AS (" + " UNION ALL ".join(f"SELECT event_type, {k} AS lag, value AS x, y{k} AS y FROM x WHERE y{k} IS NOT NULL" for k in range(1, 6)) + ") SELECT event_type, lag, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) AS acf FROM l GROUP BY 1, 2",
    "level_drawdown": "WITH d AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, value / max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS d0, (value - max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) / nullif(max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS d FROM events) SELECT event_type, round(min(d), 6) AS drawdown, arg_min(k, {'a': d, 'b': k})::INT AS at FROM d GROUP BY 1",
    "standardised_values": "WITH w AS (SELECT *, min(value) OVER (PARTITION BY event_type) AS a, max(value) OVER (PARTITION BY event_type) AS b, avg(value) OVER (PARTITION BY event_type) AS m, stddev_samp(value) OVER (PARTITION BY event_type) AS s FROM events) SELECT event_id, round(coalesce((value - a) / nullif(b - a, 0), 0), 6) AS min_max, round(coalesce((value - m) / nullif(s, 0), 0), 6) AS z, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS total, round(exp(sum(ln(1 + value / 1e6)) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)) - 1, 6) AS product FROM w",
    "value_modes": "WITH c AS (SELECT event_type, floor(value)::BIGINT AS value, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS k FROM c) SELECT event_type, value, n FROM r WHERE k = 1",
    "ensemble_weights": f"""{_D}, f AS (SELECT model_id, period_id, avg(error) AS mae, sqrt(avg(squared_error)) AS rmse, avg(same) AS direction, 1 - sqrt(avg(squared_error)) / 100 AS r2 FROM d GROUP BY 1, 2), x AS (SELECT *, {', '.join(f'{v} AS x_{k}' for k, v in _WT.items())} FROM f), y AS (SELECT *, {', '.join(f'coalesce(x_{k} / nullif(sum(x_{k}) OVER ({_G}), 0), 1.0 / count(*) OVER ({_G})) AS {k}' for k in _WT)} FROM x),
 z AS (SELECT *, greatest(w_softmax, 0.05) / sum(greatest(w_softmax, 0.05)) OVER ({_G}) AS w_floor, 0.7 * w_inverse + 0.3 * w_r2 AS w_blend FROM y) SELECT period_id, model_id, {', '.join(f'round({k}, 6)::DOUBLE AS {k}' for k in (*_WT, 'w_floor', 'w_blend'))} FROM z""",
    "combined_predictions": f"""{_D}, p AS (SELECT period_id, prediction AS p, 1 / (1 + error) AS w FROM d), a AS (SELECT period_id, count(*) AS models, avg(p) AS mean, sum(p * w) / nullif(sum(w), 0) AS weighted, stddev_pop(p) AS spread, sum(w * p * p) / nullif(sum(w), 0) AS sq FROM p GROUP BY 1)
 SELECT period_id, models, round(mean, 6) AS mean, round(weighted, 6) AS weighted, round(spread, 6) AS spread, round(mean - 1.96 * spread, 6) AS low, round(mean + 1.96 * spread, 6) AS high, round(weighted - 1.96 * sqrt(greatest(sq - weighted * weighted, 0)), 6) AS weighted_low, round(greatest(1 - spread / nullif(abs(mean), 0), 0), 6) AS confidence FROM a""",
    "pareto_front": "WITH p AS (SELECT p_partkey, p_retailprice AS cost, 100 - p_size AS loss FROM part) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.cost < a.cost AND b.loss < a.loss)",
    "latest_per_name": "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE k <= 3",
    "config_records": "WITH b AS (SELECT l_partkey AS config_id, min(l_extendedprice) AS mse, count(*) AS records FROM lineitem GROUP BY 1) SELECT p_partkey AS config_id, p_brand, mse, records FROM part LEFT JOIN b ON b.config_id = p_partkey",
    "feature_scores": _TABLE.replace("WITH RECURSIVE ", "WITH ", 1) + _LONG + f""", r AS (SELECT feature, count(*) AS n, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS rho, {', '.join(f'quantile_cont({v}, {k / 8}) AS {v}q{k}' for v in 'xy' for k in range(1, 8))} FROM lg GROUP BY 1),
 c AS (SELECT feature, {' + '.join(f'(xq{k} < x)::INT' for k in range(1, 8))} AS bx, {' + '.join(f'(yq{k} < y)::INT' for k in range(1, 8))} AS bz, count(*) AS c FROM lg JOIN r USING (feature) GROUP BY 1, 2, 3),
 m AS (SELECT feature, c / sum(c) OVER (PARTITION BY feature) AS p, sum(c) OVER (PARTITION BY feature, bx) / sum(c) OVER (PARTITION BY feature) AS px, sum(c) OVER (PARTITION BY feature, bz) / sum(c) OVER (PARTITION BY feature) AS py FROM c), i AS (SELECT feature, sum(p * ln(p / (px * py))) AS mi FROM m GROUP BY 1)
 SELECT feature, n, round(rho, 6) AS rho, round((n - 2) * (rho * rho / nullif(1 - rho * rho, 0)), 6) AS f_score, round(mi, 6) AS mi FROM r JOIN i USING (feature)""",
}
