"""Queries of regimes after labelling, reports and validation, with SQL that is written by hand from the definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import rolling as r
from tempora.operators import regime_analysis, reporting, validation
from tempora.sources.bars import BARS_SQL, PREDICTIONS_SQL, bars_weekly, predictions, read


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def _of(operator):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(operator(regime_analysis.labelled_log(bars_weekly(spark, sf_dir))))

    return run


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("model_id", "period_id", "ts", "event_id", (F.col("prediction") / 1000 - 0.05).alias("strategy"), (F.col("actual") / 1000 - 0.05).alias("benchmark"))


def benchmark_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reporting.benchmark_comparison(_returns(spark, sf_dir)))


def model_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reporting.scorecard(_returns(spark, sf_dir)))


def tolerance_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reporting.tolerance_accuracy(predictions(spark, sf_dir)))


def return_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(validation.return_outliers(bars_weekly(spark, sf_dir), 2.0))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of rows whose features are the last return and the volume, infinite above 50 rows a bar; the target is the next return."""
    bars = bars_weekly(spark, sf_dir).select("*", r.change("close").alias("ret"), (r.lead("close") / F.col("close") - 1).alias("target"))
    features = F.array("ret", F.when(F.col("volume") > 50, F.lit(float("inf"))).otherwise(F.col("volume")))
    found = validation.training_issues(*[F.col(c) for c in ("open", "high", "low", "close")], F.col("volume") - 2, features, F.col("target"))
    return bars.select("symbol", "bar_ts", validation.feature_vector_issues(features).alias("feature_issues"), found.alias("issues"))


def weight_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolios of part brands by size; weights are rounded, and shifted below 0 for small shares."""
    parts = read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("portfolio"), "p_brand").agg(F.sum("p_retailprice").alias("v"))
    total = parts.groupBy("portfolio").agg(F.sum("v").alias("t"))
    weights = parts.join(total, "portfolio").select("portfolio", F.round(F.col("v") / F.col("t") - F.when(F.col("portfolio") % 5 == 0, 0.04).otherwise(0.0), 3).alias("weight"))
    return _round(validation.weight_issues(weights))


def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first and last order as a range, turned round for every third customer, as of 1998."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    swap = F.col("o_custkey") % 3 == 0
    o = o.select("o_custkey", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("start"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("end"))
    return o.select("o_custkey", validation.date_range_issues(F.col("start"), F.col("end"), F.lit("1998-01-01").cast("timestamp_ntz")).alias("issues"))


QUERIES = {
    "regime_smoothing": _of(regime_analysis.smoothed), "regime_distribution": _of(regime_analysis.distribution), "regime_performance": _of(regime_analysis.performance),
    "regime_summary": _of(regime_analysis.summary), "regime_transitions": _of(regime_analysis.transitions), "regime_routed_forecast": _of(regime_analysis.routed),
    **{f.__name__: f for f in (benchmark_comparison, model_scorecard, tolerance_accuracy, return_outliers, training_rows, weight_validation, date_ranges)},
}
_P = "(PARTITION BY symbol ORDER BY bar_ts)"
_W = "PARTITION BY symbol ORDER BY bar_ts ROWS"
_LOG = f"""WITH {BARS_SQL}, b AS (SELECT symbol, bar_ts, close, close / nullif(lag(close) OVER {_P}, 0) - 1 AS actual, CASE WHEN count(close) OVER ({_W} 9 PRECEDING) = 10 THEN avg(close) OVER ({_W} 9 PRECEDING) END AS m FROM bars),
c AS (SELECT *, lag(actual) OVER {_P} AS prediction FROM b), g AS (SELECT symbol, bar_ts, CASE WHEN close > 1.05 * m THEN 'bull' WHEN close < 0.95 * m THEN 'bear' ELSE 'sideways' END AS regime, prediction, actual FROM c WHERE m IS NOT NULL AND prediction IS NOT NULL AND actual IS NOT NULL)"""
_PERF = f"""{_LOG}, l AS (SELECT *, exp(sum(ln(1 + prediction)) OVER (PARTITION BY symbol, regime ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)) AS level FROM g), k AS (SELECT *, level / max(level) OVER (PARTITION BY symbol, regime ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM l),
p AS (SELECT symbol, regime, count(*) AS n, count(DISTINCT bar_ts::DATE) AS periods, avg(abs(prediction - actual)) AS mae, sqrt(avg((prediction - actual) * (prediction - actual))) AS rmse, 100 * avg(CASE WHEN sign(prediction) = sign(actual) THEN 1.0 ELSE 0.0 END) AS direction,
 coalesce(avg(prediction) / nullif(stddev_pop(prediction), 0) * sqrt(252), 0) AS sharpe, abs(min(dd)) AS max_drawdown, avg(CASE WHEN prediction > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(prediction) AS mean_return, stddev_pop(prediction) * sqrt(252) AS volatility FROM k GROUP BY 1, 2)"""
_RET = f"WITH {PREDICTIONS_SQL}, r AS (SELECT model_id, period_id, prediction / 1000 - 0.05 AS s, actual / 1000 - 0.05 AS b FROM predictions)"
ORACLE_SQL = {
    "regime_smoothing": f"""{_LOG}, o AS (SELECT *, CASE WHEN count(*) OVER ({_W} BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 AND len(list_distinct(list(regime) OVER ({_W} BETWEEN 3 PRECEDING AND 1 PRECEDING))) = 1 AND lag(regime) OVER {_P} <> regime THEN lag(regime) OVER {_P} END AS other FROM g)
 SELECT symbol, bar_ts, regime, coalesce(other, regime) AS smoothed, CASE WHEN other IS NULL THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence_factor FROM o""",
    "regime_distribution": f"{_LOG} SELECT symbol, regime, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6)::DOUBLE AS percent FROM g GROUP BY 1, 2",
    "regime_performance": f"{_PERF} SELECT symbol, regime, n AS rows, periods, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(direction, 6) AS direction, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown, round(win_rate, 6) AS win_rate, round(mean_return, 6) AS mean_return, round(volatility, 6) AS volatility FROM p",
    "regime_summary": f"""{_PERF}, w AS (SELECT symbol, count(*) AS n, avg(abs(prediction - actual)) AS mae, 100 * avg(CASE WHEN sign(prediction) = sign(actual) THEN 1.0 ELSE 0.0 END) AS direction, count(DISTINCT regime) AS regimes FROM g GROUP BY 1)
 SELECT symbol, w.n AS rows, round(w.mae, 6) AS mae, round(w.direction, 6) AS direction, regimes, (SELECT regime FROM p WHERE p.symbol = w.symbol ORDER BY p.mae, regime LIMIT 1) AS best, (SELECT regime FROM p WHERE p.symbol = w.symbol ORDER BY p.mae DESC, regime DESC LIMIT 1) AS worst FROM w""",
    "regime_transitions": f"""{_LOG}, k AS (SELECT *, row_number() OVER {_P} AS k, lag(regime) OVER {_P} AS old, abs(prediction - actual) AS e FROM g), t AS (SELECT a.symbol, a.bar_ts, a.old, a.regime, avg(b.e) FILTER (b.k < a.k AND b.regime = a.old) AS x, avg(b.e) FILTER (b.k >= a.k AND b.regime = a.regime) AS y
 FROM k a JOIN k b ON b.symbol = a.symbol AND b.k BETWEEN a.k - 10 AND a.k + 9 WHERE a.old <> a.regime GROUP BY 1, 2, 3, 4) SELECT symbol, bar_ts, old AS from_regime, regime AS to_regime, round(x, 6) AS before_mae, round(y, 6) AS after_mae, round(y - x, 6) AS change FROM t""",
    "regime_routed_forecast": f"""{_LOG}, m AS (SELECT symbol, regime, regr_slope(actual, prediction) AS a, regr_intercept(actual, prediction) AS b FROM g GROUP BY 1, 2 HAVING count(*) >= 50), h AS (SELECT symbol, regr_slope(actual, prediction) AS a, regr_intercept(actual, prediction) AS b FROM g GROUP BY 1)
 SELECT g.symbol, bar_ts, g.regime, round(CASE WHEN m.symbol IS NULL THEN h.a * prediction + h.b ELSE m.a * prediction + m.b END, 6) AS forecast, (m.symbol IS NOT NULL)::INT AS own_model FROM g LEFT JOIN m ON m.symbol = g.symbol AND m.regime = g.regime JOIN h ON h.symbol = g.symbol""",
    "benchmark_comparison": f"""{_RET}, a AS (SELECT model_id, 252 * avg(s) AS sr, 252 * avg(b) AS br, sqrt(252) * stddev_pop(s) AS sv, sqrt(252) * stddev_pop(b) AS bv, sqrt(252) * stddev_pop(s - b) AS te, covar_samp(s, b) / var_pop(b) AS beta, corr(s, b) AS rho, avg(s) FILTER (b > 0) / avg(b) FILTER (b > 0) AS up, avg(s) FILTER (b < 0) / avg(b) FILTER (b < 0) AS down FROM r GROUP BY 1)
 SELECT model_id, round(sr, 6) AS strategy_return, round(br, 6) AS benchmark_return, round(sv, 6) AS strategy_volatility, round(bv, 6) AS benchmark_volatility, round(te, 6) AS tracking_error, round((sr - br) / te, 6) AS information_ratio, round(beta, 6) AS beta, round(rho, 6) AS correlation, round(coalesce(up, 0), 6) AS up_capture, round(coalesce(down, 0), 6) AS down_capture,
 round(sr - br, 6) AS excess_return, round(sr - beta * br, 6) AS alpha, round(sr / sv, 6) AS strategy_sharpe, round(br / bv, 6) AS benchmark_sharpe FROM a""",
    "model_scorecard": f"""{_RET}, f AS (SELECT model_id, period_id, avg(abs(s - b)) AS e FROM r GROUP BY 1, 2), c AS (SELECT model_id, 1 - stddev_pop(e) / avg(e) AS consistency, regr_slope(e, period_id) AS drift FROM f GROUP BY 1),
 a AS (SELECT model_id, avg(abs(s - b)) AS mae, 100 * avg(CASE WHEN sign(s) = sign(b) THEN 1.0 ELSE 0.0 END) AS direction, avg(s) / stddev_pop(s) * sqrt(252) AS sharpe FROM r GROUP BY 1), x AS (SELECT *, concat_ws(';', CASE WHEN mae > 0.02 THEN 'high_error' END, CASE WHEN direction < 55 THEN 'weak_direction' END, CASE WHEN sharpe < 1 THEN 'low_sharpe' END, CASE WHEN consistency < 0.7 THEN 'inconsistent' END, CASE WHEN drift > 0.001 THEN 'worsening' END, CASE WHEN direction > 65 THEN 'good_direction' END, CASE WHEN sharpe > 2 THEN 'excellent_sharpe' END, CASE WHEN consistency > 0.8 THEN 'consistent' END) AS t FROM a JOIN c USING (model_id))
 SELECT model_id, round(mae, 6) AS mae, round(direction, 6) AS direction, round(sharpe, 6) AS sharpe, round(consistency, 6) AS consistency, round(drift, 6) AS drift, round(0.4 * greatest(0, 1 - mae) + 0.3 * direction / 100 + 0.3 * greatest(0, least(1, sharpe / 2)), 6) AS score, CASE WHEN t = '' THEN 'meets_targets' ELSE t END AS advice FROM x""",
    "tolerance_accuracy": f"""WITH {PREDICTIONS_SQL}, e AS (SELECT model_id, 100 * abs((actual - prediction) / actual) AS e FROM predictions WHERE actual <> 0), a AS (SELECT model_id, count(*) AS n, avg(e) AS m, median(e) AS md, max(e) AS mx, 100 * avg((e <= 1)::INT) AS w1, 100 * avg((e <= 2)::INT) AS w2, 100 * avg((e <= 3)::INT) AS w3 FROM e GROUP BY 1)
 SELECT model_id, n AS rows, round(m, 6) AS mean_error, round(md, 6) AS median_error, round(mx, 6) AS max_error, round(w1, 6) AS within_1, round(w2, 6) AS within_2, round(w3, 6) AS within_3, CASE WHEN w2 >= 90 THEN 'excellent' WHEN w2 >= 80 THEN 'good' WHEN w2 >= 70 THEN 'acceptable' ELSE 'needs_improvement' END AS status FROM a""",
    "return_outliers": f"WITH {BARS_SQL}, r AS (SELECT symbol, bar_ts, close / nullif(lag(close) OVER {_P}, 0) - 1 AS ret FROM bars), z AS (SELECT *, (ret - avg(ret) OVER (PARTITION BY symbol)) / nullif(stddev_samp(ret) OVER (PARTITION BY symbol), 0) AS z FROM r) SELECT symbol, bar_ts, round(ret, 6) AS ret, round(z, 6) AS z FROM z WHERE abs(z) > 2",
    "training_rows": f"""WITH {BARS_SQL}, r AS (SELECT *, lag(close) OVER {_P} AS old, lead(close) OVER {_P} AS new FROM bars), f AS (SELECT *, concat_ws(';', CASE WHEN old IS NULL THEN 'null' END, CASE WHEN volume > 50 THEN 'infinite' END) AS fi FROM r)
 SELECT symbol, bar_ts, fi AS feature_issues, concat_ws(';', CASE WHEN least(open, high, low, close) <= 0 THEN 'price' END, CASE WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 'range' END, CASE WHEN volume < 2 THEN 'volume' END, nullif(fi, ''), CASE WHEN new IS NULL THEN 'target' END) AS issues FROM f""",
    "weight_validation": """WITH p AS (SELECT p_size AS portfolio, p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1, 2), w AS (SELECT portfolio, round(v / sum(v) OVER (PARTITION BY portfolio) - CASE WHEN portfolio % 5 = 0 THEN 0.04 ELSE 0 END, 3) AS weight FROM p), a AS (SELECT portfolio, count(*) AS assets, sum(weight) AS total, count_if(weight < 0) AS negative FROM w GROUP BY 1)
 SELECT portfolio, assets, round(total, 6) AS total, negative::BIGINT AS negative, CASE WHEN abs(total - 1) > 0.01 THEN 'error' WHEN abs(total - 1) > 1e-6 OR negative > 0 THEN 'warning' ELSE 'valid' END AS status, concat_ws(';', CASE WHEN abs(total - 1) > 0.01 THEN 'sum' END, CASE WHEN abs(total - 1) > 1e-6 AND abs(total - 1) <= 0.01 THEN 'sum_rounded' END, CASE WHEN negative > 0 THEN 'negative' END) AS issues FROM a""",
    "date_ranges": """WITH o AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1), r AS (SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN b ELSE a END AS s, CASE WHEN o_custkey % 3 = 0 THEN a ELSE b END AS e FROM o)
 SELECT o_custkey, concat_ws(';', CASE WHEN s >= e THEN 'order' END, CASE WHEN e > TIMESTAMP '1998-01-01' THEN 'future' END, CASE WHEN s < e AND e - s < INTERVAL 1 DAY THEN 'short' END) AS issues FROM r""",
}
