"""Queries of outlier analysis, adaptive weights and relations across symbols over time, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import adaptive_weights, cross_regimes, detectors, outlier_analysis, outliers
from tempora.plans.monitor_queries import _MASK, _Y, _closes, _metrics
from tempora.sources.bars import BARS_SQL, PREDICTIONS_SQL, bars_weekly, predictions


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def _of(source, operator):
    return lambda spark, sf_dir: _round(operator(source(spark, sf_dir)))


QUERIES = {
    "outlier_patterns": _of(_closes, lambda df: outlier_analysis.patterns(outliers.global_masks(df))), "local_patterns": _of(_closes, outlier_analysis.local_patterns), "stress_periods": _of(_closes, outlier_analysis.stress),
    "volatility_regimes": _of(_closes, outlier_analysis.volatility_regimes), "simulation_mask": _of(_closes, outlier_analysis.simulation_mask),
    "volatility_adjusted_weights": _of(predictions, adaptive_weights.volatility_adjusted), "rolling_weights": _of(predictions, adaptive_weights.rolling_weights), "smoothed_weights": _of(predictions, adaptive_weights.smoothed_weights),
    "tail_weights": _of(predictions, adaptive_weights.tail_weights), "bootstrap_intervals": _of(predictions, adaptive_weights.bootstrap_interval),
    "volatility_spillover": _of(bars_weekly, cross_regimes.spillover), "correlation_changes": _of(bars_weekly, cross_regimes.correlation_changes), "quality_scores": _of(bars_weekly, cross_regimes.quality),
    "adaptive_correlation_weights": _of(bars_weekly, lambda df: cross_regimes.adaptive_weights(df, "1-URGENT")), "trend_forecast": _of(bars_weekly, cross_regimes.trend_forecast),
    "kendall_correlations": _of(bars_weekly, cross_regimes.kendall), "ledoit_wolf_covariance": _of(bars_weekly, cross_regimes.ledoit_wolf),
    "isolation_scores": _of(_metrics, lambda df: detectors.isolation_forest(df, "event_id", ["metric_value", "model_id"])), "local_outlier_factors": _of(_metrics, detectors.local_outliers), "stationarity": _of(bars_weekly, detectors.stationarity),
}
_P = "(PARTITION BY symbol ORDER BY bar_ts)"
_W = "(PARTITION BY symbol ORDER BY bar_ts ROWS"
_RET = f"{_Y}, r AS (SELECT symbol, bar_ts, y, y / nullif(lag(y) OVER {_P}, 0) - 1 AS ret FROM y)"
_B = f"WITH {BARS_SQL}, r AS (SELECT symbol, bar_ts, close, close / nullif(lag(close) OVER {_P}, 0) - 1 AS ret FROM bars)"
_L = f"WITH {PREDICTIONS_SQL}, l AS (SELECT model_id, period_id, error, actual, row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY model_id) AS n FROM predictions)"
_PAIRS = f"{_B}, p AS (SELECT x.symbol AS a, y.symbol AS b, x.bar_ts, x.ret AS x, y.ret AS y FROM r x JOIN r y ON x.bar_ts = y.bar_ts AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL)"


def _rolled(by: str, x: str = "x", y: str = "y") -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY bar_ts ROWS 19 PRECEDING)"
    return f"CASE WHEN count({x}) {w} = 20 THEN covar_samp({x}, {y}) {w} / nullif(stddev_samp({x}) {w} * stddev_samp({y}) {w}, 0) END"


ORACLE_SQL = {
    "outlier_patterns": f"""{_MASK}, k2 AS (SELECT z.symbol, z.keep, y.y, row_number() OVER (PARTITION BY z.symbol ORDER BY z.bar_ts) - 1 AS i, count(*) OVER (PARTITION BY z.symbol) AS n FROM z JOIN y ON y.symbol = z.symbol AND y.bar_ts = z.bar_ts) SELECT symbol, count_if(keep = 0)::BIGINT AS outliers, round(100 * avg((keep = 0)::INT), 6) AS percent, round(avg(y) FILTER (keep = 0), 6) AS mean, round(stddev_pop(y) FILTER (keep = 0), 6) AS deviation,
 round(min(y) FILTER (keep = 0), 6) AS least, round(max(y) FILTER (keep = 0), 6) AS most, count_if(keep = 0 AND i < 0.1 * n)::BIGINT AS first_tenth, count_if(keep = 0 AND i >= 0.1 * n AND i < 0.9 * n)::BIGINT AS middle, count_if(keep = 0 AND i >= 0.9 * n)::BIGINT AS last_tenth FROM k2 GROUP BY 1""",
    "local_patterns": f"""{_Y}, k AS (SELECT *, row_number() OVER {_P} - 1 AS k, CASE WHEN count(y) OVER {_W} 4 PRECEDING) = 5 THEN abs(y - avg(y) OVER {_W} 4 PRECEDING)) > 3 * stddev_samp(y) OVER {_W} 4 PRECEDING) END AS spike FROM y), c AS (SELECT symbol, k // 20 AS b, stddev_pop(y) / avg(y) AS cv FROM k GROUP BY 1, 2 HAVING count(*) = 20),
s AS (SELECT symbol, j, regr_slope(y, k) AS slope FROM k JOIN range(1000) t(j) ON k >= 10 * j AND k < 10 * j + 20 GROUP BY 1, 2 HAVING count(*) = 20), t AS (SELECT symbol, sign(slope) <> lag(sign(slope)) OVER (PARTITION BY symbol ORDER BY j) AS turn FROM s)
 SELECT c.symbol, count(*) AS blocks, round(avg(cv), 6) AS mean_cv, (SELECT count_if(turn) FROM t WHERE t.symbol = c.symbol)::BIGINT AS trend_changes, (SELECT count_if(spike) FROM k WHERE k.symbol = c.symbol)::BIGINT AS spikes FROM c GROUP BY 1""",
    "stress_periods": f"""{_RET}, f AS (SELECT *, row_number() OVER {_P} AS k, coalesce(abs(ret) > 3 * stddev_pop(ret) OVER (PARTITION BY symbol), false) AS large, coalesce(abs(ret) > 2 * stddev_pop(ret) OVER (PARTITION BY symbol), false) AS wild FROM r),
u AS (SELECT a.symbol, a.k FROM f a JOIN f b ON b.symbol = a.symbol AND b.k BETWEEN a.k - 2 AND a.k + 2 AND b.wild WHERE a.wild GROUP BY 1, 2 HAVING bool_or(b.k = a.k + 1) AND bool_or(b.k = a.k + 2) OR bool_or(b.k = a.k - 1) AND bool_or(b.k = a.k + 1) OR bool_or(b.k = a.k - 1) AND bool_or(b.k = a.k - 2))
 SELECT symbol, bar_ts, (EXISTS (SELECT 1 FROM f g WHERE g.symbol = f.symbol AND g.large AND g.k BETWEEN f.k - 6 AND f.k + 3) OR EXISTS (SELECT 1 FROM u WHERE u.symbol = f.symbol AND u.k BETWEEN f.k - 3 AND f.k + 2))::INT AS stress FROM f""",
    "volatility_regimes": f"""{_RET}, v AS (SELECT symbol, bar_ts, CASE WHEN count(ret) OVER {_W} 19 PRECEDING) = 20 THEN stddev_samp(ret) OVER {_W} 19 PRECEDING) END AS vol FROM r), q AS (SELECT symbol, quantile_cont(vol, [0.25, 0.5, 0.75, 0.9, 0.7]) AS q FROM v GROUP BY 1), h AS (SELECT v.symbol, vol, q, vol > q[5] AS high, lag(vol > q[5]) OVER (PARTITION BY v.symbol ORDER BY bar_ts) AS old FROM v JOIN q USING (symbol) WHERE vol IS NOT NULL)
 SELECT symbol, count_if(vol > q[1])::BIGINT AS above_25, count_if(vol > q[2])::BIGINT AS above_50, count_if(vol > q[3])::BIGINT AS above_75, count_if(vol > q[4])::BIGINT AS above_90, count_if(high <> old)::BIGINT AS transitions FROM h GROUP BY 1""",
    "simulation_mask": f"{_Y}, s AS (SELECT symbol, avg(y) AS m, stddev_pop(y) AS sd, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM y GROUP BY 1) SELECT symbol, bar_ts, (abs(y - m) < 3 * sd AND y BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))::INT AS keep FROM y JOIN s USING (symbol)",
    "volatility_adjusted_weights": f"{_L}, o AS (SELECT model_id, 1 / avg(error) / (stddev_pop(error) + 1e-8) AS w FROM l GROUP BY 1) SELECT model_id, round(w / sum(w) OVER (), 6) AS weight FROM o",
    "rolling_weights": f"{_L}, f AS (SELECT model_id, period_id, avg(error) AS mae FROM l GROUP BY 1, 2), i AS (SELECT *, 1 / avg(mae) OVER (PARTITION BY model_id ORDER BY period_id ROWS 9 PRECEDING) AS w FROM f) SELECT model_id, period_id, round(mae, 6) AS mae, round(w / sum(w) OVER (PARTITION BY period_id), 6) AS weight FROM i",
    "smoothed_weights": f"""{_L}, o AS (SELECT model_id, 1 / sqrt(avg(error * error)) AS a, 1 / sqrt(avg(error * error) FILTER (back <= 100)) AS b FROM l GROUP BY 1), s AS (SELECT model_id, a / sum(a) OVER () AS old, b / sum(b) OVER () AS new FROM o) SELECT model_id, round(old, 6) AS old, round(new, 6) AS new, round((0.95 * old + 0.05 * new) / sum(0.95 * old + 0.05 * new) OVER (), 6) AS weight FROM s""",
    "tail_weights": f"{_L}, o AS (SELECT model_id, count(*) AS tail, exp(1 - avg(abs(error / actual))) AS w FROM l WHERE back <= ceil(0.2 * n) AND actual <> 0 GROUP BY 1) SELECT model_id, tail, round(w / sum(w) OVER (), 6) AS weight FROM o",
    "volatility_spillover": f"""{_B}, v AS (SELECT symbol, bar_ts, CASE WHEN count(ret) OVER {_W} 19 PRECEDING) = 20 THEN stddev_samp(ret) OVER {_W} 19 PRECEDING) END AS vol FROM r), w AS (SELECT * FROM v WHERE vol IS NOT NULL), o AS (SELECT a.symbol, a.bar_ts, any_value(a.vol) AS vol, avg(b.vol) AS mean_other, max(b.vol) AS most_other FROM w a LEFT JOIN w b ON b.bar_ts = a.bar_ts AND b.symbol <> a.symbol GROUP BY 1, 2)
 SELECT symbol, bar_ts, round(mean_other, 6) AS mean_other, round(most_other, 6) AS most_other, round({_rolled('symbol', 'mean_other', 'vol')}, 6) AS spillover FROM o""",
    "correlation_changes": f"{_PAIRS}, c AS (SELECT a, b, bar_ts, {_rolled('a, b')} AS corr FROM p), d AS (SELECT *, corr - lag(corr, 10) OVER (PARTITION BY a, b ORDER BY bar_ts) AS change FROM c) SELECT a, b, bar_ts, round(corr, 6) AS corr, round(change, 6) AS change FROM d WHERE abs(change) > 0.3",
    "quality_scores": f"""{_B}, l AS (SELECT symbol, ret, close / max(close) OVER {_W} UNBOUNDED PRECEDING) - 1 AS dd FROM r), m AS (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu, stddev_pop(ret) OVER (PARTITION BY symbol) AS sd FROM l), o AS (SELECT symbol, 1 / (1 + stddev_samp(ret)) AS stability, min(dd) AS dd, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS positive, avg(pow((ret - mu) / sd, 3)) AS skew FROM m GROUP BY 1)
 SELECT symbol, round(stability, 6) AS stability, round(dd, 6) AS max_drawdown, round(positive, 6) AS positive, round(skew, 6) AS skew, round(0.3 * stability + 0.3 * (1 + dd) + 0.2 * positive + 0.2 * (0.5 + greatest(-0.5, least(0.5, skew / 4))), 6) AS score FROM o""",
    "adaptive_correlation_weights": f"""{_PAIRS}, t AS (SELECT CASE WHEN a = '1-URGENT' THEN b ELSE a END AS symbol, bar_ts, x, y FROM p WHERE '1-URGENT' IN (a, b)), c AS (SELECT *, {_rolled('symbol')} AS c FROM t), o AS (SELECT symbol, corr(x, y) AS correlation, greatest(0, 1 - coalesce(stddev_pop(c), 0)) AS stability FROM c GROUP BY 1), w AS (SELECT *, abs(correlation) * (0.7 + 0.3 * stability) AS w FROM o)
 SELECT symbol, round(correlation, 6) AS correlation, round(stability, 6) AS stability, round(0.7 / count(*) OVER () + 0.3 * w / sum(w) OVER (), 6) AS weight FROM w""",
    "trend_forecast": f"""{_B}, f AS (SELECT symbol, bar_ts, close, row_number() OVER {_P} AS n, CASE WHEN count(*) OVER {_W} 19 PRECEDING) = 20 THEN avg(close) OVER {_W} 4 PRECEDING) / avg(close) OVER {_W} 19 PRECEDING) - 1 END AS drift FROM r) SELECT symbol, bar_ts, s::INT AS step, round(close * pow(1 + drift / 7, s), 6) AS forecast FROM f, range(1, 8) t(s) WHERE n % 7 = 0 AND drift IS NOT NULL""",
    "kendall_correlations": f"""{_PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY bar_ts) AS k FROM p) SELECT u.a, u.b, round(sum(sign(u.x - v.x) * sign(u.y - v.y)) / sqrt(count_if(u.x <> v.x) * count_if(u.y <> v.y)), 6) AS tau FROM n u JOIN n v ON u.a = v.a AND u.b = v.b AND u.k > v.k GROUP BY 1, 2""",
    "ledoit_wolf_covariance": f"""{_B}, w AS (SELECT bar_ts FROM r WHERE ret IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM r WHERE ret IS NOT NULL)), x AS (SELECT symbol, bar_ts, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM r JOIN w USING (bar_ts)), c AS (SELECT u.symbol AS a, v.symbol AS b, avg(u.x * v.x) AS s FROM x u JOIN x v USING (bar_ts) GROUP BY 1, 2),
m AS (SELECT sum(s) FILTER (a = b) / count_if(a = b) AS mu, sum(s * s) AS nn, count_if(a = b) AS p FROM c), q AS (SELECT avg(q * q) AS fourth, count(*) AS n FROM (SELECT sum(x * x) AS q FROM x GROUP BY bar_ts)), h AS (SELECT mu, least(1, greatest(0, (fourth - nn) / n / (nn - p * mu * mu))) AS rho FROM m, q)
 SELECT a, b, round((1 - rho) * s + CASE WHEN a = b THEN rho * mu ELSE 0 END, 6) AS cov, round(rho, 6) AS shrinkage FROM c, h""",
}
