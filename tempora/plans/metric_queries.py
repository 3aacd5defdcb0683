"""Queries of backtests and metrics, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import metrics
from tempora.sources.bars import BARS_SQL, PREDICTIONS_SQL, bars_weekly, predictions


def _of(f: Callable[[DataFrame], DataFrame], digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(predictions(spark, sf_dir))
        return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})

    return run


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.walk_forward(bars_weekly(spark, sf_dir))
    return df.withColumns({c: F.round(c, 6) for c in ("prediction", "actual")})


_T = "OVER (PARTITION BY model_id ORDER BY ts, event_id"
_D = f"""WITH {PREDICTIONS_SQL},
d0 AS (SELECT *, prediction - lag(prediction) {_T}) AS dp, actual - lag(actual) {_T}) AS da, actual / 1000 - 0.05 AS ret, prediction - actual AS e FROM predictions),
d AS (SELECT *, CASE WHEN dp IS NOT NULL AND da IS NOT NULL THEN CASE WHEN sign(dp) = sign(da) THEN 1.0 ELSE 0.0 END END AS same FROM d0)"""
_R = "round({}, 6) AS {}"
_WITHIN = ", ".join(f"round(avg(CASE WHEN abs(e) <= {k / 100} * abs(actual) THEN 1.0 ELSE 0.0 END), 6) AS within_{k}" for k in (10, 20, 30))
_L = f"""{_D}, l AS (SELECT *, exp(sum(ln(1 + ret)) {_T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS level, lag(ret < 0) {_T}) AS before FROM d),
dd AS (SELECT *, level / greatest(max(level) {_T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) - 1 AS drawdown, sum(CASE WHEN (ret < 0) = before THEN 0 ELSE 1 END) {_T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM l)"""
QUERIES = {
    "model_metrics": _of(metrics.by_model), "fold_metrics": _of(metrics.by_fold), "fold_summary": _of(metrics.fold_summary), "rolling_errors": _of(metrics.rolling_errors), "risk_metrics": _of(metrics.risk),
    "error_statistics": _of(metrics.statistics, 5), "paired_model_test": _of(metrics.paired_test), "walk_forward": walk_forward,
}
_FOLDS = "f AS (SELECT model_id, period_id, count(*) AS n, avg(error) AS mae, sqrt(avg(squared_error)) AS rmse, avg(e) AS bias, avg(same) AS direction FROM d GROUP BY 1, 2)"
ORACLE_SQL = {
    "model_metrics": f"""{_D} SELECT model_id, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(CASE WHEN actual <> 0 THEN abs(e / actual) * 100 END), 6) AS mape, round(1 - sum(e * e) / nullif(var_pop(actual) * count(*), 0), 6) AS r2,
 round(covar_pop(prediction, actual) / nullif(stddev_pop(prediction) * stddev_pop(actual), 0), 6) AS rho, round(max(abs(e)), 6) AS max_error, round(avg(e), 6) AS bias, round(quantile_cont(abs(e), 0.5), 6) AS median_error, {_WITHIN}, round(avg(same), 6) AS direction FROM d GROUP BY model_id""",
    "fold_metrics": f"{_D}, {_FOLDS} SELECT model_id, period_id, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(direction, 6) AS direction FROM f",
    "fold_summary": f"{_D}, {_FOLDS} SELECT model_id, count(*) AS folds, round(avg(rmse), 6) AS mean_rmse, round(quantile_cont(rmse, 0.5), 6) AS median_rmse, round(stddev_pop(rmse), 6) AS sd_rmse, round(min(rmse), 6) AS best, round(max(rmse), 6) AS worst, round(regr_slope(rmse, period_id), 6) AS trend, round(regr_r2(rmse, period_id), 6) AS trend_r2 FROM f GROUP BY model_id",
    "rolling_errors": f"""{_D} SELECT model_id, event_id, CASE WHEN k >= 50 THEN round(mae, 6) END AS mae, CASE WHEN k >= 50 THEN round(rmse, 6) END AS rmse, CASE WHEN k >= 50 THEN round(direction, 6) END AS direction FROM (SELECT model_id, event_id, row_number() {_T}) AS k, avg(error) {_T} ROWS 49 PRECEDING) AS mae, sqrt(avg(squared_error) {_T} ROWS 49 PRECEDING)) AS rmse, avg(same) {_T} ROWS 49 PRECEDING) AS direction FROM d)""",
    "risk_metrics": f"""{_L}, q AS (SELECT model_id, quantile_cont(ret, 0.05) AS var95, quantile_cont(ret, 0.01) AS var99 FROM dd GROUP BY 1), s AS (SELECT model_id, max(c) AS losing_streak FROM (SELECT model_id, island, count(*) AS c FROM dd WHERE ret < 0 GROUP BY 1, 2) GROUP BY 1),
 a AS (SELECT model_id, avg(ret) AS m, stddev_pop(ret) AS sd, sqrt(avg(pow(least(ret, 0), 2))) AS down, min(drawdown) AS mdd, sum(greatest(ret, 0)) / nullif(-sum(least(ret, 0)), 0) AS pf, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS wr, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 2)) AS m2, avg(pow(ret - mu, 4)) AS m4, avg(CASE WHEN ret <= var95 THEN ret END) AS es95, sqrt(avg(drawdown * drawdown)) AS ulcer, avg(-drawdown) AS pain, max(var95) AS var95, max(var99) AS var99 FROM (SELECT *, avg(ret) OVER (PARTITION BY model_id) AS mu FROM dd JOIN q USING (model_id)) GROUP BY model_id)
 SELECT model_id, round(m, 6) AS mean, round(sd, 6) AS sd, round(m / nullif(sd, 0) * sqrt(252), 6) AS sharpe, round(m / nullif(down, 0) * sqrt(252), 6) AS sortino, round(mdd, 6) AS max_drawdown, round(m * 252 / nullif(-mdd, 0), 6) AS calmar, round(pf, 6) AS profit_factor, round(wr, 6) AS win_rate, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurt, round(var95, 6) AS var95, round(var99, 6) AS var99, round(es95, 6) AS es95, round(ulcer, 6) AS ulcer, round(pain, 6) AS pain, losing_streak FROM a LEFT JOIN s USING (model_id)""",
    "error_statistics": f"""{_D}, c AS (SELECT *, e - avg(e) OVER (PARTITION BY model_id) AS x FROM d), g AS (SELECT *, {', '.join(f'lag(x, {k}) {_T}) AS x{k}' for k in range(1, 6))}, lag(sign(x)) {_T}) AS s1 FROM c),
 a AS (SELECT model_id, count(*) AS n, avg(pow(x, 3)) / pow(avg(x * x), 1.5) AS s, avg(pow(x, 4)) / pow(avg(x * x), 2) - 3 AS k, avg(e) / nullif(stddev_samp(e) / sqrt(count(*)), 0) AS t, 1 + count_if(sign(x) <> s1) AS runs, {', '.join(f'sum(x * x{k}) / nullif(sum(x * x), 0) AS r{k}' for k in range(1, 6))} FROM g GROUP BY 1)
 SELECT model_id, n, round(n / 6 * (s * s + k * k / 4), 5) AS jarque_bera, round(exp(-(n / 6 * (s * s + k * k / 4)) / 2), 5) AS jb_p, round(t, 5) AS t, round(n * (n + 2) * ({' + '.join(f'r{k} * r{k} / (n - {k})' for k in range(1, 6))}), 5) AS ljung_box, runs::BIGINT AS runs, round(r1, 5) AS r1, round(r5, 5) AS r5 FROM a""",
    "paired_model_test": f"""{_D}, r AS (SELECT model_id, squared_error AS v, row_number() {_T}) AS k FROM d) SELECT x.model_id AS a, y.model_id AS b, count(*) AS n, round(avg(x.v - y.v) / nullif(stddev_samp(x.v - y.v) / sqrt(count(*)), 0), 6) AS t, round(avg(x.v - y.v) / nullif(stddev_samp(x.v - y.v), 0), 6) AS cohen_d FROM r x JOIN r y ON x.k = y.k AND x.model_id < y.model_id GROUP BY 1, 2""",
    "walk_forward": f"""WITH {BARS_SQL}, a AS (SELECT symbol, bar_ts, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY bar_ts), 0) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS k FROM bars), b AS (SELECT *, lag(ret) OVER (PARTITION BY symbol ORDER BY bar_ts) AS x FROM a),
 p AS (SELECT unnest(range(0, ((SELECT max(k) + 1 FROM a) - 82) // 20 + 1)) AS period), m AS (SELECT symbol, period, regr_slope(ret, x) AS s, regr_intercept(ret, x) AS i, count(*) AS train_rows FROM b JOIN p ON k >= period * 20 AND k < period * 20 + 60 WHERE x IS NOT NULL AND ret IS NOT NULL GROUP BY 1, 2)
 SELECT b.symbol, m.period::INT AS period, bar_ts, train_rows, round(i + s * x, 6) AS prediction, round(ret, 6) AS actual FROM m JOIN b ON b.symbol = m.symbol AND k >= period * 20 + 62 AND k < period * 20 + 82 WHERE x IS NOT NULL AND ret IS NOT NULL""",
}
