"""Queries of monitoring, streaming and outliers, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import monitoring, outliers
from tempora.sources.bars import BARS_SQL, bars_weekly, read
from tempora.streaming import monitor


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("metric_name"), (F.col("user_id") % 4).alias("model_id"), F.col("value").alias("metric_value"))


def _rules(spark: SparkSession) -> DataFrame:
    rows = [("high_buy", "purchase", ">", 100.0, 60, 1), ("busy_view", "view", ">=", 30.0, 240, 2), ("low_click", "click", "<", 5.0, 60, 1), ("odd", "signup", "!=", 1.0, 240, 3), ("busy_click", "click", ">", 40.0, 240, 2)]
    return spark.createDataFrame(rows, "rule_id string, metric_name string, operator string, threshold double, minutes int, min_occurrences int")


def metric_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.anomalies(_metrics(spark, sf_dir))


def metric_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.degradation(_metrics(spark, sf_dir)).withColumn("change", F.round(F.col("change") * 1e6) / 1e6)  # of the double, as SQL rounds


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.rule_violations(_metrics(spark, sf_dir), _rules(spark))


def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    fired = monitoring.rule_violations(m, _rules(spark)).where("fires = 1").join(m.select("event_id", "model_id"), "event_id")
    return monitoring.alert_summary(fired).withColumn("level", F.col("level").cast("int"))


def data_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(monitoring.drift(_metrics(spark, sf_dir), F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")))


def ensemble_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(monitoring.ensemble_state(_metrics(spark, sf_dir)))


def model_switching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(monitoring.switch_advice(_metrics(spark, sf_dir), 20.0))


def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed metrics of a replayed event stream, complete."""
    stream = monitor.windowed_metrics(monitor.event_stream(spark, f"{sf_dir}/events.parquet*"))
    out = monitor.run_to_end(stream, f"windows_{uuid.uuid4().hex}", "complete")
    return _round(out.withColumn("start", F.col("start").cast("timestamp_ntz")))


def streaming_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold alerts with a cooldown over a replayed event stream."""
    stream = monitor.threshold_alerts(monitor.event_stream(spark, f"{sf_dir}/events.parquet*"), 100.0)
    return monitor.run_to_end(stream, f"alerts_{uuid.uuid4().hex}").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_weekly(spark, sf_dir).select("symbol", "bar_ts", F.col("close").alias("y"))


def outlier_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.global_masks(_closes(spark, sf_dir)).drop("y")


def temporal_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.temporal_masks(_closes(spark, sf_dir))


def outlier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(outliers.runs(_closes(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (metric_anomalies, metric_degradation, alert_rules, alert_counts, data_drift, ensemble_state, model_switching, streaming_windows, streaming_alerts, outlier_masks, temporal_outliers, outlier_runs)}
_M = "WITH RECURSIVE m AS (SELECT event_id, ts, event_type AS metric_name, user_id % 4 AS model_id, value AS metric_value FROM events)"
_S = "PARTITION BY metric_name, model_id ORDER BY ts, event_id"
_PAST = f"OVER ({_S} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"
_FIRES = f"""{_M}, r(rule_id, metric_name, op, threshold, minutes, least_n) AS (VALUES ('high_buy', 'purchase', '>', 100.0, 60, 1), ('busy_view', 'view', '>=', 30.0, 240, 2), ('low_click', 'click', '<', 5.0, 60, 1), ('odd', 'signup', '!=', 1.0, 240, 3), ('busy_click', 'click', '>', 40.0, 240, 2)),
j AS (SELECT *, CASE WHEN (op = '>' AND metric_value > threshold) OR (op = '>=' AND metric_value >= threshold) OR (op = '<' AND metric_value < threshold) OR (op = '!=' AND abs(metric_value - threshold) >= 1e-6) THEN 1 ELSE 0 END AS violated FROM m JOIN r USING (metric_name)),
f AS (SELECT rule_id, event_id, model_id, violated, least_n, CASE minutes WHEN 60 THEN sum(violated) OVER (PARTITION BY rule_id, model_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) ELSE sum(violated) OVER (PARTITION BY rule_id, model_id ORDER BY ts RANGE BETWEEN INTERVAL 240 MINUTE PRECEDING AND CURRENT ROW) END AS recent FROM j)"""
_Y = f"WITH {BARS_SQL}, y AS (SELECT symbol, bar_ts, close AS y FROM bars)"
_P = "PARTITION BY symbol ORDER BY bar_ts"
_MASK = f"""{_Y}, s AS (SELECT symbol, avg(y) AS m, stddev_pop(y) AS sd, quantile_cont(y, 0.15) AS a, quantile_cont(y, 0.5) AS md, quantile_cont(y, 0.85) AS b, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM y GROUP BY 1), d AS (SELECT symbol, quantile_cont(abs(y - md), 0.5) AS mad FROM y JOIN s USING (symbol) GROUP BY 1),
k AS (SELECT symbol, bar_ts, (abs((y - m) / nullif(sd, 0)) < 1.5)::INT AS z_keep, (abs(0.6745 * (y - md) / nullif(mad, 0)) < 2.25)::INT AS mad_keep, (y BETWEEN a - 0.75 * (b - a) AND b + 0.75 * (b - a))::INT AS iqr_keep, (y BETWEEN lo AND hi)::INT AS pct_keep FROM y JOIN s USING (symbol) JOIN d USING (symbol)), z AS (SELECT *, least(z_keep, mad_keep, iqr_keep, pct_keep) AS keep FROM k)"""
ORACLE_SQL = {
    "metric_anomalies": f"""{_M}, b AS (SELECT *, count(metric_value) {_PAST} AS seen, avg(metric_value) {_PAST} AS mean, stddev_pop(metric_value) {_PAST} AS sd, quantile_cont(metric_value, 0.25) {_PAST} AS q1, quantile_cont(metric_value, 0.5) {_PAST} AS q2, quantile_cont(metric_value, 0.75) {_PAST} AS q3, list(metric_value) {_PAST} AS xs FROM m), c AS (SELECT *, list_median(list_transform(xs, lambda v: abs(v - q2))) AS mad FROM b)
 SELECT event_id, CASE WHEN seen >= 10 THEN (abs((metric_value - mean) / nullif(sd, 0)) > 3)::INT END AS z_anomaly, CASE WHEN seen >= 10 THEN (metric_value < q1 - 1.5 * (q3 - q1) OR metric_value > q3 + 1.5 * (q3 - q1))::INT END AS iqr_anomaly, CASE WHEN seen >= 10 THEN (abs(0.6745 * ((metric_value - q2) / nullif(mad, 0))) > 3.5)::INT END AS mad_anomaly FROM c""",
    "metric_degradation": f"""{_M}, c AS (SELECT event_id, CASE WHEN count(*) OVER ({_S} ROWS 99 PRECEDING) >= 50 THEN avg(metric_value) OVER ({_S} ROWS 19 PRECEDING) / nullif(avg(metric_value) OVER ({_S} ROWS 99 PRECEDING), 0) - 1 END AS change FROM m) SELECT event_id, round(change, 6) AS change, CASE WHEN abs(change) > 0.4 THEN 'critical' WHEN abs(change) > 0.2 THEN 'warning' WHEN change IS NOT NULL THEN 'none' END AS severity FROM c""",
    "alert_rules": f"{_FIRES} SELECT rule_id, event_id, violated, recent::BIGINT AS recent, CASE WHEN violated = 1 AND recent >= least_n THEN 1 ELSE 0 END AS fires FROM f",
    "alert_counts": f"{_FIRES} SELECT rule_id, model_id, count(*) AS alerts, grouping(rule_id, model_id)::INT AS level FROM f WHERE violated = 1 AND recent >= least_n GROUP BY CUBE (rule_id, model_id)",
    "data_drift": f"""{_M}, s AS (SELECT metric_name, avg(metric_value) FILTER (ts < TIMESTAMP '2024-01-16') AS m0, stddev_samp(metric_value) FILTER (ts < TIMESTAMP '2024-01-16') AS s0, avg(metric_value) FILTER (ts >= TIMESTAMP '2024-01-16') AS m1, var_samp(metric_value) FILTER (ts >= TIMESTAMP '2024-01-16') AS v1, var_samp(metric_value) FILTER (ts < TIMESTAMP '2024-01-16') AS v0 FROM m GROUP BY 1)
 SELECT metric_name, round(m1 - m0, 6) AS shift, round(v1 / nullif(v0, 0), 6) AS variance_ratio, concat_ws(';', CASE WHEN abs(m1 - m0) > 0.1 * s0 THEN 'mean_shift' END, CASE WHEN abs(v1 / nullif(v0, 0) - 1) > 0.1 THEN 'variance_change' END) AS issues FROM s""",
    "ensemble_state": f"{_M}, l AS (SELECT metric_name, model_id, arg_max(metric_value, {{'a': ts, 'b': event_id}}) AS v FROM m GROUP BY 1, 2) SELECT metric_name, count(*) AS models, round(var_pop(v), 6) AS variance, arg_min(model_id, {{'a': v, 'b': model_id}}) AS best, arg_max(model_id, {{'a': v, 'b': model_id}}) AS worst, round(max(v) - min(v), 6) AS spread FROM l GROUP BY 1",
    "model_switching": f"""{_M}, k AS (SELECT *, row_number() OVER (PARTITION BY metric_name, model_id ORDER BY ts DESC, event_id DESC) AS k FROM m), a AS (SELECT metric_name, model_id, avg(metric_value) AS mean FROM k WHERE k <= 100 GROUP BY 1, 2 HAVING count(*) >= 5),
 b AS (SELECT a.metric_name, a.model_id, a.mean, arg_min(o.model_id, {{'a': o.mean, 'b': o.model_id}}) AS s, min(o.mean) AS bm FROM a JOIN a o ON o.metric_name = a.metric_name AND o.model_id <> a.model_id GROUP BY 1, 2, 3) SELECT metric_name, model_id, round(mean, 6) AS mean, CASE WHEN mean > 20 AND bm < mean THEN s END AS switch_to FROM b""",
    "streaming_windows": f"{_M} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, metric_name, count(*) AS n, round(avg(metric_value), 6) AS mean, round(stddev_samp(metric_value), 6) AS sd, round(min(metric_value), 6) AS least, round(max(metric_value), 6) AS most FROM m GROUP BY 1, 2",
    "streaming_alerts": f"""{_M}, v AS (SELECT *, row_number() OVER ({_S}) AS k FROM m WHERE metric_value > 100), w AS (SELECT metric_name, model_id, k, event_id, ts, metric_value, ts AS last, 1 AS fires FROM v WHERE k = 1 UNION ALL SELECT v.metric_name, v.model_id, v.k, v.event_id, v.ts, v.metric_value, CASE WHEN v.ts - w.last >= INTERVAL 30 MINUTE THEN v.ts ELSE w.last END, CASE WHEN v.ts - w.last >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END FROM w JOIN v ON v.metric_name = w.metric_name AND v.model_id = w.model_id AND v.k = w.k + 1)
 SELECT metric_name, model_id, event_id, ts, metric_value FROM w WHERE fires = 1""",
    "outlier_masks": f"{_MASK} SELECT * FROM z",
    "temporal_outliers": f"""{_Y}, b AS (SELECT *, row_number() OVER ({_P}) AS n, quantile_cont(y, 0.5) OVER ({_P} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS med, list(y) OVER ({_P} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS ys, (lag(y) OVER ({_P}) + lag(y, 2) OVER ({_P})) / 2 AS l, (lead(y) OVER ({_P}) + lead(y, 2) OVER ({_P})) / 2 AS r, stddev_pop(y) OVER (PARTITION BY symbol) AS sd, y / nullif(lag(y) OVER ({_P}), 0) - 1 AS ret FROM y),
 c AS (SELECT *, list_median(list_transform(ys, lambda v: abs(v - med))) AS mad, CASE WHEN count(y) OVER ({_P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 THEN regr_intercept(y, n) OVER ({_P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) + regr_slope(y, n) OVER ({_P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) * n END AS ex, CASE WHEN count(ret) OVER ({_P} ROWS 9 PRECEDING) = 10 THEN stddev_samp(ret) OVER ({_P} ROWS 9 PRECEDING) END AS vol FROM b),
 d AS (SELECT *, coalesce((vol > quantile_cont(vol, 0.7) OVER (PARTITION BY symbol))::INT, 0) AS wild FROM c)
 SELECT symbol, bar_ts, (abs(y - med) <= 2 * mad)::INT AS local_keep, coalesce((NOT (abs(y - l) > sd AND abs(y - r) > sd))::INT, 1) AS spike_keep, coalesce((abs(y - ex) <= 2 * sd)::INT, 1) AS trend_keep, 1 - max(wild) OVER ({_P} ROWS BETWEEN 14 PRECEDING AND 5 FOLLOWING) AS regime_keep FROM d""",
    "outlier_runs": f"""{_MASK}, i AS (SELECT symbol, bar_ts, 1 - keep AS gone, row_number() OVER ({_P}) - row_number() OVER (PARTITION BY symbol, keep ORDER BY bar_ts) AS g FROM z), l AS (SELECT symbol, g, count(*) AS c FROM i WHERE gone = 1 GROUP BY 1, 2) SELECT symbol, count(*) AS runs, max(c) AS longest, round(avg(c), 6) AS mean FROM l GROUP BY 1""",
}
