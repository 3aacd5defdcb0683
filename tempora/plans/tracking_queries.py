"""Queries of tracking: histories, snapshots, confidence, health, cooldowns, switches, queues, retention; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import monitoring, tracking
from tempora.plans.asset_queries import _CAL, _calibration
from tempora.plans.monitor_queries import _M, _S, _metrics
from tempora.sources.bars import PREDICTIONS_SQL, predictions, read


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def _of(operator):
    return lambda spark, sf_dir: _round(operator(_metrics(spark, sf_dir)))


def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.bounded_history(_metrics(spark, sf_dir), 50).select("metric_name", "model_id", "event_id")


def system_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select("ts", F.col("value").alias("latency"))
    return _round(tracking.health(log, F.col("latency") > 100))


def historical_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(tracking.historical_confidence(predictions(spark, sf_dir)))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _calibration(spark, sf_dir).join(read(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    warnings = F.array_compact(F.array(F.when(F.col("error") > 0.3, "error"), F.when(F.col("uncertainty") > 0.5, "uncertain")))
    return c.select("event_id", "ts", (1 - F.col("uncertainty") - F.col("error")).alias("confidence"), (F.col("uncertainty") + F.col("error")).alias("risk"), "agreement", (1 - F.col("error")).alias("quality"), warnings.alias("warnings"))


def confidence_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.confidence_alerts(_assessed(spark, sf_dir)).drop("ts")


def alerts_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.alerts_by_type(tracking.confidence_alerts(_assessed(spark, sf_dir)))


def anomaly_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies by quartile fences that fire, one an hour and series."""
    m = _metrics(spark, sf_dir)
    odd = monitoring.anomalies(m).where("iqr_anomaly = 1").select("event_id")
    return tracking.cooled(m.join(odd, "event_id"), 60 * 24).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def most_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(tracking.most_confident(_metrics(spark, sf_dir), F.col("model_id") == 0))


def model_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.switches(_metrics(spark, sf_dir), 40.0).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def switch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.switch_counts(tracking.switches(_metrics(spark, sf_dir), 40.0))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "waiting").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), F.pmod("o_custkey", F.lit(50)).alias("queue"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("o_orderdate").alias("created"), status.alias("status"), F.col("o_totalprice").alias("cost"))


def next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.next_jobs(_jobs(spark, sf_dir), "queue")


def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.queue_counts(_jobs(spark, sf_dir), "queue")


def admitted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose size and price fit what is available."""
    p = read(spark, sf_dir, "part")
    fits = tracking.admitted({"size": F.col("p_size"), "price": F.col("p_retailprice")}, {"size": F.lit(40), "price": F.lit(1500.0)})
    return p.select("p_partkey", fits.alias("fits"))


def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return tracking.kept_since(o, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), 60).select("o_orderkey")


def kept_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of customers that are recent, or among their five smallest totals."""
    return tracking.keep_best(_jobs(spark, sf_dir), "queue", "cost", "created", F.lit("1998-01-01").cast("timestamp_ntz"), 30, 5).select("job_id")


def config_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as configurations, with one parameter overlaid and one added."""
    s = read(spark, sf_dir, "supplier")
    params = F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("kind"), F.lit("base"))
    configs = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("config_id"), params.alias("params"), F.array(F.lit("a")).alias("tags"))
    updates = F.create_map(F.lit("kind"), F.lit("tuned"), F.lit("rate"), F.lit("0.1"))
    return tracking.variant(configs, updates, F.lit("1998-01-01").cast("timestamp_ntz"))


def config_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations, here parts, by type and container size."""
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("kind")).agg(F.count(F.lit(1)).alias("configs"), F.count_distinct("p_size").alias("sizes"))


QUERIES = {
    "recent_metrics": _of(tracking.recent), "metric_snapshots": _of(tracking.snapshots), "dashboard_summary": _of(tracking.dashboard), "metric_summary": _of(tracking.metric_summary),
    **{f.__name__: f for f in (bounded_history, system_health, historical_confidence, confidence_alerts, alerts_of_a_day, anomaly_alerts, most_confident, model_switches, switch_counts, next_jobs, queue_counts, admitted_parts, recent_orders, kept_records, config_variants, config_counts)},
}
_BACK = "OVER (PARTITION BY metric_name, model_id ORDER BY ts DESC, event_id DESC)"
_SNAP = f"{_M}, k AS (SELECT *, row_number() {_BACK} AS k FROM m), s AS (SELECT metric_name, model_id, count(*) AS n, avg(metric_value) AS mean, stddev_pop(metric_value) AS deviation, max(metric_value) FILTER (k = 1) AS newest FROM k WHERE k <= 100 GROUP BY 1, 2)"
_JOBS = "WITH j AS (SELECT o_orderkey AS job_id, o_custkey % 50 AS queue, 6 - substr(o_orderpriority, 1, 1)::INT AS priority, o_orderdate AS created, CASE o_orderstatus WHEN 'O' THEN 'waiting' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_totalprice AS cost FROM orders)"
_ALERTS = f"""{_CAL}, a AS (SELECT event_id, ts, 1 - uncertainty - error AS confidence, uncertainty + error AS risk, agreement, 1 - error AS quality, error, uncertainty FROM c JOIN events USING (event_id)),
t AS (SELECT event_id, ts, 'LOW_CONFIDENCE' AS type, 'WARNING' AS severity FROM a WHERE confidence < 0.3 UNION ALL SELECT event_id, ts, 'HIGH_RISK', 'CRITICAL' FROM a WHERE risk > 0.8 UNION ALL SELECT event_id, ts, 'MODEL_DISAGREEMENT', 'WARNING' FROM a WHERE agreement < 0.5 UNION ALL SELECT event_id, ts, 'DATA_QUALITY', 'WARNING' FROM a WHERE quality < 0.6
 UNION ALL SELECT event_id, ts, 'RISK_WARNING', 'INFO' FROM a WHERE error > 0.3 UNION ALL SELECT event_id, ts, 'RISK_WARNING', 'INFO' FROM a WHERE uncertainty > 0.5)"""
_A = "(PARTITION BY model_id ORDER BY ts, event_id ROWS BETWEEN"
_PAST = f"OVER ({_S} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"
ORACLE_SQL = {
    "recent_metrics": f"{_M} SELECT metric_name, model_id, count(*) AS n, round(avg(metric_value), 6) AS mean FROM m WHERE ts >= (SELECT max(ts) FROM m) - INTERVAL 24 HOUR GROUP BY 1, 2",
    "metric_snapshots": f"{_SNAP} SELECT metric_name, model_id, n, round(CASE WHEN n >= 5 THEN mean ELSE 'inf'::DOUBLE END, 6) AS mean, round(deviation, 6) AS deviation, round(newest, 6) AS newest FROM s",
    "dashboard_summary": f"""{_SNAP} SELECT metric_name, count(*) AS models, (SELECT model_id FROM s t WHERE t.metric_name = s.metric_name ORDER BY newest, model_id LIMIT 1) AS best, round(min(newest), 6) AS best_value, (SELECT model_id FROM s t WHERE t.metric_name = s.metric_name ORDER BY newest DESC, model_id LIMIT 1) AS worst, round(max(newest), 6) AS worst_value FROM s GROUP BY 1""",
    "metric_summary": f"{_M} SELECT metric_name, count(*) AS n, round(avg(metric_value), 6) AS mean, round(stddev_pop(metric_value), 6) AS deviation, round(min(metric_value), 6) AS least, round(max(metric_value), 6) AS most FROM m GROUP BY 1",
    "bounded_history": f"{_M} SELECT metric_name, model_id, event_id FROM m QUALIFY row_number() {_BACK} <= 50",
    "system_health": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS requests, round(count(*) / 1440, 6) AS per_minute, round(avg((value > 100)::INT), 6) AS error_rate, round(avg(value), 6) AS mean_latency, round((epoch_us(max(ts)) - (SELECT epoch_us(min(ts)) FROM events)) / 3600000000, 6) AS uptime_hours FROM events GROUP BY 1",
    "historical_confidence": f"""WITH {PREDICTIONS_SQL}, a AS (SELECT model_id, event_id, ts, greatest(0, 1 - abs(prediction - actual) / (abs(actual) + 1e-8)) AS a FROM predictions), w AS (SELECT *, count(*) OVER {_A} 19 PRECEDING AND CURRENT ROW) AS n, avg(a) OVER {_A} 49 PRECEDING AND CURRENT ROW) AS m, avg(a) OVER {_A} 9 PRECEDING AND CURRENT ROW) - avg(a) OVER {_A} 19 PRECEDING AND 10 PRECEDING) AS t, stddev_pop(a) OVER {_A} 19 PRECEDING AND CURRENT ROW) AS sd FROM a)
 SELECT model_id, event_id, round(a, 6) AS accuracy, round(CASE WHEN n < 10 THEN 0.7 ELSE least(1, greatest(0, m + CASE WHEN n = 20 THEN least(0.2, greatest(0, t)) + greatest(0, 0.2 - sd) ELSE 0.1 END)) END, 6) AS confidence FROM w""",
    "confidence_alerts": f"{_ALERTS} SELECT event_id, type, severity FROM t",
    "alerts_of_a_day": f"{_ALERTS} SELECT type, severity, count(*) AS alerts FROM t WHERE ts > (SELECT max(ts) FROM t) - INTERVAL 24 HOUR GROUP BY ROLLUP (type, severity)",
    "anomaly_alerts": f"""{_M}, q AS (SELECT *, count(*) {_PAST} AS seen, quantile_cont(metric_value, 0.25) {_PAST} AS a, quantile_cont(metric_value, 0.75) {_PAST} AS b FROM m), v AS (SELECT metric_name, model_id, event_id, ts, row_number() OVER ({_S}) AS k FROM q WHERE seen >= 10 AND (metric_value < a - 1.5 * (b - a) OR metric_value > b + 1.5 * (b - a))),
w AS (SELECT *, ts AS last, 1 AS fires FROM v WHERE k = 1 UNION ALL SELECT v.*, CASE WHEN v.ts - w.last >= INTERVAL 24 HOUR THEN v.ts ELSE w.last END, (v.ts - w.last >= INTERVAL 24 HOUR)::INT FROM w JOIN v ON v.metric_name = w.metric_name AND v.model_id = w.model_id AND v.k = w.k + 1) SELECT metric_name, model_id, event_id, ts FROM w WHERE fires = 1""",
    "most_confident": f"{_SNAP}, o AS (SELECT * FROM s WHERE model_id <> 0 AND n >= 5) SELECT metric_name, (SELECT model_id FROM o p WHERE p.metric_name = o.metric_name ORDER BY mean DESC, model_id LIMIT 1) AS chosen, round(max(mean), 6) AS confidence FROM o GROUP BY 1",
    "next_jobs": f"{_JOBS} SELECT queue, job_id, priority FROM j WHERE status = 'waiting' QUALIFY row_number() OVER (PARTITION BY queue ORDER BY priority DESC, created, job_id) = 1",
    "queue_counts": f"{_JOBS} SELECT queue, status, count(*) AS jobs FROM j GROUP BY 1, 2",
    "admitted_parts": "SELECT p_partkey, 36 >= p_size AND 1350 >= p_retailprice AS fits FROM part",
    "recent_orders": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 60 DAY",
    "kept_records": f"{_JOBS} SELECT job_id FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY cost, created) AS k FROM j) WHERE created >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY OR k <= 5",
    "config_variants": "WITH v AS (SELECT 's' || s_suppkey AS parent_id, 'kind=tuned,nation=' || s_nationkey || ',rate=0.1' AS params FROM supplier) SELECT parent_id, params, 'a,variant' AS tags, TIMESTAMP '1998-01-01' AS created, parent_id || '-' || substr(md5(params), 1, 12) AS config_id FROM v",
    "config_counts": "SELECT p_brand AS kind, count(*) AS configs, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1",
}
