"""Tracking of models, alerts and jobs over logs: histories, snapshots, confidence, health, cooldowns, switches, queues.

Metric streams have (metric_name, model_id, ts, event_id, metric_value).  Times are compared within the data (the newest row
of a table is its now), so that a table gives the same result whenever it is read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.rolling import div
from tempora.operators.monitoring import series

def _from_newest():
    return Window.partitionBy("metric_name", "model_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())


def bounded_history(stream: DataFrame, keep: int = 1000) -> DataFrame:
    """The newest `keep` rows of each series; Spark keeps a series' first rows only while it sorts, so older ones are not shuffled on."""
    return stream.withColumn("__k", F.row_number().over(_from_newest())).where(F.col("__k") <= keep).drop("__k")


def recent(stream: DataFrame, hours: int = 24) -> DataFrame:
    """(metric_name, model_id, n, mean): the last hours before the table's newest row."""
    newest = stream.agg(F.max("ts").alias("now"))  # one row
    last = stream.join(F.broadcast(newest)).where(F.col("ts") >= F.col("now") - F.make_dt_interval(hours=F.lit(hours)))
    return last.groupBy("metric_name", "model_id").agg(F.count(F.lit(1)).alias("n"), F.avg("metric_value").alias("mean"))


def snapshots(stream: DataFrame, last: int = 100, least: int = 5) -> DataFrame:
    """(metric_name, model_id, n, mean, deviation, newest): of each series' last rows; the mean is infinite below `least` rows."""
    tail = bounded_history(stream, last)
    out = tail.groupBy("metric_name", "model_id").agg(F.count(F.lit(1)).alias("n"), F.avg("metric_value").alias("mean"), F.stddev_pop("metric_value").alias("deviation"), F.max_by("metric_value", F.struct("ts", "event_id")).alias("newest"))
    return out.withColumn("mean", F.when(F.col("n") >= least, F.col("mean")).otherwise(F.lit(float("inf"))))


def dashboard(stream: DataFrame) -> DataFrame:
    """(metric_name, models, best, best_value, worst, worst_value) by each model's newest value; ties by the smaller model."""
    latest = stream.groupBy("metric_name", "model_id").agg(F.max_by("metric_value", F.struct("ts", "event_id")).alias("v"))
    up, down = F.struct("v", "model_id"), F.struct("v", -F.col("model_id"))
    return latest.groupBy("metric_name").agg(F.count(F.lit(1)).alias("models"), F.min_by("model_id", up).alias("best"), F.min("v").alias("best_value"), F.max_by("model_id", down).alias("worst"), F.max("v").alias("worst_value"))


def health(log: DataFrame, failed: Column) -> DataFrame:
    """(day, requests, per_minute, error_rate, mean_latency, uptime_hours) of a request log (ts, latency); uptime from the table's first row."""
    first = log.agg(F.min("ts").alias("first"))  # one row
    daily = log.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"), (F.count(F.lit(1)) / 1440).alias("per_minute"), F.avg(failed.cast("double")).alias("error_rate"), F.avg("latency").alias("mean_latency"), F.max("ts").alias("last")
    )
    seconds = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))
    return daily.join(F.broadcast(first)).select("day", "requests", "per_minute", "error_rate", "mean_latency", (seconds / 3_600_000_000).alias("uptime_hours"))


def accuracy(prediction: Column, actual: Column) -> Column:
    """One less the relative error, not below 0."""
    return F.greatest(F.lit(0.0), 1 - F.abs(prediction - actual) / (F.abs(actual) + 1e-8))


def historical_confidence(log: DataFrame) -> DataFrame:
    """(model_id, event_id, accuracy, confidence) of a prediction log: the mean accuracy of the last 50 rows, raised by its trend
    (last 10 against the 10 before, up to 0.2) and its stability (0.2 less the deviation of the last 20); 0.7 before 10 rows."""
    order = Window.partitionBy("model_id").orderBy("ts", "event_id")
    back = lambda n, end=0: order.rowsBetween(end - n + 1, end)
    a = log.select("model_id", "event_id", "ts", accuracy(F.col("prediction"), F.col("actual")).alias("accuracy"))
    mean = lambda n, end=0: F.avg("accuracy").over(back(n, end))
    seen = F.count(F.lit(1)).over(back(20))
    within = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(most), c))
    trend = F.when(seen == 20, within(mean(10) - mean(10, -10), 0.2)).otherwise(0.0)
    stable = F.when(seen == 20, F.greatest(F.lit(0.0), 0.2 - F.stddev_pop("accuracy").over(back(20)))).otherwise(0.1)
    return a.select("model_id", "event_id", "accuracy", F.when(seen < 10, 0.7).otherwise(within(mean(50) + trend + stable, 1.0)).alias("confidence"))


def confidence_alerts(assessed: DataFrame, least_confidence: float = 0.3, most_risk: float = 0.8) -> DataFrame:
    """(event_id, type, severity) from assessments (event_id, confidence, risk, agreement, quality, warnings): one row an alert."""
    rule = lambda c, kind, severity: F.when(c, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity")))
    rules = F.array_compact(F.array(
        rule(F.col("confidence") < least_confidence, "LOW_CONFIDENCE", "WARNING"), rule(F.col("risk") > most_risk, "HIGH_RISK", "CRITICAL"),
        rule(F.col("agreement") < 0.5, "MODEL_DISAGREEMENT", "WARNING"), rule(F.col("quality") < 0.6, "DATA_QUALITY", "WARNING"),
    ))
    warned = F.transform("warnings", lambda _: F.struct(F.lit("RISK_WARNING").alias("type"), F.lit("INFO").alias("severity")))
    return assessed.select("event_id", *(["ts"] if "ts" in assessed.columns else []), F.explode(F.concat(rules, warned)).alias("x")).select(*[c for c in ("event_id", "ts") if c in assessed.columns], "x.type", "x.severity")


def alerts_by_type(alerts: DataFrame, hours: int = 24) -> DataFrame:
    """(type, severity, alerts) of the last hours before the newest alert, and their totals."""
    newest = alerts.agg(F.max("ts").alias("now"))
    last = alerts.join(F.broadcast(newest)).where(F.col("ts") > F.col("now") - F.make_dt_interval(hours=F.lit(hours)))
    return last.rollup("type", "severity").agg(F.count(F.lit(1)).alias("alerts"))


def metric_summary(stream: DataFrame) -> DataFrame:
    """(metric_name, n, mean, deviation, least, most)."""
    return stream.groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"), F.avg("metric_value").alias("mean"), F.stddev_pop("metric_value").alias("deviation"), F.min("metric_value").alias("least"), F.max("metric_value").alias("most"))


def most_confident(stream: DataFrame, active: Column) -> DataFrame:
    """(metric_name, chosen, confidence): the model with the highest mean of the last 100 rows, but for the active one."""
    shot = snapshots(stream).where(~active & (F.col("n") >= 5))
    return shot.groupBy("metric_name").agg(F.max_by("model_id", F.struct("mean", -F.col("model_id"))).alias("chosen"), F.max("mean").alias("confidence"))


def cooled(violations: DataFrame, minutes: int) -> DataFrame:
    """The violations (metric_name, model_id, ts, event_id) that fire: one a series within the cooldown.  Each group holds the times of
    one series' violations only."""
    gap = minutes * 60_000_000

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        keep, last = [], None
        for at in pdf["ts"].astype("int64") // 1000:
            fires = last is None or at - last >= gap
            keep.append(fires)
            last = at if fires else last
        return pdf[keep]

    slim = violations.select("metric_name", "model_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return slim.groupBy("metric_name", "model_id").applyInPandas(run, "metric_name string, model_id long, event_id long, ts timestamp")


def switches(stream: DataFrame, threshold: float, n: int = 20, minutes: int = 240) -> DataFrame:
    """(metric_name, ts, event_id, from_model, to_model): a state machine for each metric.  The active model, the smallest at first, gives way when
    its mean of the last n rows is above the threshold, to the model with the least newest mean, if that is less; not
    within `minutes` of the last switch.  A group holds one metric's rows of four numbers."""
    w = series().rowsBetween(-(n - 1), 0)
    means = stream.select("metric_name", "model_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.count(F.lit(1)).over(w) == n, F.avg("metric_value").over(w)).alias("mean")).where("mean is not null")
    gap = minutes * 60_000_000

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        active, since, newest, out = pdf["model_id"].min(), None, {}, []
        for model, event, ts, mean in zip(pdf["model_id"], pdf["event_id"], pdf["ts"], pdf["mean"], strict=True):
            newest[model] = mean
            at = int(ts.value // 1000)
            if model != active or mean <= threshold or (since is not None and at - since < gap):
                continue
            best, other = min((v, k) for k, v in newest.items())
            if best < mean and other != active:
                out.append((pdf["metric_name"].iloc[0], ts, event, active, other))
                active, since = other, at
        return pd.DataFrame(out, columns=["metric_name", "ts", "event_id", "from_model", "to_model"])

    return means.groupBy("metric_name").applyInPandas(run, "metric_name string, ts timestamp, event_id long, from_model long, to_model long")


def switch_counts(switched: DataFrame) -> DataFrame:
    """(from_model, to_model, switches), with totals."""
    return switched.cube("from_model", "to_model").agg(F.count(F.lit(1)).alias("switches"))


def next_jobs(jobs: DataFrame, by: str) -> DataFrame:
    """(by, job_id, priority): the next waiting job of each queue: the highest priority, then the oldest, then the smallest id."""
    order = F.struct(-F.col("priority"), F.col("created"), F.col("job_id"))
    return jobs.where("status = 'waiting'").groupBy(by).agg(F.min_by("job_id", order).alias("job_id"), F.min_by("priority", order).alias("priority"))


def queue_counts(jobs: DataFrame, by: str) -> DataFrame:
    """(by, status, jobs)."""
    return jobs.groupBy(by, "status").agg(F.count(F.lit(1)).alias("jobs"))


def admitted(needed: dict[str, Column], available: dict[str, Column], margin: float = 0.1) -> Column:
    """Whether each needed resource fits in what is available less a margin."""
    out = F.lit(True)
    for name, need in needed.items():
        out = out & (available[name] * (1 - margin) >= need)
    return out


def kept_since(df: DataFrame, updated: str, now: Column, days: int = 30) -> DataFrame:
    """Rows updated within the days before now; the predicate reaches the scan."""
    return df.where(F.col(updated) >= now - F.make_dt_interval(days=F.lit(days)))


def keep_best(records: DataFrame, by: str, score: str, updated: str, now: Column, days: int, best: int) -> DataFrame:
    """Rows that are young enough, or among the `best` smallest scores of their kind."""
    ranked = records.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(score, updated)))
    return ranked.where((F.col(updated) >= now - F.make_dt_interval(days=F.lit(days))) | (F.col("__k") <= best)).drop("__k")


def variant(configs: DataFrame, updates: Column, created: Column) -> DataFrame:
    """configs (config_id, params, tags) as variants: parameters overlaid, the tag `variant` added, the parent set, an id from all parameters."""
    merged = F.map_concat(F.map_filter("params", lambda k, _: ~F.array_contains(F.map_keys(updates), k)), updates)
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    found = configs.select(F.col("config_id").alias("parent_id"), text(merged).alias("params"), F.array_join(F.array_distinct(F.concat("tags", F.array(F.lit("variant")))), ",").alias("tags"), created.alias("created"))
    return found.withColumn("config_id", F.concat_ws("-", "parent_id", F.substring(F.md5("params"), 1, 12)))
