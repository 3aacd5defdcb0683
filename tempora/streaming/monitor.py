"""Structured Streaming forms of the monitors: windowed metrics with watermarks, and stateful alert rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tempora.sources.shared import shared_folder


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A metric stream over parquet files of events that arrive in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric_name"), (F.col("user_id") % 4).alias("model_id"), F.col("value").alias("metric_value"))


def windowed_metrics(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count, mean, deviation and extremes of each metric in event-time windows; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy(w.alias("w"), "metric_name").agg(F.count(F.lit(1)).alias("n"), F.avg("metric_value").alias("mean"), F.stddev_samp("metric_value").alias("sd"), F.min("metric_value").alias("least"), F.max("metric_value").alias("most"))
    return out.select(F.col("w.start").alias("start"), "metric_name", "n", "mean", "sd", "least", "most")


def joined_actuals(predictions: DataFrame, actuals: DataFrame, late: str = "2 hours") -> DataFrame:
    """Predictions with the actual value that arrives for them within the bound; stream to stream, by prediction_id."""
    p = predictions.withWatermark("ts", late).alias("p")
    a = actuals.withWatermark("actual_ts", late).alias("a")
    bound = F.expr(f"p.prediction_id = a.prediction_id AND a.actual_ts >= p.ts AND a.actual_ts <= p.ts + interval {late}")
    return p.join(a, bound, "inner").select("p.prediction_id", "p.ts", "p.prediction", "a.actual")


def threshold_alerts(stream: DataFrame, threshold: float, cooldown_minutes: int = 30) -> DataFrame:
    """(metric_name, model_id, event_id, ts, metric_value): values above a threshold, one a series within the cooldown.

    The state of a series is the time it last fired.  Rows of a batch are taken in event-time order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        fired = []
        for row in rows.itertuples(index=False):
            at = int(row.ts.value // 1000)
            if row.metric_value > threshold and (last is None or at - last >= cooldown_minutes * 60_000_000):
                fired.append(row)
                last = at
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(fired, columns=rows.columns)[["metric_name", "model_id", "event_id", "ts", "metric_value"]]

    schema = "metric_name string, model_id long, event_id long, ts timestamp, metric_value double"
    return stream.groupBy("metric_name", "model_id").applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def threshold_alerts_batch(rows: DataFrame, threshold: float, cooldown_minutes: int = 30) -> DataFrame:
    """The same alerts over a table: a fold along each series' violations."""
    violations = rows.where(F.col("metric_value") > threshold).groupBy("metric_name", "model_id")
    gap = cooldown_minutes * 60_000_000

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        keep, last = [], None
        for at in pdf["ts"].astype("int64") // 1000:
            fires = last is None or at - last >= gap
            keep.append(fires)
            last = at if fires else last
        return pdf[keep][["metric_name", "model_id", "event_id", "ts", "metric_value"]]

    return violations.applyInPandas(run, "metric_name string, model_id long, event_id long, ts timestamp, metric_value double")


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a bounded stream to its end and read what it wrote: Parquet in the shared folder, a folder a trigger.

    In append mode the folders add up; in complete mode the last one is the result.  A trigger that is run again overwrites its
    own folder, so a lost executor or a restart leaves no rows twice.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{path}-state").start()
    query.awaitTermination()
    if query.lastProgress is None:  # no data, no trigger
        return spark.createDataFrame([], stream.schema)
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    if mode == "complete":
        found = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.drop("batch")
