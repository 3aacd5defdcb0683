"""Scans: the canonical long tables (bars, predictions, metrics) from parquet, with columns pruned and filters pushed down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical bar table; one row for each symbol and time.
BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("bar_ts", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalize_bars(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Any bar-like table in canonical names and types; NaN becomes null, the only missing marker inside the library."""
    mapping = mapping or {}
    out = []
    for field in BAR_SCHEMA:
        c: Column = F.col(mapping.get(field.name, field.name)).cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(field.name))
    return df.select(*out)


def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars by order priority; open and close by (date, key), volume the number of orders."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    key = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("bar_ts")).agg(
        F.min_by("o_totalprice", key).alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", key).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def bars_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each part from its line items; thousands of symbols, which grow with the data."""
    x = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return x.groupBy(F.col("l_partkey").cast("string").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("bar_ts")).agg(
        F.min_by("l_extendedprice", key).alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.max_by("l_extendedprice", key).alias("close"), F.sum("l_quantity").alias("volume")
    )


def bars_intraday(spark: SparkSession, sf_dir: str, width: str = "6 hours") -> DataFrame:
    """Bars of `width` by event type; price is the value, volume the sum of props.k."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    key = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.sum("k").alias("volume")
    ).select("symbol", F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "volume")


def bars_between(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from start up to, but without, end; the predicate reaches the scan."""
    if start:
        bars = bars.where(F.col("bar_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        bars = bars.where(F.col("bar_ts") < F.lit(end).cast("timestamp_ntz"))
    return bars


def predictions(spark: SparkSession, sf_dir: str, models: int = 4) -> DataFrame:
    """A prediction log: value and the model's next value as the actual one, in periods of 50 rows."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % models).alias("model_id"), F.col("value").alias("prediction"))
    w = Window.partitionBy("model_id").orderBy("ts", "event_id")
    e = e.select("*", F.lead("prediction").over(w).alias("actual"), ((F.row_number().over(w) - 1) / 50).cast("int").alias("period_id")).where("actual is not null")
    error = F.col("prediction") - F.col("actual")
    return e.select("*", F.abs(error).alias("error"), (error * error).alias("squared_error"))


#: The same tables as SQL for the oracle.
BARS_SQL = """bars AS (SELECT o_orderpriority AS symbol, date_trunc('week', o_orderdate)::TIMESTAMP AS bar_ts,
 arg_min(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
 arg_max(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2)"""
PREDICTIONS_SQL = """p0 AS (SELECT event_id, ts, user_id % 4 AS model_id, value AS prediction FROM events),
p1 AS (SELECT *, lead(prediction) OVER (PARTITION BY model_id ORDER BY ts, event_id) AS actual, ((row_number() OVER (PARTITION BY model_id ORDER BY ts, event_id) - 1) // 50)::INT AS period_id FROM p0),
predictions AS (SELECT *, abs(prediction - actual) AS error, (prediction - actual) * (prediction - actual) AS squared_error FROM p1 WHERE actual IS NOT NULL)"""
