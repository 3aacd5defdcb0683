"""Sinks and small registries: bars by symbol, backtests in three formats, configurations with their records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "json", "orc")


def write_bars(bars: DataFrame, path: str) -> None:
    """One folder a symbol; symbols that are written again are replaced, others stay."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def read_symbol(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """One symbol's bars; only its folder is read."""
    return spark.read.parquet(path).where(F.col("symbol") == symbol)


def stored_symbols(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("symbol").distinct()


def metadata(bars: DataFrame) -> DataFrame:
    """(symbol, row_count, start_date, end_date, missing_data_pct, data_quality_score)."""
    cells = ["open", "high", "low", "close", "volume"]
    missing = sum((F.count_if(F.col(c).isNull()) for c in cells[1:]), F.count_if(F.col(cells[0]).isNull())) / (F.count(F.lit(1)) * len(cells))
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("row_count"), F.min("bar_ts").alias("start_date"), F.max("bar_ts").alias("end_date"), missing.alias("missing_data_pct"), (1 - missing).alias("data_quality_score"))


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a table in one of FORMATS."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def load(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else getattr(reader, kind)(path)


def retained(df: DataFrame, by: str, order: str, keep: int) -> DataFrame:
    """The newest `keep` rows of each name."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= keep).drop("__k")


def config_id(kind: str, created: str, params: str):
    """type, time and the first 12 hex digits of the digest of type and parameters."""
    return F.concat_ws("_", F.col(kind), F.date_format(created, "yyyyMMddHHmmss"), F.substring(F.md5(F.concat(F.col(kind), F.col(params))), 1, 12))


def best_records(configs: DataFrame, records: DataFrame, metric: str) -> DataFrame:
    """Each configuration with the record that is best (smallest) in a metric; those without records stay."""
    best = records.groupBy("config_id").agg(F.min(metric).alias(metric), F.count(F.lit(1)).alias("records"))
    return configs.join(best, "config_id", "left")


def with_tags(configs: DataFrame, wanted: list[str], limit: int) -> DataFrame:
    """The newest configurations that have all tags (a top-k report)."""
    return configs.where(F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), "tags")) == 0).orderBy(F.col("created").desc(), "config_id").limit(limit)
