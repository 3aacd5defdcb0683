"""What the operators of this package share: reading tables, shared storage, null-safe text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tempora.sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there, and executors may be lost.
    free: delete the shuffle files of the writing at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


_written: dict[int, tuple[DataFrame, str]] = {}


def discard(df: DataFrame) -> None:
    """Delete a table that materialise wrote, once nothing reads it any more."""
    _, path = _written.pop(id(df))
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of whole texts, or of shingle sets, that a Python worker holds at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session have BATCH_ROWS rows at most: rows here are long, and workers' memory is small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_or_empty(column: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for a broadcast where it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that starts with `wanted` and that df does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def append_columns(df: DataFrame, run: Callable[[pa.RecordBatch], list[pa.Array]], more: dict[str, DataType]) -> DataFrame:
    """df with the columns that run makes of each Arrow batch; run finds columns by their place, as names may be anything."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    schema = StructType([*plain.schema.fields, *[StructField(f"n{k}", kind) for k, kind in enumerate(more.values())]])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield pa.RecordBatch.from_arrays([*batch.columns, *run(batch)], schema.names)

    return plain.mapInArrow(batches, schema).toDF(*df.columns, *more)


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; the fold of a labelled row."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(divisor))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row per doc_id; where rows disagree or repeat, the smallest label that is not null counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))


#: Labels of at most this many rows (up to 100 bytes each on an executor) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_LABELS = 400_000


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the documents that have a label, whole texts; null text is empty."""
    small = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    if labels.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS:
        small = F.broadcast(small)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).join(small, "doc_id")
