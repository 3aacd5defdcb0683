"""Joins of series by time: spines, pivots, nearest as-of, pairs, weights, lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.sources.shared import shared_folder


def wide_pivot(bars: DataFrame, symbols: list[str], column: str = "close") -> DataFrame:
    """One row a time, one column a symbol."""
    return bars.groupBy("bar_ts").pivot("symbol", symbols).agg(F.first(column))


def nearest_asof(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """left with the value of right's row nearest in time within the same `by`; of two equally near, the earlier.

    Both sides are ordered together once: the last value before and the next one after each left row are its candidates,
    so nothing is paired by a range.
    """
    none = F.lit(None)
    both = left.select("*", F.col(left_ts).alias("__t"), none.cast("double").alias("__v"), none.cast("timestamp_ntz").alias("__vt"), F.lit(1).alias("__side")).unionByName(
        right.select(by, F.col(right_ts).alias("__t"), F.col(value).alias("__v"), F.col(right_ts).alias("__vt"), F.lit(0).alias("__side")), allowMissingColumns=True
    )
    w = Window.partitionBy(by).orderBy("__t", "__side")
    reverse = Window.partitionBy(by).orderBy(F.col("__t").desc(), F.col("__side").desc())  # so that both frames only grow
    known = F.when(F.col("__side") == 0, F.struct("__vt", "__v"))
    back, ahead = (F.last(known, True).over(x.rowsBetween(Window.unboundedPreceding, 0)) for x in (w, reverse))
    both = both.select("*", back.alias("__b"), ahead.alias("__a")).where("__side = 1")
    far = lambda x: F.abs(F.unix_micros(F.col(f"{x}.__vt").cast("timestamp")) - F.unix_micros(F.col("__t").cast("timestamp")))
    chosen = F.when(F.col("__a").isNull() | (far("__b") <= far("__a")), F.col("__b.__v")).otherwise(F.col("__a.__v"))
    return both.select(*left.columns, chosen.alias(value))


def pairs(bars: DataFrame, column: str = "ret") -> DataFrame:
    """(bar_ts, a, b, x, y): every two symbols at one time, a before b."""
    one = bars.select("bar_ts", F.col("symbol").alias("a"), F.col(column).alias("x"))
    two = bars.select("bar_ts", F.col("symbol").alias("b"), F.col(column).alias("y"))
    return one.join(two, "bar_ts").where("a < b").dropna(subset=["x", "y"])


def weight_changes(current: DataFrame, target: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(symbol, current, target, change, action) over both sides; absent weights are 0."""
    both = current.select("symbol", F.col("weight").alias("current")).join(target.select("symbol", F.col("weight").alias("target")), "symbol", "full_outer").fillna(0.0, ["current", "target"])
    change = F.col("target") - F.col("current")
    return both.select("*", change.alias("change"), F.when(F.abs(change) <= threshold, "hold").when(change > 0, "buy").otherwise("sell").alias("action"))


def lineage(spark: SparkSession, configs: DataFrame) -> DataFrame:
    """(config_id, root, depth): the root of each config's chain of parents (config_id, parent_id), and the chain's length.

    Steps are doubled: a round joins walks of 2^k steps with the longest walks of fewer steps from where they end, so a
    chain of n configs takes log2(n) rounds, and no row is kept for each of its steps.  Of several chains the longest counts,
    and of equally long ones that with the greatest root; chains that close a circle are an error.
    """
    kind, path = configs.schema["config_id"].dataType, f"{shared_folder(spark)}/lineage-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    steps = stored(configs.select("config_id", F.col("parent_id").cast(kind).alias("at")).where("config_id IS NOT NULL AND at IS NOT NULL").distinct(), "steps-0")
    walks = configs.select("config_id", F.col("config_id").alias("root"), F.lit(0).alias("depth"))
    n, k = steps.count(), 0
    while not steps.isEmpty():
        if 2**k > n:  # as many steps as there are parents are walked, so some were walked twice
            raise ValueError("a chain of parents closes a circle")
        further = steps.join(walks.select(F.col("config_id").alias("at"), "root", F.col("depth").alias("more")), "at", "left")
        further = further.select("config_id", F.coalesce("root", "at").alias("root"), (F.lit(2**k) + F.coalesce("more", F.lit(0))).cast("int").alias("depth"))
        best = walks.unionByName(further).groupBy("config_id").agg(F.max(F.struct("depth", "root")).alias("best"))
        following = steps.join(steps.select(F.col("config_id").alias("at"), F.col("at").alias("next")), "at").select("config_id", F.col("next").alias("at")).distinct()
        k += 1
        walks, steps = stored(best.select("config_id", "best.root", "best.depth"), f"walks-{k}"), stored(following, f"steps-{k}")
    return walks.groupBy("config_id").agg(F.max(F.struct("depth", "root")).alias("best")).select("config_id", "best.root", "best.depth")
