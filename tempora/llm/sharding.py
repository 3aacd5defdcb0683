"""Sharding: a consistent-hash ring with virtual nodes and bounded loads, by DataFrame operations only.

Each shard has `vnodes` points on a ring of `CELLS` cells; a key's home is the shard of the first point clockwise
from the key's hash.  A shard holds at most its capacity, the row count dealt out evenly, so the law is `rows`:
counts differ by one at most.  Keys of a shard's arcs are accepted in ring order until it is full; the others
continue clockwise, arc by arc, to the first shard with room.  Few keys move when a shard comes or goes: those of its
arcs and the overflow.

Only counts of cells meet, of which one row an arc reaches the driver, where the
overflow walks the ring.  Identical rows are counted before the shuffle and dealt out again at the end, and a cell of more than RANKED
different rows is ranked in as many parts, by text, so neither a hot key nor a group of copies is sorted in one task.

Cases: null text has no bytes (size 1, crc32 0); a null id is a key of its own; repeated rows take slots of their
own; rows of one cell that tie in their hash are ordered by doc_id, text and size; a very long text is a size; an empty table gives an empty result; columns other than doc_id and text pass by unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import materialise, table, text_or_empty

#: Cells of the ring, and different keys of a cell that are ranked together.
CELLS, RANKED = 1 << 14, 100_000


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(cell, arc, home): the arc of every cell, numbered clockwise, and the shard whose point ends it; CELLS rows."""
    points = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), (F.col("id") / shards).cast("int").alias("copy"))
        .select(F.pmod(F.xxhash64("shard", "copy"), F.lit(CELLS)).alias("cell"), "shard")
        .groupBy("cell")
        .agg(F.min("shard").alias("shard"))  # of points in one cell, one counts
    )
    cells = spark.range(CELLS).select(F.col("id").alias("cell")).join(points, "cell", "left")
    onward = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)  # CELLS rows, each next point the last so far
    end = F.struct(F.col("cell").alias("at"), "shard")
    first = points.agg(F.min(end).alias("first"))  # one row
    marked = F.when(F.col("shard").isNotNull(), end)
    found = cells.select("cell", F.last(marked, True).over(onward).alias("end")).join(F.broadcast(first)).select("cell", F.coalesce("end", "first").alias("end"))
    return found.select("cell", F.col("end.at").alias("arc"), F.col("end.shard").alias("home"))


def walk(arcs: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, slot): which ranks of each arc go where, from arcs (arc, home, count) in ring order."""
    total = sum(n for _, _, n in arcs)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, over = [0] * shards, [], []

    def take(arc: int, start: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n:
            out.append((arc, start, start + n, shard, used[shard]))
            used[shard] += n
        return n

    for k, (arc, home, n) in enumerate(arcs):
        taken = take(arc, 0, n, home)
        if taken < n:
            over.append((k, arc, taken, n))
    for k, arc, start, n in over:
        step = 0
        while start < n:
            step += 1
            if step <= len(arcs):
                shard = arcs[(k + step) % len(arcs)][1]
            else:  # a shard without any arc of its own: in order
                shard = next(s for s in range(shards) if used[s] < room[s])
            start += take(arc, start, n - start, shard)
    return out


def assign(documents: DataFrame, shards: int = 16, vnodes: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row for each row of documents; slot counts from 0 in each shard."""
    spark = documents.sparkSession
    text = text_or_empty("text")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)))
    same = materialise(rows.groupBy("cell", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "shard-keys")
    split = same.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / RANKED).alias("parts"))  # CELLS rows at most
    same = same.join(F.broadcast(split), "cell").withColumn("part", F.pmod(F.xxhash64("text_crc32", "size"), F.col("parts")))
    arcs = F.broadcast(ring(spark, shards, vnodes))  # CELLS rows
    parts = same.groupBy("cell", "part").agg(F.sum("n").alias("n")).join(arcs, "cell", "right")
    parts = materialise(parts.select("arc", "home", "cell", "part", F.coalesce("n", F.lit(0)).alias("n")), "shard-parts")
    counted = parts.groupBy("arc", "home").agg(F.sum("n").alias("n")).orderBy("arc").collect()  # one row an arc
    segments = walk([tuple(r) for r in counted], shards)
    if not segments:
        segments = [(-1, 0, 0, 0, 0)]
    plan = spark.createDataFrame(segments, "arc long, `from` long, `to` long, shard int, slot long")
    before = Window.partitionBy("arc").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.where("part is not null").select("arc", "cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("cell", "part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text_crc32", "size")
    ranked = same.withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(starts), ["cell", "part"])  # CELLS rows, and one for each RANKED keys of large cells
    each = ranked.select("doc_id", "size", "text_crc32", "arc", F.explode(F.sequence(F.col("start") + F.col("upto") - F.col("n"), F.col("start") + F.col("upto") - 1)).alias("rank"))
    placed = each.join(F.broadcast(plan), "arc").where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("from")).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, counts at most one apart."""
    placed = assign(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
