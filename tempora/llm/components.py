"""Connected components of a link table, by alternating large and small stars in DataFrame operations.

Every step replaces links by links to smaller neighbours, which keeps the components and makes stars of them in few
rounds.  Minima are taken before the join, so a hub with very many links is pre-aggregated, and its join is one
that Spark can split.  Each round is written to the shared folder, and the one before it deleted.  Components settle in
a number of rounds that grows with the logarithm of the longest path; after `max_rounds` a RuntimeError says that they have not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import discard, materialise

#: Links that one task holds at most when few links are left.
PER_TASK = 250_000


def _large_star(links: DataFrame, tasks: int) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour, or to itself; in so many tasks."""
    both = links.unionByName(links.select(F.col("hub").alias("node"), F.col("node").alias("hub")))
    least = both.groupBy("node").agg(F.min("hub").alias("m")).select("node", F.least("node", "m").alias("m"))
    return both.where("hub > node").join(least, "node").select(F.col("hub").alias("node"), F.col("m").alias("hub")).coalesce(tasks)


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these; links point from larger to smaller; in so many tasks."""
    least = links.groupBy("node").agg(F.min("hub").alias("m"))
    joined = links.join(least, "node").coalesce(tasks)
    return joined.select(F.explode(F.array(F.struct("node", F.col("m").alias("hub")), F.struct(F.col("hub").alias("node"), F.col("m").alias("hub")))).alias("x")).select("x.*").where("node != hub")


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) from (node, hub): the least node of its component for each node that has a smaller one; its own
    for those that do not."""
    ordered = links.where("node != hub").select(F.greatest("node", "hub").alias("node"), F.least("node", "hub").alias("hub"))
    current = materialise(ordered.distinct(), "links")
    size = current.count()
    previous = None
    for _ in range(max_rounds):
        tasks = 8 + size // PER_TASK
        after = materialise(_small_star(_large_star(current, tasks), tasks).distinct().coalesce(tasks), "links")
        state = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node", "hub").cast("decimal(38,0)")).alias("h")).first()
        size = state["n"]
        settled = previous is not None and (state["n"], state["h"]) == previous
        discard(after if settled else current)  # of two rounds one goes on
        if settled:
            break
        previous, current = (state["n"], state["h"]), after
    else:
        raise RuntimeError("components did not settle")
    return current.select("node", F.col("hub").alias("component")).unionByName(current.select(F.col("hub").alias("node"), F.col("hub").alias("component")).distinct().coalesce(8 + size // PER_TASK))
