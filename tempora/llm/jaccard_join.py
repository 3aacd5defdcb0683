"""N-gram Jaccard join in metric space, exact: which documents' sets of word shingles link, as connected components.

Jaccard distance is a metric.  Two documents link when their distance is at most e = 1 - percent / 100.

1. Equal sets are one class, and one document of each stands for it from here on.
2. First regions.  Whole documents drawn at random cannot split a large corpus: unrelated texts are at distance 1 from any
   of them, and every window would hold everything.  So windows come first.  Take the first m = n - ceil(percent * n / 100) + 1
   of a document's n shingles, in any order of all shingles, as a point A of the space: the document is at distance
   1 - m / n of A, and a text without any of A at distance 1, so by the triangle inequality at least m / n > e apart from the document.
   The window of a document thus holds only those that share one of its m first shingles; the order takes a quarter of
   all shingles first, by their exact number of documents, so that windows are small.  Of the documents that have a
   shingle the least is the pivot, its region are all documents with that shingle among their first ones, and a document in
   several windows is replicated to each of their pivots.  Any two documents that link meet in some region.  A region whose members
   are all in the region of its own pivot's least pivot is dropped.
3. Voronoi regions.  A region above `leaf` documents draws `pivots` pivots.  Each document is at home with its nearest one, or,
   where none is nearer than 1/2, with a point that is 1/2 away from all (a metric stays one with such a point, and
   unrelated documents do not crowd all windows).  Documents in the ball of radius e around a pivot link to it.  A boundary document is
   replicated to an earlier pivot p where its distance is at most that to its own pivot plus 2e, and at most the radius of p's
   region plus e; by the triangle inequality no other document links into that region.  A region whose
   documents are all in one component already is done; the others are joined in the same way, recursively.
4. Where the windows of a region hold more than twice its documents (all are about 2e apart, so no pivot tells them apart), or after
   `levels` levels, its documents are dealt into blocks of half a leaf and every two blocks are one leaf, but for blocks of one
   component.  So no task holds more than a leaf, whatever the region.
5. Leaves.  One task joins a region pivot by pivot, with distances from an inverted index, until each document is a pivot or in
   a ball; documents within 2e of a foreign pivot whose ball reaches that far become pivots as well.  Nothing but
   documents that share shingles is ever compared.

Shingles are equal when their 64-bit hashes are, and sets when their sizes and 128 bits of sums are.  Links are kept
as stars, not as all pairs of a group.

Cases: null text, or one without words, has an empty set and links to nothing; a text of fewer words than a shingle
is one shingle; rows with one doc_id are one document; a null doc_id links to nothing; an empty table gives an empty
result; a very long text is one set in one row; other columns, whatever their names, pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import free_name, materialise, small, small_batches, table, text_or_empty
from tempora.llm.components import PER_TASK, connected_components
from tempora.llm.hashing import _BASE, blocks, mix, shingle_hashes, string_buffers, word_hashes

#: Rows of ids (up to 120 bytes each on an executor) that are broadcast at most, and shingles (8 bytes each) of pivots;
#: beyond either the join is a shuffle.
MAX_BROADCAST, MAX_BROADCAST_SHINGLES = 200_000, 2_000_000


@dataclass(frozen=True)
class Params:
    """k: words of a shingle; percent: similarity of linked sets; leaf, leaf_shingles: documents, and shingles of them, that one
    task joins; pivots: of a larger region; levels: of such regions inside one another."""

    k: int = 4
    percent: int = 85
    leaf: int = 1000
    leaf_shingles: int = 2_000_000
    pivots: int = 8
    levels: int = 3


def _small(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast where it has few rows."""
    return small(df, MAX_BROADCAST)


def _shingles(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingle hashes, their offsets by row), block by block."""
    data, offsets = string_buffers(column)
    for i, j in blocks(offsets):
        words, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, *shingle_hashes(words, at, k)


def signatures(documents: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n, d1, d2, first): size and digest of each row's set; its shingles of the first quarter, and as many others, in
    the order of their hashes, as are needed where these are fewer than its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, at in _shingles(batch.column("text"), p.k):
                sizes, one, two, first = [], [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    own = np.unique(hashes[a:b])
                    n = len(own)
                    mixed = mix(own)
                    sizes.append(n)
                    one.append(int(mixed.sum(dtype=np.uint64).astype(np.int64)) if n else 0)
                    two.append(int(mix(mixed ^ _BASE).sum(dtype=np.uint64).astype(np.int64)) if n else 0)
                    quarter = (mixed & np.uint64(3)) == 0
                    counted = own[quarter]
                    more = max(_window(n, p.percent) - len(counted), 0)
                    first.append(np.concatenate([counted, own[~quarter][:more]]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _lists(first)], ["doc_id", "n", "d1", "d2", "first"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, first array<long>")


def _window(n: int, percent: int) -> int:
    """How many first shingles of a set of n meet every set that it links to."""
    return n + (-percent * n) // 100 + 1 if n else 0


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _regions(found: DataFrame, twins: DataFrame, p: Params, repeats: bool | None = None) -> DataFrame:
    """(node, region, size, weight): each document in the regions of its windows' pivots; regions have two members or more.
    repeats: whether some doc_id has several rows, where that is known.

    Counts are taken by partial aggregation, so a shingle of very many documents is a row a task there; its rows then
    meet its count in a join that Spark can split.
    """
    rows = found.where("n > 0 and doc_id is not null").join(_small(twins), ["d1", "d2", "n"], "left").where("node is null or node = doc_id").select(F.col("doc_id").alias("node"), "n", "d1", "d2", "first")
    if _repeats(found) if repeats is None else repeats:
        rows = rows.dropDuplicates(["node", "d1", "d2", "n"])
    each = rows.select("node", "n", F.size("first").alias("listed"), F.explode("first").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("node").alias("pivot")).where("docs > 1")
    met = each.join(shared, "key")
    # of one set: its shared shingles by their number of documents; those of nobody else come before them in its window
    own = met.groupBy("node", "n", "listed").agg(F.array_sort(F.collect_list(F.struct("docs", "key", "pivot"))).alias("shared"))
    budget = (F.col("n") - F.ceil(p.percent * F.col("n") / 100) + 1 - (F.col("listed") - F.size("shared"))).cast("int")
    pivots = F.array_sort(F.array_distinct(F.transform(F.slice("shared", 1, F.greatest(budget, F.lit(0))), lambda x: x["pivot"])))
    placed = own.select("node", "n", pivots.alias("pivots")).where(F.size("pivots") > 0)
    placed = materialise(placed.groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pivots")))).alias("pivots")), "jaccard-windows")

    upper = placed.where(F.get("pivots", 0) < F.col("node")).select(F.col("node").alias("region"), F.get("pivots", 0).alias("upper"))
    members = placed.select("node", "n", "pivots", F.explode("pivots").alias("region")).join(_small(upper), "region", "left")
    covered = F.col("upper").isNotNull() & F.coalesce(F.array_contains("pivots", F.col("upper")), F.lit(False))
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min(covered).alias("covered"))
    sizes = materialise(sizes.where("size > 1 and not covered").drop("covered"), "jaccard-regions")
    return placed.select("node", F.explode("pivots").alias("region")).join(_small(sizes), "region")


def _sets(documents: DataFrame, regions: DataFrame, p: Params) -> DataFrame:
    """(region, node, n, shingles): the sets of the documents that are in regions, once a region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("regions")
            ends, regions_of = np.asarray(lists.offsets), np.asarray(lists.values)
            nodes = np.asarray(batch.column("node"))
            for i, j, hashes, at in _shingles(batch.column("text"), p.k):
                own = [np.unique(hashes[a:b]).astype(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
                times = np.diff(ends[i : j + 1])
                which = np.repeat(np.arange(j - i), times)
                sizes = np.array([len(x) for x in own], np.int64)[which]
                yield pa.RecordBatch.from_arrays([pa.array(regions_of[ends[i] : ends[j]]), pa.array(nodes[i:j][which]), pa.array(sizes), _lists([own[x] for x in which])], ["region", "node", "n", "shingles"])

    placed = regions.groupBy("node").agg(F.collect_list("region").alias("regions"))
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), text_or_empty("text").alias("text"))
    return texts.join(_small(placed), "node").select("regions", "node", "text").mapInArrow(run, "region long, node long, n long, shingles array<long>").where("n > 0")


def _too_large(size: Column, weight: Column, p: Params) -> Column:
    return (size > 2) & ((size > p.leaf) | (weight > p.leaf_shingles))


def _tasks(documents: int) -> int:
    """How many tasks take the summaries of so many documents of large regions: small tables should not cost the driver a task a shuffle partition."""
    return 8 + documents // PER_TASK


def _measured(sets: DataFrame, p: Params, seed: int, tasks: int) -> DataFrame:
    """sets with `near`, the distances to the pivots of their region and whether they link to them."""
    spread = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(p.pivots))
    drawn = sets.groupBy("region", spread.alias("at")).agg(F.min(F.struct(F.xxhash64("node", F.lit(seed + 1)).alias("h"), "node", "n", "shingles")).alias("x")).coalesce(tasks)
    chosen = drawn.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("x.node", "x.n", "x.shingles"))).alias("drawn"))  # `pivots` sets a region
    chosen = materialise(chosen.coalesce(tasks), "jaccard-pivots")
    weight = chosen.select(F.sum(F.aggregate("drawn", F.lit(0).cast("long"), lambda s, q: s + q["n"]))).first()[0] or 0
    if weight <= MAX_BROADCAST_SHINGLES:
        chosen = F.broadcast(chosen)

    def compared(q: Column) -> Column:
        return F.struct(q["node"].alias("pivot"), F.size(F.array_intersect("shingles", q["shingles"])).cast("long").alias("c"), (F.col("n") + q["n"]).alias("both"))

    near = F.transform(F.transform("drawn", compared), lambda q: F.struct(q["pivot"].alias("pivot"), (1 - q["c"] / (q["both"] - q["c"])).alias("d"), (100 * q["c"] >= p.percent * (q["both"] - q["c"])).alias("linked")))
    return materialise(sets.join(chosen, "region").select("region", "node", "n", "shingles", near.alias("near")), "jaccard-measured")


#: Distance of every document to the point that is home to those far from all pivots.
FAR = 0.5


def _summed(measured: DataFrame, p: Params, few: bool, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(measured with `component`, distances `ds`, the least `best` of them and its place `home`, and what has a row a region; (region, documents)).

    A row a region has its number of documents, the radius of each home, and its different sets of linked pivots, at most
    two to the power of `pivots`, as a map from each pivot to the least one that it is joined to by documents in several balls.
    That is the component of a document in a ball; it is null where it is in none.
    """
    own = F.transform(F.filter("near", lambda q: q["linked"]), lambda q: q["pivot"])
    cells = F.concat(F.transform("near", lambda q: q["d"]), F.array(F.lit(FAR)))
    rows = measured.withColumns({"own": own, "ds": cells}).withColumn("best", F.array_min("ds")).withColumn("home", F.array_position("ds", F.col("best")).cast("int") - 1)
    radius = F.array(*[F.max(F.when(F.col("home") == i, F.col("best"))) for i in range(p.pivots + 1)])
    met = rows.groupBy("region").agg(F.count(F.lit(1)).alias("documents"), F.collect_set(F.when(F.size("own") > 0, F.col("own"))).alias("sets"), radius.alias("radius"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = []
            for sets in batch.column("sets").to_pylist():
                label = {x: x for group in sets for x in group}
                for _ in sets:  # each pass settles one more at least
                    for group in sets:
                        least = min(label[x] for x in group)
                        label = {x: least if y in {label[z] for z in group} else y for x, y in label.items()}
                labels.append(sorted(label.items()))
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("documents"), pa.array(labels, pa.map_(pa.int64(), pa.int64())), batch.column("radius")], ["region", "documents", "labels", "radius"])

    found = materialise(met.coalesce(tasks).mapInArrow(run, "region long, documents long, labels map<long, long>, radius array<double>"), "jaccard-summed")
    known = found.drop("documents")
    rows = rows.join(F.broadcast(known) if few else known, "region").withColumn("component", F.when(F.size("own") > 0, F.element_at("labels", F.get("own", 0)))).drop("own", "labels")
    return rows, found.select("region", "documents")


def _voronoi(summed: DataFrame, p: Params) -> DataFrame:
    """(region, home, cell, node, n, shingles, component): documents at home with their nearest pivot, and as guests where windows reach."""
    e, slack = 1 - p.percent / 100, 1e-9
    reached = F.filter(
        F.sequence(F.lit(0), F.col("home")),
        lambda i: (i == F.col("home")) | ((F.get("ds", i) <= F.col("best") + 2 * e + slack) & (F.get("ds", i) <= F.get("radius", i) + e + slack)),
    )
    return summed.select("region", "home", F.explode(reached).alias("cell"), "node", "n", "shingles", "component")


def _open(parts: DataFrame, *by: str) -> DataFrame:
    """(by, size, weight) of the groups that have two documents of different components, or of none yet."""
    stats = parts.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.count("component").alias("known"), F.min("component").alias("a"), F.max("component").alias("b"))
    return stats.where("size > 1 and not (known = size and a = b)").select(*by, "size", "weight")


#: Stands for all components that have no blocks of their own; no doc_id.
MIXED = -(2**62)


def _blocks(sets: DataFrame, p: Params, tasks: int) -> DataFrame:
    """(region, node, n, shingles): regions as pairs of blocks; a block is a share of one component, or of all smaller ones together."""
    half = max(p.leaf // 2, 1)
    big = sets.groupBy("region", "component").agg(F.count(F.lit(1)).alias("docs")).where(F.col("component").isNotNull() & (F.col("docs") > half)).coalesce(tasks)
    marked = sets.join(_small(big.select("region", "component", F.lit(True).alias("big"))), ["region", "component"], "left")
    marked = marked.select("region", F.when(F.col("big"), F.col("component")).otherwise(MIXED).alias("own"), "node", "n", "shingles")
    marked = materialise(marked, "jaccard-marked")
    parts = marked.groupBy("region", "own").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("weight"))
    parts = materialise(parts.select("region", "own", F.greatest(F.ceil(F.col("docs") / half), F.ceil(2 * F.col("weight") / p.leaf_shingles)).cast("int").alias("shares")).coalesce(tasks), "jaccard-shares")
    each = parts.select("region", "own", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    other = each.select("region", F.col("own").alias("own2"), F.col("share").alias("share2"))
    one_component = (F.col("own") == F.col("own2")) & (F.col("own") != MIXED)
    pairs = each.join(other, "region").where((F.struct("own", "share") <= F.struct(F.col("own2").alias("own"), F.col("share2").alias("share"))) & ~one_component)  # summaries of blocks only
    pairs = pairs.withColumn("pair", F.xxhash64("region", "own", "share", "own2", "share2"))
    sides = pairs.select("region", "own", "share", "pair").unionByName(pairs.select("region", F.col("own2").alias("own"), F.col("share2").alias("share"), "pair")).distinct()
    sides = materialise(sides.coalesce(tasks), "jaccard-sides")
    dealt = marked.join(_small(parts), ["region", "own"]).withColumn("share", F.pmod(F.xxhash64("node", F.lit(17)), F.col("shares")).cast("int"))
    met = dealt.join(_small(sides), ["region", "own", "share"])
    return met.select(F.col("pair").alias("region"), "node", "n", "shingles")


def _divided(sets: DataFrame, p: Params, regions: int, documents: int) -> tuple[DataFrame, DataFrame]:
    """(links to pivots, the regions that are left, none above a leaf) of regions that are all above a leaf; so many regions, and documents in them."""
    links, leaves, rest = None, None, sets
    add = lambda whole, part: part if whole is None else whole.unionByName(part)
    kept = lambda df: df.select("region", "node", "n", "shingles")
    for level in range(p.levels):
        few, tasks = regions * (p.pivots + 1) <= MAX_BROADCAST, _tasks(documents)  # few: rows of what has a row a cell
        of = lambda x: F.broadcast(x) if few else x  # noqa: B023, E731
        measured = _measured(rest, p, 100 + 2 * level, tasks)
        links = add(links, measured.select("node", F.explode(F.filter("near", lambda q: q["linked"])).alias("q")).select("node", F.col("q.pivot").alias("hub")).where("node != hub"))
        summed, before = _summed(measured, p, few, tasks)
        cells = materialise(_voronoi(summed, p), "jaccard-cells")
        open_cells = _open(cells, "region", "cell").coalesce(tasks).join(of(before), "region")
        after = F.sum("size").over(Window.partitionBy("region"))  # `pivots` rows
        open_cells = materialise(open_cells.select("region", "cell", "size", "weight", (after <= 2 * F.col("documents")).alias("splits")).coalesce(tasks), "jaccard-open")
        large = _too_large(F.col("size"), F.col("weight"), p)
        again = F.when(F.col("splits") & large, F.col("size"))
        stuck, regions, more = open_cells.agg(F.count(F.when(~F.col("splits"), 1)), F.count(again), F.sum(again)).first()
        if stuck:
            parted = summed.join(of(open_cells.where("not splits").select("region")), "region", "left_semi")
            leaves = add(leaves, _blocks(parted.select("region", "node", "n", "shingles", "component"), p, tasks))
        inside = cells.join(of(open_cells.where("splits")), ["region", "cell"]).withColumn("region", F.xxhash64("region", "cell", F.lit(level)))
        leaves = add(leaves, kept(inside.where(~large)))
        if not regions:
            return links, leaves
        rest, documents = materialise(kept(inside.where(large)), "jaccard-rest"), more
    rest = rest.join(_small(connected_components(links)), "node", "left")
    return links, leaves.unionByName(_blocks(rest, p, _tasks(documents)))


def join_region(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The least node of each one's component, by pivots and triangle-inequality windows over one region."""
    m = len(nodes)
    n = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    token = np.empty(len(flat), np.int64)
    token[order] = np.cumsum(new) - 1
    starts = np.append(np.flatnonzero(new), len(ranked))
    post = owner[order]  # documents by token
    ends_of = np.cumsum(n)
    parent = np.arange(m)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def unite(x: int, y: int) -> None:
        a, b = find(x), find(y)
        parent[max(a, b)] = min(a, b)

    def common(x: int) -> np.ndarray:
        own = token[ends_of[x] - n[x] : ends_of[x]]
        lengths = starts[own + 1] - starts[own]
        shift = np.repeat(starts[own] - (np.cumsum(lengths) - lengths), lengths)
        return np.bincount(post[shift + np.arange(len(shift))], minlength=m)

    e = 1 - percent / 100
    home = np.full(m, -1)
    shells: list[tuple[int, np.ndarray, np.ndarray, float]] = []
    for p in np.argsort(n, kind="stable"):
        if home[p] >= 0:
            continue
        home[p] = p
        c = common(p)
        d = 1 - c / (n + n[p] - c)
        linked = 100 * c >= percent * (n + n[p] - c)
        for x in np.flatnonzero(linked):
            unite(p, x)
        home[linked & (home < 0)] = p
        shell = np.flatnonzero(~linked & (d <= 2 * e + 1e-9))
        shells.append((p, shell, d[shell], float(d[linked].max())))
    tried = home == np.arange(m)  # pivots have met every document
    for p, shell, d, reach in shells:
        for x, far in zip(shell, d, strict=True):
            if tried[x] or far > reach + e + 1e-9 or find(x) == find(p):
                continue
            tried[x] = True
            c = common(x)
            for y in np.flatnonzero(100 * c >= percent * (n + n[x] - c)):
                unite(x, y)
    roots = np.array([find(x) for x in range(m)])
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, roots, nodes)
    return least[roots]


def _leaves(sets: DataFrame, p: Params, partitions: int) -> DataFrame:
    """(node, hub): each document of a region with the least one of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        region = None

        def close() -> pa.RecordBatch | None:
            nodes = np.array([x for x, _ in held], np.int64)
            least = join_region(nodes, [s for _, s in held], p.percent)
            keep = nodes != least
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(least[keep])], ["node", "hub"]) if keep.any() else None

        for batch in batches:
            lists = batch.column("shingles")
            values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            for k, (r, node) in enumerate(zip(batch.column("region").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                if r != region:
                    if len(held) > 1 and (out := close()) is not None:
                        yield out
                    held, region = [], r
                held.append((node, values[offsets[k] : offsets[k + 1]].copy()))
        if len(held) > 1 and (out := close()) is not None:
            yield out

    dealt = sets.select("region", "node", "shingles").repartition(partitions, "region").sortWithinPartitions("region")
    return dealt.mapInArrow(run, "node long, hub long")


def components(documents: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(one row for each row of documents: doc_id, n, d1, d2; twins: d1, d2, n, node of the sets of several rows; components: node, component)."""
    p = params
    small_batches(documents.sparkSession)
    found = materialise(signatures(documents, p), "jaccard-signatures")
    classes = found.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"))
    twins = materialise(classes.where("rows > 1").drop("rows"), "jaccard-classes")
    repeats = _repeats(found)
    regions = materialise(_regions(found, twins, p, repeats), "jaccard-members")
    partitions = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    large = _too_large(F.col("size"), F.col("weight"), p)
    whole = lambda x: x.dropDuplicates(["region", "node", "n"]) if repeats else x
    members, number = regions.where(large).agg(F.count(F.lit(1)), F.sum(1 / F.col("size"))).first()  # each of a region's members counts for its share
    if not members:
        links = _leaves(whole(_sets(documents, regions, p)), p, partitions)
    else:
        links, parts = _divided(materialise(whole(_sets(documents, regions.where(large), p)), "jaccard-large"), p, round(number), members)
        links = _leaves(whole(_sets(documents, regions.where(~large), p)).unionByName(parts), p, partitions).unionByName(links)
    return found.drop("first"), twins, connected_components(links)


def _repeats(found: DataFrame) -> bool:
    """Whether some doc_id has several rows."""
    return found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def link(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of documents."""
    rows, twins, found = components(documents, params)
    placed = rows.join(_small(twins), ["d1", "d2", "n"], "left").withColumn("node", F.coalesce("node", F.when(F.col("n") > 0, F.col("doc_id"))))
    placed = placed.join(_small(found), "node", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents: sets of 4-word shingles, similarity 0.85."""
    return link(table(spark, sf_dir, "documents"))


def stage_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of docs (5-word shingles, similarity 0.8) the row with the least doc_id."""
    linked = materialise(link(docs, Params(k=5, percent=80)), "jaccard-linked")
    name = free_name(docs, "gone")
    gone = linked.where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(_small(gone), F.col("doc_id").cast("long") == F.col(name), "left_anti")
    if _repeats(linked):
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))
    return kept


#: Brute force over all pairs that share a shingle; the components by the least reachable id.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p : p + 3], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
r AS (SELECT doc_id, n, h, row_number() OVER (PARTITION BY doc_id ORDER BY f, h) AS k FROM (SELECT *, count(*) OVER (PARTITION BY h) AS f FROM e)),
x AS (SELECT * FROM r WHERE k <= n - ceil(85 * n / 100.0) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * len(list_intersect(sa.g, sb.g)) >= 85 * (len(sa.g) + len(sb.g) - len(list_intersect(sa.g, sb.g)))),
y AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT t.a, y.b FROM t JOIN y ON t.b = y.a)
SELECT s.doc_id, len(g) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM t GROUP BY a) m ON m.a = s.doc_id"""
