"""Benchmark decontamination by winnowing, by DataFrame operations only.

Words are runs of characters other than ASCII punctuation, space and controls, A-Z lower-cased.  Of every `span`
consecutive words the leftmost smallest hash of `k` words is a fingerprint, in documents and items alike, so two texts
that share `span` words share a fingerprint at the same place in them.  Fingerprints of documents meet those of items in
a join; each hit is extended word by word to both sides, and counts where the shared run has `span` words.
An item of fewer words is one window, found by the hash of its whole sequence.

Fingerprints are rows of a few numbers; they are not shuffled while the items' are few enough to broadcast
(`MAX_BROADCAST`, checked), and are shuffled by fingerprint beyond that.  Texts with a hit are read again for
the extension, by a join with the places of the hits; what is shuffled after it is a row a document and a row a hit.

Equality of k words is equality of their 64-bit hash; extension compares words themselves.

Cases: null text has no words; documents and items without words hit nothing; items with a null id are ignored;
equal items count once; repeated documents are answered one by one; an empty benchmark contaminates nothing; other columns,
whatever their names, pass by unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import free_name, materialise, table, text_or_empty
from tempora.llm.quality_rules import bind

SPAN, K = 13, 5
#: Rows of items' fingerprints (about 0.2 kB each) that are broadcast at most.
MAX_BROADCAST = 100_000
#: Rows of contaminated documents (16 bytes each) that are broadcast at most when they are dropped.
MAX_DROPPED = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; the slower form only where another upper-case letter occurs."""
    other = F.octet_length(text) != F.char_length(text)
    return F.when(other & text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def gram_hashes(words: Column, k: int | Column) -> Column:
    """Hashes of all runs of k words, in order; words: a plain column."""
    span = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: span(i)))


def fingerprints(words: Column, span: int = SPAN, k: int = K) -> Column:
    """array<struct<place, h>>: the winnowed hashes of k words with their places; empty below `span` words."""
    width = span - k + 1

    def winnow(hashes: Column) -> Column:
        places = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - width),
            lambda j: bind(F.slice(hashes, j + 1, width), lambda s: (j + F.array_position(s, F.array_min(s)) - 1).cast("int")),
        )
        return F.transform(F.array_distinct(places), lambda p: F.struct(p.alias("place"), F.get(hashes, p).alias("h")))

    none = F.array().cast("array<struct<place:int,h:bigint>>")
    return F.when(F.size(words) < span, none).otherwise(bind(gram_hashes(words, k), winnow))


def _sides(words: Column, place: Column, k: int, reach: int) -> tuple[Column, Column]:
    """Up to `reach` words before a place, nearest first, and after its k words."""
    left = F.reverse(F.slice(words, F.greatest(place - reach, F.lit(0)) + 1, F.greatest(F.least(place, F.lit(reach)), F.lit(0))))
    return left, F.slice(words, place + k + 1, reach)


def _agreeing(a: Column, b: Column, reach: int) -> Column:
    """How many leading elements agree."""
    step = lambda s, i: F.when(s == i, F.when(F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False)), s + 1).otherwise(s)).otherwise(s)
    return F.aggregate(F.sequence(F.lit(0), F.lit(reach - 1)), F.lit(0), step)


def _items(benchmark: DataFrame) -> DataFrame:
    texts = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words_of(text_or_empty("text")).alias("iw"))
    return texts.where(F.size("iw") > 0)


def hits(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(doc_id, text_hash, n_words, item_id, start, end): a row for each shared run found, and one without item for each document."""
    reach, spark = span - k, documents.sparkSession
    items = _items(benchmark)
    long_items = items.where(F.size("iw") >= span).select("item_id", "iw", F.explode_outer(fingerprints(F.col("iw"), span, k)).alias("fp"))
    left, right = _sides(F.col("iw"), F.col("fp.place"), k, reach)
    known = long_items.select("item_id", F.col("fp.h").alias("h"), left.alias("item_left"), right.alias("item_right")).distinct()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    # 1. where fingerprints meet: rows of a few numbers; an item row that every document's mark (place -1) meets keeps
    # documents without hits, in the same pass
    mark = F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("h"))
    printed = rows.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))
    printed = printed.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.concat(F.array(mark), fingerprints(F.col("words"), span, k)).alias("fps"))
    # outer: else the optimiser filters by the size of the array first, and so computes it twice and word by word
    placed = printed.select("doc_id", "text_hash", "n_words", F.explode_outer("fps").alias("fp")).select("doc_id", "text_hash", "n_words", "fp.place", "fp.h")
    hashes = known.select("h").distinct()
    if hashes.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        met = placed.join(F.broadcast(hashes.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("h"))).distinct()), "h")
        met = met.where("h != 0 or place < 0")
    else:
        met = placed.where("place >= 0").join(hashes, "h").unionByName(placed.where("place < 0"), allowMissingColumns=True)
    met = materialise(met, "fingerprints")

    # 2. the documents that have any: the words on both sides of each, compared with the items'
    places = met.where("place >= 0").groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("place")).alias("places"))
    places = materialise(places, "fingerprint-places")
    if places.agg(F.coalesce(F.sum(F.size("places") + 4), F.lit(0))).first()[0] <= MAX_DROPPED:
        places = F.broadcast(places)
    touched = rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "text").join(places, (F.col("__hash") == F.col("text_hash")) & F.col("__id").eqNullSafe(F.col("doc_id")))
    touched = touched.groupBy("doc_id", "text_hash", "n_words", "places").agg(F.first("text").alias("text")) if _repeated(met) else touched
    touched = touched.select("doc_id", "text_hash", "n_words", "places", words_of(F.col("text")).alias("words"))
    words = F.col("words")
    around = lambda at: F.struct(at.alias("place"), F.xxhash64(*[F.get(words, at + j) for j in range(k)]).alias("h"), _sides(words, at, k, reach)[0].alias("left"), _sides(words, at, k, reach)[1].alias("right"))
    sides = touched.select("doc_id", "text_hash", "n_words", F.explode_outer(F.transform("places", around)).alias("fp"))
    sides = sides.select("doc_id", "text_hash", "n_words", "fp.*")
    if known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    run = sides.join(known, "h").withColumn("before", _agreeing(F.col("left"), F.col("item_left"), reach)).withColumn("after", _agreeing(F.col("right"), F.col("item_right"), reach))
    run = run.where(F.col("before") + k + F.col("after") >= span)
    out = run.select("doc_id", "text_hash", "n_words", "item_id", (F.col("place") - F.col("before")).alias("start"), (F.col("place") + k + F.col("after")).alias("end"))
    none = F.lit(None).cast("string").alias("item_id")
    out = out.unionByName(met.where("place < 0").select("doc_id", "text_hash", "n_words", none, F.lit(-1).alias("start"), F.lit(-1).alias("end")))

    # items of fewer words: one pass with the runs of each length that occurs
    short = items.where(F.size("iw") < span)
    lengths = [r["n"] for r in short.select(F.size("iw").alias("n")).distinct().orderBy("n").collect()]  # fewer than `span`
    if lengths:
        own = F.coalesce(*[F.when(F.size("iw") == n, F.get(gram_hashes(F.col("iw"), n), F.lit(0))) for n in lengths])
        whole = short.select("item_id", F.size("iw").alias("length"), own.alias("h")).distinct()
        if whole.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
            whole = F.broadcast(whole)

        def marked(n: int) -> Column:
            return F.transform(gram_hashes(F.col("words"), n), lambda h, i: F.struct(F.lit(n).alias("length"), i.alias("start"), h.alias("h")))

        runs = F.concat(*[marked(n) for n in lengths])
        split = rows.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))
        grams = split.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.explode_outer(runs).alias("run")).select("doc_id", "text_hash", "n_words", "run.*")
        out = out.unionByName(grams.join(whole, ["length", "h"]).select("doc_id", "text_hash", "n_words", "item_id", "start", (F.col("start") + F.col("length")).alias("end")))
    return out


def _repeated(met: DataFrame) -> bool:
    """Whether a (doc_id, text) has several rows."""
    return met.where("place < 0").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, copies, n_words, n_hit, items, contaminated): one row for each distinct (doc_id, text)."""
    real = F.col("item_id").isNotNull()
    grouped = hits(documents, benchmark).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(~real, 1)).alias("copies"),
        F.collect_set(F.when(real, F.struct("start", "end"))).alias("runs"),
        F.collect_set(F.when(real, F.col("item_id"))).alias("items"),
    )
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["last"]))).cast("long").alias("n"), F.greatest(s["last"], x["end"]).cast("int").alias("last"))
    n_hit = F.aggregate(F.array_sort("runs"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last")), step, lambda s: s["n"])
    counted = grouped.select("doc_id", "text_hash", "copies", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the rows that are contaminated."""
    of, digest = free_name(documents, "id"), free_name(documents, "hash")
    bad = contamination(documents, benchmark).where("contaminated").select(F.col("doc_id").alias(of), F.col("text_hash").alias(digest))
    bad = materialise(bad, "contaminated")
    if bad.limit(MAX_DROPPED + 1).count() <= MAX_DROPPED:
        bad = F.broadcast(bad)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(text_or_empty("text")) == F.col(digest))
    return documents.join(bad, same, "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all documents by all benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs without those that benchmark passages contaminate."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2), lambda p: array_to_string(w[p : p + 12], ' '))) AS g FROM i WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p : p + n - 1], ' '))) AS g FROM d, lens WHERE len(w) >= n),
h AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
