"""Toxicity: two class-conditional Kneser-Ney models, compared by length-normalised log-likelihood.

A text is a sequence of words (ASCII letters lower-cased, ASCII characters but letters and digits separate).
Each class, toxic and ordinary, has an interpolated bigram model with absolute discounts:

    P(w | v) = max(N(v, w) - D(v), 0) / C(v) + left(v) * P(w)          counts of pairs, backed off to
    P(w)     = max(K(w) - d, 0) / K + left * P(stem) * Shared(w | stem)    continuation counts, backed off to
    P(stem)  = max(S(stem) - d, 0) / K + left' * Shared(stem)              those of stems, backed off to shared ones

K(w) counts the predecessors of w, once a document each; a stem is a word's first four bytes; `left` is what the discounts
take, so that each level sums to 1.  The Shared counts are those of both classes together, discounted in the same way,
so what is rare is smoothed by counts that both classes share, and says as little as it should.  A discount is `discount`
(or, of pairs, `discount_pair`) in the smaller class and grows with the class (of pairs, with the class's
count of the context), so that both classes lose like shares.

All pairs are counted.  C(v) counts v where a word follows; a text's first word has P(w), and so has a word after a context
that one of the classes has not seen.

A text's value is the mean over its words of log P1 - log P0, less the mean of the middle eight tenths of them, which is the
language and style of the text, as far as ordinary texts have such means, so that a text whose words are mostly toxic
keeps its ratio.  Such a value is taken of P(w) and, as what it adds, of P(w | v), since the ratios of pairs are noisier.
The score is a logistic function of both values and of the same times the root of the number of words, by which a mean
over more words is surer.  It is fitted on a bounded number of labelled rows held out of the counts; then these are
counted as well, so that every labelled training row is in the counts that score.

Counts are rows of tables in the shared folder, keyed by full 64-bit hashes of words, so they grow with the corpus.
Those and all tables on the way to the ratios are deleted when the ratios are there, the shuffle files of each when it is written.
What differs from the shared level is rated.  Up to MAX_BROADCAST of these ratios are broadcast, checked; beyond that
the words of the texts are joined with them by shuffles, with the same scores.

Cases: null text is the empty text; texts without words have value 0 and get the score of that; a very long text is scored whole, in one
row; repeated rows get equal scores; an empty table gives an empty result; without labelled rows of both classes every
score is 0.5; other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import discard, labelled, materialise, one_label, remainder, small_batches, table, text_or_empty
from tempora.llm.hashing import _BASE, blocks, mix, string_buffers, word_hashes

#: ASCII characters but letters and digits separate words; bytes of other characters belong to them.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes of text that are hashed at once, at about 40 bytes of a worker's memory each.
BLOCK = 1 << 20
#: Ratios (16 bytes each) that are broadcast at most.
MAX_BROADCAST = 4_000_000
#: They are packed in so many parts, in packs of about so many.
PARTS, PACKED = 8, 1 << 18
#: Kinds of ratios: of (context, word), of (0, word), of (0, stem), of a context's other words, and of words of unknown stems.
PAIR, WORD, STEM, CONTEXT, REST = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class Params:
    """discount, discount_pair: absolute discounts in the smaller class; trim: share of a text's word ratios left out of its middle
    at each end; calibrate: 1 of so many training rows is held out to fit the logistic function before it is counted;
    max_calibration: rows that fit it at most."""

    discount: float = 5
    discount_pair: float = 0.75
    trim: int = 10
    calibrate: int = 2
    max_calibration: int = 20000
    threshold: float = 0.7


@dataclass
class Stream:
    """Words of a block of rows: the row, the word, its stem and its predecessor (a start mark for a row's first)."""

    row: np.ndarray
    word: np.ndarray
    stem: np.ndarray
    before: np.ndarray
    n_rows: int


def stream(data: np.ndarray, offsets: np.ndarray) -> Stream:
    words, at, stems = word_hashes(data, offsets, separators=SEPARATORS, stem=4)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[at[:-1][at[:-1] < len(words)]] = _BASE
    return Stream(np.repeat(np.arange(len(at) - 1), np.diff(at)), words, stems, before, len(at) - 1)


def _pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + word)


#: Counts by class of all rows and of those that are held out: continuations or pairs, and occurrences with a word after them.
CLASSES, CONTEXTS = ("n0", "n1", "h0", "h1"), ("c0", "c1", "g0", "g1")


def _by_class(group: np.ndarray, size: int, label: np.ndarray, held: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.bincount(group[(label == k) & some], minlength=size).astype(np.int32)) for some in (np.ones(len(held), bool), held) for k in (0, 1)]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Stream, np.ndarray, np.ndarray]]:
    """(words, label and held of each word) of each block of rows that has words."""
    for batch in batches:
        data, offsets = string_buffers(batch.column("text"))
        labels, held = np.asarray(batch.column("label")), batch.column("held").to_numpy(zero_copy_only=False)
        for i, j in blocks(offsets, BLOCK):
            x = stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if len(x.word):
                yield x, labels[i:j][x.row], held[i:j][x.row]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x, label, held in _streams(batches):
        words, first, group = np.unique(x.word, return_index=True, return_inverse=True)
        once = np.unique(mix(_pair_hash(x.before, x.word) + x.row.astype(np.uint64) * _BASE), return_index=True)[1]
        later = np.flatnonzero(x.before != _BASE)
        counts = _by_class(group[once], len(words), label[once], held[once]) + _by_class(group[later - 1], len(words), label[later], held[later])
        yield pa.RecordBatch.from_arrays([pa.array(x.stem[first].view(np.int64)), pa.array(words.view(np.int64)), *counts], ["a", "b", *CLASSES, *CONTEXTS])


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x, label, held in _streams(batches):
        at = np.flatnonzero(x.before != _BASE)
        _, first, group = np.unique(_pair_hash(x.before[at], x.word[at]), return_index=True, return_inverse=True)
        if len(first):
            first = at[first]
            yield pa.RecordBatch.from_arrays([pa.array(x.before[first].view(np.int64)), pa.array(x.word[first].view(np.int64)), *_by_class(group, len(first), label[at], held[at])], ["a", "b", *CLASSES])


def count(rows: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(words: a stem, b word, CLASSES, CONTEXTS; pairs: a context, b word, CLASSES) of rows (text, label, held if there is such)."""
    small_batches(rows.sparkSession)
    rows = rows.select("text", "label", (F.col("held") if "held" in rows.columns else F.lit(False)).alias("held"))
    counted = rows.mapInArrow(_count_words, "a long, b long, " + ", ".join(f"{c} int" for c in CLASSES + CONTEXTS))
    words = materialise(counted.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in CLASSES + CONTEXTS]), "toxicity-words", free=True)
    pairs = rows.mapInArrow(_count_pairs, "a long, b long, " + ", ".join(f"{c} int" for c in CLASSES))
    return words, materialise(pairs.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in CLASSES]), "toxicity-pairs", free=True)


def without_held(counts: DataFrame) -> DataFrame:
    """counts of the rows that are not held out."""
    less = [(F.col(x) - F.col(y)).alias(x) for x, y in (("n0", "h0"), ("n1", "h1"), ("c0", "g0"), ("c1", "g1")) if x in counts.columns]
    return counts.select("a", "b", *less).where("n0 + n1 > 0")


def ratios(words: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """(kind, a, b, ratio): log-likelihood ratios of toxic to ordinary where they are not those of the level below."""
    spark, schema = words.sparkSession, "kind int, a long, b long, ratio double"
    n = words.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in "01"]).first()
    total, everything = (n["n0"], n["n1"]), n["n0"] + n["n1"]
    if not min(total):
        return materialise(spark.createDataFrame([(REST, 0, 0, 0.0)], schema), "toxicity-ratios", free=True)
    d = [p.discount * x / min(total) for x in total]
    both = F.col("n0") + F.col("n1")
    over = lambda k: F.greatest(F.col(f"n{k}") - d[k], F.lit(0.0)) / total[k]
    left = [(F.sum(F.least(F.col(f"n{k}").cast("double"), F.lit(d[k]))) / total[k]).alias(f"l{k}") for k in (0, 1)]
    taken = F.sum(F.least(both.cast("double"), F.lit(float(p.discount))))
    by_stem = materialise(words.groupBy("a").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("types"), taken.alias("taken")), "toxicity-stems", free=True)
    word_left, stem_left = words.agg(*left).first(), by_stem.agg(*left, taken.alias("taken"), F.count(F.lit(1)).alias("types")).first()
    shared = F.greatest(both - p.discount, F.lit(0.0)) / everything + stem_left["taken"] / everything / (stem_left["types"] + 1)
    stems = by_stem.select("a", *[(over(k) + stem_left[f"l{k}"] * shared).alias(f"s{k}") for k in (0, 1)], both.alias("of"), "types", "taken", ((F.col("n0") > d[0]) | (F.col("n1") > d[1])).alias("known"))

    own = (F.col("n0") > d[0]) | (F.col("n1") > d[1])
    wanted = words.where(own | (F.greatest("n0", "n1", "c0", "c1") > p.discount_pair)).join(stems, "a")
    within = F.greatest(both - p.discount, F.lit(0.0)) / F.col("of") + F.col("taken") / F.col("of") / (F.col("types") + 1)
    rated = materialise(wanted.select("b", own.alias("own"), "c0", "c1", *[(over(k) + word_left[f"l{k}"] * F.col(f"s{k}") * within).alias(f"p{k}") for k in (0, 1)]), "toxicity-rated", free=True)

    contexts = rated.where(F.least("c0", "c1") > p.discount_pair).select(F.col("b").alias("a"), "c0", "c1")
    heavy = pairs.join(contexts, "a")
    cut = lambda k: F.greatest(F.col(f"n{k}") - p.discount_pair * F.col(f"c{k}") / F.least("c0", "c1"), F.lit(0.0)) / F.col(f"c{k}")
    heavy = materialise(heavy.select("a", "b", cut(0).alias("o0"), cut(1).alias("o1")).where("o0 > 0 or o1 > 0"), "toxicity-heavy", free=True)
    leftover = heavy.groupBy("a").agg((1 - F.sum("o0")).alias("l0"), (1 - F.sum("o1")).alias("l1"))
    found = heavy.join(leftover, "a").join(rated.select("b", "p0", "p1"), "b")
    of = lambda kind, df, a, b, ratio: df.select(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), ratio.alias("ratio"))
    none, word_rest = F.lit(0), float(np.log(word_left["l1"] / word_left["l0"]))
    pair = F.log((F.col("o1") + F.col("l1") * F.col("p1")) / (F.col("o0") + F.col("l0") * F.col("p0")))
    out = of(PAIR, found, F.col("a"), F.col("b"), pair).unionByName(of(WORD, rated.where("own"), none, F.col("b"), F.log(F.col("p1") / F.col("p0"))))
    out = out.unionByName(of(STEM, stems.where("known"), none, F.col("a"), F.log(F.col("s1") / F.col("s0")) + word_rest)).unionByName(of(CONTEXT, leftover, none, F.col("a"), F.log(F.col("l1") / F.col("l0"))))
    rest = spark.createDataFrame([(REST, 0, 0, word_rest + float(np.log(stem_left["l1"] / stem_left["l0"])))], schema)
    out = materialise(out.unionByName(rest), "toxicity-ratios", free=True)
    for done in (by_stem, rated, heavy):
        discard(done)
    return out


class Lookup:
    """Values by 64-bit key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        """The keys ascend."""
        self.keys, self.values = keys, values

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, NaN where a key is not there."""
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.nan)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ratios as bytes, 16 each, by kind and the top four bits of the key."""
    some: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        some += [batch] if batch is not None and batch.num_rows else []
        if not some or batch is not None and sum(x.num_rows for x in some) < PACKED:
            continue
        kind, a, b, ratio = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in some]) for c in ("kind", "a", "b", "ratio"))
        some, a, b = [], a.view(np.uint64), b.view(np.uint64)
        keys = np.where(kind == PAIR, _pair_hash(a, b), b)
        packs, group = np.unique(kind * 16 + (keys >> np.uint64(60)).astype(np.int32), return_inverse=True)
        rows = [(int(pack) // 16, int(pack) % 16, keys[group == k].tobytes(), ratio[group == k].tobytes()) for k, pack in enumerate(packs)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "top", "keys", "ratios"])


def _lookups(rated: DataFrame) -> dict[int, Lookup] | None:
    """Ratios by kind where they are few enough to broadcast.  They come to the driver packed and a part at a time, and are
    sorted a sixteenth at a time, so that it holds little more than what it broadcasts."""
    size = {r["kind"]: r["count"] for r in rated.groupBy("kind").count().collect()}
    if sum(size.values()) > MAX_BROADCAST:
        return None
    packs: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
    for r in rated.coalesce(PARTS).mapInArrow(_pack, "kind int, top int, keys binary, ratios binary").toLocalIterator():
        packs.setdefault((r["kind"], r["top"]), []).append((bytes(r["keys"]), bytes(r["ratios"])))
    found = {}
    for kind in (PAIR, WORD, STEM, CONTEXT, REST):
        n, at = size.get(kind, 0), 0
        found[kind] = Lookup(np.empty(n, np.uint64), np.empty(n))
        for top in range(16):
            keys, values = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*packs.pop((kind, top), [(b"", b"")]), strict=True), (np.uint64, float), strict=True))
            order, to = np.argsort(keys), slice(at, at + len(keys))
            found[kind].keys[to], found[kind].values[to], at = keys[order], values[order], to.stop
    return found


def _word_ratios(x: Stream, found: dict[int, Lookup]) -> tuple[np.ndarray, np.ndarray]:
    """The words' ratios after their predecessors, and by themselves."""
    ratio = found[WORD].get(x.word)
    rest = np.flatnonzero(np.isnan(ratio))
    by_stem = found[STEM].get(x.stem[rest])
    ratio[rest] = np.where(np.isnan(by_stem), found[REST].values[0], by_stem)
    pair = found[PAIR].get(_pair_hash(x.before, x.word))
    return np.where(np.isnan(pair), ratio + np.nan_to_num(found[CONTEXT].get(x.before)), pair), ratio


#: What measure finds of a text: the mean of its words' ratios and that of the middle ones, and both of the words by themselves.
MEASURES = ("mean", "middle", "word_mean", "word_middle")


def measure(rows: DataFrame, rated: DataFrame, trim: int = Params.trim) -> DataFrame:
    """rows with, in place of text, its number of words n and MEASURES."""
    small_batches(rows.sparkSession)
    found, others = _lookups(rated), [c for c in rows.columns if c != "text"]
    if found is None:
        return _measure_by_join(rows, rated, trim)
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for i, j in blocks(offsets, BLOCK):
                x = stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n, means = np.bincount(x.row, minlength=x.n_rows), []
                ends, cut = np.cumsum(n), n // trim
                for ratio in _word_ratios(x, shared.value):
                    means.append(np.bincount(x.row, weights=ratio, minlength=x.n_rows) / np.maximum(n, 1))
                    sums = np.append(0.0, np.cumsum(ratio[np.lexsort((ratio, x.row))]))
                    means.append((sums[ends - cut] - sums[ends - n + cut]) / np.maximum(n - 2 * cut, 1))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in others], pa.array(n.astype(np.int64)), *map(pa.array, means)], [*others, "n", *MEASURES])

    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others) + ", n long, " + ", ".join(f"{c} double" for c in MEASURES))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_buffers(batch.column("text"))
        texts = np.asarray(batch.column("h"))
        for i, j in blocks(offsets):
            x = stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([pa.array(texts[i:j][x.row]), *[pa.array(v.view(np.int64)) for v in (x.before, x.word, x.stem)]], ["h", "before", "word", "stem"])


def _measure_by_join(rows: DataFrame, rated: DataFrame, trim: int) -> DataFrame:
    """measure, by shuffles: different pairs of words meet their ratios, then each text's words those."""
    texts = rows.withColumn("h", F.xxhash64("text"))
    words = texts.select("h", "text").mapInArrow(_words, "h long, before long, word long, stem long")
    different = words.select("before", "word", "stem").distinct()
    for k, keys in ((PAIR, {"a": "before", "b": "word"}), (WORD, {"b": "word"}), (STEM, {"b": "stem"}), (CONTEXT, {"b": "before"})):
        different = different.join(rated.where(F.col("kind") == k).select(*[F.col(c).alias(to) for c, to in keys.items()], F.col("ratio").alias(f"r{k}")), list(keys.values()), "left")
    rest = rated.where(F.col("kind") == REST).first()["ratio"]
    alone = F.coalesce("r1", "r2", F.lit(rest))
    rating = different.select("before", "word", F.coalesce("r0", alone + F.coalesce("r3", F.lit(0.0))).alias("ratio"), alone.alias("alone"))
    listed = words.select("h", "before", "word").join(rating, ["before", "word"]).groupBy("h").agg(F.array_sort(F.collect_list("ratio")).alias("list"), F.array_sort(F.collect_list("alone")).alias("words"))
    copies = texts.groupBy("h").agg(F.count(F.lit(1)).alias("copies"))  # a text's words come once a copy, which changes no mean
    size = F.size("list")
    cut = (F.floor(size / F.col("copies") / trim) * F.col("copies")).cast("int")
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    means = [m for xs in ("list", "words") for m in (mean(F.col(xs)), mean(F.slice(xs, cut + 1, size - 2 * cut)))]
    one = listed.join(copies, "h").select("h", (size / F.col("copies")).cast("long").alias("n"), *[m.alias(c) for m, c in zip(means, MEASURES, strict=True)])
    return texts.drop("text").join(one, "h", "left").drop("h").fillna({"n": 0, **dict.fromkeys(MEASURES, 0.0)})


def ordinary_middles(n: np.ndarray, middle: np.ndarray) -> tuple[float, float]:
    """The range of middles of ordinary texts, but for the texts with the lowest and the highest 1% of all words: what
    language and style explain.  Texts weigh by words, as the middle of a few says little of a language."""
    order = np.argsort(middle)
    below = np.cumsum(n[order])
    if not len(below) or not below[-1]:
        return 0.0, 0.0
    return tuple(float(middle[order[np.searchsorted(below, share * below[-1])]]) for share in (0.01, 0.99))


@dataclass
class Model:
    """The ratios, and the logistic function of what they say of a text."""

    rated: DataFrame
    trim: int = Params.trim
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(4))
    shift: float = 0.0
    ranges: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def probability(self) -> Column:
        """The score from n and MEASURES."""
        pair, word = (F.when(F.col("n") > 0, F.col(mean) - F.greatest(F.least(F.col(middle), F.lit(float(high))), F.lit(float(low)))).otherwise(0.0) for mean, middle, (low, high) in zip(MEASURES[::2], MEASURES[1::2], self.ranges, strict=True))
        value = F.lit(float(self.shift))
        for k, ratio in enumerate((word, pair - word)):
            value += ratio * float(self.slopes[2 * k]) + ratio * F.sqrt("n") * float(self.slopes[2 * k + 1])
        return 1.0 / (1.0 + F.exp(-F.greatest(F.least(value, F.lit(40.0)), F.lit(-40.0))))

    def calibrate(self, n: np.ndarray, mean: np.ndarray, middle: np.ndarray, word_mean: np.ndarray, word_middle: np.ndarray, labels: np.ndarray) -> None:
        """Fit the logistic function by Newton steps with a weak penalty; both classes must occur."""
        if len(labels) == 0 or labels.min() == labels.max():
            return
        levels = ((mean, middle), (word_mean, word_middle))
        self.ranges = tuple(ordinary_middles(n[labels == 0], inner[labels == 0]) for _, inner in levels)
        pair, word = (np.where(n > 0, whole - np.clip(inner, low, high), 0.0) for (whole, inner), (low, high) in zip(levels, self.ranges, strict=True))
        ratios = np.stack([word, word * np.sqrt(n), pair - word, (pair - word) * np.sqrt(n)], axis=1)
        mean, spread = ratios.mean(axis=0), np.maximum(ratios.std(axis=0), 1e-9)
        x = np.column_stack([(ratios - mean) / spread, np.ones(len(ratios))])
        w, penalty = np.zeros(5), np.array([1e-2] * 4 + [1e-6])
        for _ in range(60):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            w += np.clip(np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (labels - q) - penalty * w), -4, 4)
        self.slopes, self.shift = w[:4] / spread, w[4] - float((w[:4] * mean / spread).sum())


def fit(documents: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Fit on documents (doc_id, text) whose doc_id has a row in labels (doc_id, label 0 or 1)."""
    p = params
    rows = labelled(documents, labels).withColumn("held", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(p.calibrate)) == 0)
    words, pairs = count(rows, p)
    others = ratios(without_held(words), without_held(pairs), p)
    held = measure(rows.where("held").select("text", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id", F.lit(1)).alias("at")), others, p.trim)
    pdf = held.orderBy("at", "n", *MEASURES, "label").limit(p.max_calibration).toPandas()
    discard(others)
    model = Model(ratios(words, pairs, p), p.trim)
    for done in (words, pairs):
        discard(done)
    model.calibrate(*(pdf[c].to_numpy(float) for c in ("n", *MEASURES, "label")))
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): one row for each row of documents."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return measure(rows, model.rated, model.trim).select("doc_id", model.probability().alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels are learnt from rows whose crc32(doc_id) mod 3 is not 1."""
    params = Params()
    documents = table(spark, sf_dir, "documents")
    labels = one_label(table(spark, sf_dir, "labels"), "toxic").where(remainder("doc_id", 3) != 1)
    scored = score(documents, fit(documents, labels, params))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))
