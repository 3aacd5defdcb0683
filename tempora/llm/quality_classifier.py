"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed features, in three groups of equal weight: words,
pairs of neighbouring words, and character trigrams of words with their edges (case kept).  A pair is hashed by the
difference of its words' hashes, so that all pairs of equal words share one feature.  A softmax layer over two
classes gives the score.  The vectors and the layer are trained on the driver by plain numpy stochastic
gradient descent on a bounded sample of labelled rows (`max_rows`); scoring is a map over Arrow batches with the
model, whose size is fixed by the parameters, as a broadcast.

Cases: null text is the empty text; a text without words or trigrams has no features and gets the score of the
softmax layer's bias; repeated rows get equal scores; an empty table gives an empty result; without labelled
rows, or with rows of one class only, every score is 0.5 or that class's share; other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tempora.llm.common import append_columns, free_name, one_label, remainder, small_batches, table, text_or_empty
from tempora.llm.hashing import _BASE, WHITESPACE, blocks, mix, string_buffers, word_hashes


@dataclass(frozen=True)
class Params:
    """bits: log2 of the buckets of each feature group; max_rows: bound of the training sample, half of it for each class."""

    bits: int = 14
    dim: int = 8
    max_rows: int = 3000
    epochs: int = 6
    batch: int = 16
    rate: float = 100.0
    seed: int = 7
    threshold: float = 0.7


def _group(rows: np.ndarray, keys: np.ndarray, n_rows: int, group: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) with weights; the weights of a row sum to 1/3."""
    size = 1 << bits
    code = rows.astype(np.int64) * size + (keys >> np.uint64(64 - bits)).astype(np.int64)
    code, counts = np.unique(code, return_counts=True)
    row = code >> bits
    total = np.bincount(rows, minlength=n_rows)
    return row, (code & (size - 1)) + group * size, (counts / (3.0 * total[row])).astype(np.float32)


_FACTORS = mix(np.arange(1, 4, dtype=np.uint64) * _BASE) | np.uint64(1)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the character trigrams of a block's words; a blank stands for each end of a word within its text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = (data & 0xC0) != 0x80  # bytes that begin a character
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, len(data)))
    character = np.where(WHITESPACE[data[at]], np.uint8(32), data[at]).astype(np.uint64)
    for k in range(1, 4):
        more = np.flatnonzero(length > k)
        character[more] |= data[at[more] + k].astype(np.uint64) << np.uint64(8 * k)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = (row[2:] == row[:-2]) & (character[1:-1] != 32)
    hashed = mix((character[:-2] * _FACTORS[0] + character[1:-1] * _FACTORS[1] + character[2:] * _FACTORS[2])[inside])
    return row[2:][inside], hashed


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of a block of texts, sorted by row."""
    n_rows = len(offsets) - 1
    words, at = word_hashes(data, offsets, lower=False)
    rows = np.repeat(np.arange(n_rows), np.diff(at))
    same = rows[1:] == rows[:-1] if len(rows) else np.zeros(0, bool)
    pairs = mix((words[1:] - words[:-1])[same]) if len(words) else words
    parts = [_group(rows, words, n_rows, 0, bits), _group(rows[1:][same], pairs, n_rows, 1, bits)]
    parts.append(_group(*trigrams(data, offsets), n_rows, 2, bits))
    row, bucket, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order], weight[order]


@dataclass
class Model:
    """Vectors of all buckets, the softmax layer, and the bits of the buckets."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    bits: int

    def scores(self, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
        """Probability of label 1, by row."""
        slope = self.vectors @ (self.layer[:, 1] - self.layer[:, 0])  # the average commutes with the layer
        margin = np.bincount(row, weights=slope[bucket] * weight, minlength=n_rows) + float(self.bias[1] - self.bias[0])
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], p: Params) -> Model:
    """Stochastic gradient descent over (buckets, weights, label); deterministic for a given order of samples."""
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1.0 / p.dim, 1.0 / p.dim, (3 << p.bits, p.dim)).astype(np.float32)
    layer, bias = np.zeros((p.dim, 2), np.float32), np.zeros(2, np.float32)
    labels = np.array([y for _, _, y in samples], np.int64)
    if len(samples) == 0 or labels.min() == labels.max():
        share = 0.5 if len(samples) == 0 else min(max(float(labels.mean()), 0.01), 0.99)
        return Model(vectors, layer, np.array([0.0, np.log(share / (1 - share))], np.float32), p.bits)
    steps = p.epochs * -(-len(samples) // p.batch)
    step = 0
    for _ in range(p.epochs):
        order = rng.permutation(len(samples))
        for start in range(0, len(order), p.batch):
            batch = order[start : start + p.batch]
            rate = p.rate * (1 - step / steps)
            step += 1
            buckets = np.concatenate([samples[i][0] for i in batch])
            weights = np.concatenate([samples[i][1] for i in batch])
            rows = np.repeat(np.arange(len(batch)), [len(samples[i][0]) for i in batch])
            used, place = np.unique(buckets, return_inverse=True)
            dense = np.zeros((len(batch), len(used)), np.float32)
            dense[rows, place] = weights
            hidden = dense @ vectors[used]
            logits = hidden @ layer + bias
            logits -= logits.max(axis=1, keepdims=True)
            error = np.exp(logits)
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), labels[batch]] -= 1.0
            error /= len(batch)
            back = error @ layer.T
            layer -= 0.02 * rate * (hidden.T @ error)
            bias -= 0.02 * rate * error.sum(axis=0)
            vectors[used] -= rate * (dense.T @ back)
    return Model(vectors, layer, bias, p.bits)


def _sample(documents: DataFrame, labels: DataFrame, p: Params) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of up to max_rows / 2 labelled rows of each class, chosen by a hash of doc_id, in order of doc_id."""
    order = F.xxhash64("doc_id", F.lit(p.seed))
    chosen = None
    for y in (0, 1):
        part = labels.where(F.col("label") == y).orderBy(order, "doc_id").limit(p.max_rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))  # at most max_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for i, j in blocks(offsets):
                row, bucket, weight = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.bits)
                at = np.searchsorted(row, np.arange(j - i + 1))
                bucket = bucket.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), pa.array([bucket[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary()), pa.array([weight[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())],
                    ["doc_id", "label", "bucket", "weight"],
                )

    found = rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, bucket binary, weight binary").toArrow()
    found = found.sort_by("doc_id")
    return [(np.frombuffer(b.as_buffer(), np.int32), np.frombuffer(w.as_buffer(), np.float32), y.as_py()) for y, b, w in zip(found["label"], found["bucket"], found["weight"], strict=True)]


def fit(documents: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Train on documents (doc_id, text) with a row in labels (doc_id, label 0 or 1), a bounded sample of them."""
    small_batches(documents.sparkSession)
    samples = _sample(documents, labels, params)
    model = train(samples, params)
    # the sample has as many rows of each class as there are, up to half of it; the bias takes the classes' shares of all labelled
    # rows, so that a score means the same whatever the input's size
    n = labels.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).first()
    drawn = sum(y for _, _, y in samples)
    if 0 < drawn < len(samples):
        model.bias[1] += np.log(n["n1"] / n["n0"]) - np.log(drawn / (len(samples) - drawn))
    return model


def score_block(data: np.ndarray, offsets: np.ndarray, slope: np.ndarray, shift: float, bits: int) -> np.ndarray:
    """Probabilities of label 1 of a block; slope is the vectors' product with the layer, so features are only added."""
    n_rows, size, keep = len(offsets) - 1, 1 << bits, np.uint64(64 - bits)
    margin = np.full(n_rows, shift)

    def add(rows: np.ndarray, keys: np.ndarray, group: int) -> None:
        total = np.maximum(np.bincount(rows, minlength=n_rows), 1)
        margin[:] += np.bincount(rows, weights=slope[group * size : (group + 1) * size][(keys >> keep).astype(np.int64)], minlength=n_rows) / (3.0 * total)

    words, at = word_hashes(data, offsets, lower=False)
    rows = np.repeat(np.arange(n_rows), np.diff(at))
    if len(words):
        same = rows[1:] == rows[:-1]
        add(rows, words, 0)
        add(rows[1:][same], mix((words[1:] - words[:-1])[same]), 1)
    add(*trigrams(data, offsets), 2)
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def score(documents: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """(all columns of documents, `to`): the probability of label 1 of each row's whole text; `to` must not be a column yet."""
    if free_name(documents, to) != to:
        raise ValueError(f"documents have a column {to} already")
    at = documents.columns.index("text")
    slope = (model.vectors @ (model.layer[:, 1] - model.layer[:, 0])).astype(np.float64)
    shift, bits = float(model.bias[1] - model.bias[0]), model.bits
    shared = documents.sparkSession.sparkContext.broadcast(slope)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = string_buffers(batch.column(at))  # null is empty there
        parts = [score_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value, shift, bits) for i, j in blocks(offsets)]
        return [pa.array(np.concatenate(parts) if parts else np.zeros(0))]

    return append_columns(documents, run, {to: DoubleType()})


def _training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_label(table(spark, sf_dir, "labels"), "quality").where(remainder("doc_id", 4) != 2)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; labels are learnt from rows whose crc32(doc_id) mod 4 is not 2."""
    params = Params()
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(documents.select("doc_id", "text"), fit(documents, _training_labels(spark, sf_dir), params))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: keep the rows of docs that the classifier, fitted on the labelled rows of docs, accepts."""
    params = Params()
    model = fit(docs, _training_labels(spark, sf_dir), params)
    name = free_name(docs, "score")
    return score(docs, model, name).where(F.col(name) >= params.threshold).drop(name)
