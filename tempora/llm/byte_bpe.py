"""Byte-level BPE encoding and decoding by a sentencepiece model made directly from a rank file.

The model's pieces are the vocabulary's byte strings, each byte mapped to a printable character, scored by the negative
rank, under identity normalisation; nothing is trained.  A text is split by the pattern; each match, byte-mapped, is
encoded by itself; the piece that a whole match is comes first, as in rank-based encoders.  Decoding maps ids back to
bytes.  Workers keep a bounded cache of matches.

Cases: null text is the empty text, with no ids; any valid text round-trips; repeated rows give equal results; an
empty table gives an empty result; other columns, whatever their names, pass through `encode` and `decode` unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from tempora.llm.common import append_columns, small_batches, table, text_or_empty

#: Matches kept by a worker before its cache is emptied.
CACHE = 50_000


def byte_characters() -> list[str]:
    """A printable character for every byte: its own where printable and not a space, else one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0
    for b in range(256):
        out.append(chr(b) if b in printable else chr(256 + more))
        more += b not in printable
    return out


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for text, rank in pairs:
        out[int(rank)] = base64.b64decode(text)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value % (1 << 64))


def serialise(ranks: list[bytes]) -> bytes:
    """A sentencepiece model: piece 0 is unknown, piece r + 1 has rank r."""
    chars = byte_characters()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(chars[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, 1) for rank, piece in enumerate(ranks)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)  # BPE; no other special ids
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # nothing added, removed or escaped
    return b"".join(_field(1, x) for x in pieces) + _field(2, trainer) + _field(3, normaliser)


def unicode_classes(pattern: str) -> str:
    """The pattern with white space named as the Unicode property, which \\s alone does not mean exactly here."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def latin_classes(pattern: str) -> str:
    """The pattern for the standard matcher over texts of the first 256 code points: classes spelt out as ranges."""
    import regex

    def members(name: str) -> str:
        runs = regex.findall(rf"(?:\p{{{name}}})+", "".join(map(chr, range(256))))
        return "".join(re.escape(x[0]) + ("-" + re.escape(x[-1]) if len(x) > 1 else "") for x in runs)

    letters, numbers, spaces = members("L"), members("N"), members("White_Space")
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    return pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")


class Codec:
    """Encodes and decodes texts; one to a worker process."""

    def __init__(self, ranks: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = ranks
        self.known = {piece: rank for rank, piece in enumerate(ranks)}
        self.map = {b: c for b, c in enumerate(byte_characters())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(unicode_classes(pattern))
        self.split_latin = re.compile(latin_classes(pattern))
        self.cache: dict[str, tuple[str, int, bytes, list[int]]] = {}

    def _entry(self, match: str) -> tuple[str, int, bytes, list[int]]:
        raw = match.encode()
        whole = self.known.get(raw)
        ids = [whole] if whole is not None else [x - 1 for x in self.model.encode(raw.decode("latin-1").translate(self.map), out_type=int)]
        if len(self.cache) >= CACHE:
            self.cache.clear()
        entry = self.cache[match] = (",".join(map(str, ids)), len(ids), self.decode(ids), ids)
        return entry

    def _entries(self, text: str) -> list[tuple[str, int, bytes, list[int]]]:
        get, make = self.cache.get, self._entry
        try:
            text.encode("latin-1")
            split = self.split_latin  # the same matches, found faster
        except UnicodeEncodeError:
            split = self.split
        return [get(x) or make(x) for x in split.findall(text)]

    def encode(self, text: str) -> list[int]:
        return [i for entry in self._entries(text) for i in entry[3]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and sha256 of the ids and of the bytes that they decode to, match by match."""
        entries = self._entries(text)
        ids = hashlib.sha256(",".join([e[0] for e in entries]).encode()).hexdigest()
        return sum([e[1] for e in entries]), ids, hashlib.sha256(b"".join([e[2] for e in entries])).hexdigest()


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[list[bytes], bytes, str]:
    """Pieces, model and pattern; by default those of the public multilingual rank file."""
    import public_tokenizers

    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, serialise(ranks), pattern or public_tokenizers.PATTERN


_codecs: dict[tuple, Codec] = {}


def _codec(ranks: list[bytes], model: bytes, pattern: str) -> Codec:
    """The codec of this worker process, made for its first task."""
    key = (len(ranks), zlib.crc32(model), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, model, pattern)
    return _codecs[key]


IDS = ArrayType(IntegerType())


def encode(documents: DataFrame, path: str | None = None, column: str = "text", to: str = "token_ids") -> DataFrame:
    """documents with the ids of a text column, array<int>; a column named `to` is replaced."""
    documents = documents.drop(to)
    at = documents.columns.index(column)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(path))  # a vocabulary file's size

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(*shared.value)
        return [pa.array([codec.encode(x or "") for x in batch.column(at).to_pylist()], pa.list_(pa.int32()))]

    return append_columns(documents, run, {to: IDS})


def decode(tokens: DataFrame, path: str | None = None, column: str = "token_ids", to: str = "decoded") -> DataFrame:
    """tokens with the text that an id column stands for; a null array is null; a column named `to` is replaced."""
    tokens = tokens.drop(to)
    at = tokens.columns.index(column)
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        pieces = shared.value[0]
        return [pa.array([None if ids is None else b"".join([pieces[i] for i in ids]).decode("utf-8", "replace") for ids in batch.column(at).to_pylist()], pa.string())]

    return append_columns(tokens, run, {to: StringType()})


def round_trip(documents: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """documents with token_ids and the text decoded from them, by one worker a task; columns of these names are replaced."""
    documents = documents.drop("token_ids", "decoded")
    at = documents.columns.index(column)
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(*shared.value)
        ids = [codec.encode(x or "") for x in batch.column(at).to_pylist()]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x).decode("utf-8", "replace") for x in ids], pa.string())]

    return append_columns(documents, run, {"token_ids": IDS, "decoded": StringType()})


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    shared = spark.sparkContext.broadcast(vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            found = [codec.digest(x) for x in batch.column("text").to_pylist()]
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs with token_ids, their number, and the text decoded from them."""
    return round_trip(docs).withColumn("n_tokens", F.size("token_ids").cast("long"))
