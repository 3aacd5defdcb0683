"""Vectorised word hashing over Arrow string batches, for the operators that work in Arrow-batched Python.

Text is handled as UTF-8 bytes.  A word is a maximal run of bytes that are not separators; its 64-bit hash
is a polynomial over per-byte random values, taken from prefix sums, so a whole block of documents is hashed
by a handful of numpy passes and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text is hashed in blocks of about this many bytes; one longer document is a block of its own.
BLOCK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element (a bijection of 64-bit values)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: ASCII white space: space and 0x09 to 0x0D.
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", int(_BASE)), ("down", _inverse(int(_BASE)))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts.  offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, raw, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(raw, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about `size` bytes of text; every row is in one run."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, separators: np.ndarray = WHITESPACE, stem: int = 0) -> tuple[np.ndarray, ...]:
    """Hashes of all words of a block, in order, and word offsets by row (one entry more than rows).

    With `stem`, also the hashes of the words' first `stem` bytes, which never equal those of whole words.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.uint64)
        return (none, np.zeros(len(offsets), np.int64)) + ((none,) if stem else ())
    word = ~separators[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    stops = np.flatnonzero(word & ~after) + 1
    up, down = _power(n)
    values = _BYTE_VALUES[_LOWER[data] if lower else data]
    values *= up
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values, out=sums[1:])
    hashed = mix((sums[stops] - sums[starts]) * down[starts])
    at = np.searchsorted(starts, offsets).astype(np.int64)
    if not stem:
        return hashed, at
    return hashed, at, mix((sums[np.minimum(stops, starts + stem)] - sums[starts]) * down[starts] + _BASE)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, in order, and their offsets by row.

    A row with fewer than k words, but not none, has its whole sequence as one shingle; an empty row has none.
    """
    counts = np.diff(offsets)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_offsets = np.zeros(len(offsets), np.int64)
    np.cumsum(sizes, out=out_offsets[1:])
    factors = mix(np.arange(11, 11 + k, dtype=np.uint64) * _BASE) | _ONE
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), out_offsets
    sums = np.zeros(n, np.uint64)
    for j in range(k):
        sums[: n - j] += words[j:] * factors[j]
    first = np.repeat(offsets[:-1] - out_offsets[:-1], sizes) + np.arange(out_offsets[-1])
    result = sums[first]
    for row in np.flatnonzero((counts > 0) & (counts < k)):  # short rows: their own words only, and their length
        own = words[offsets[row] : offsets[row + 1]]
        result[out_offsets[row]] = np.bitwise_xor.reduce(np.append(own * factors[: len(own)], np.array([len(own)], np.uint64) * _BASE))
    return mix(result), out_offsets
