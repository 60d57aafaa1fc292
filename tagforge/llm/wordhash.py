"""Whole-batch word splitting and hashing with numpy, shared by the word-based operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text; nulls are
empty texts.  Everything works on the concatenated bytes of a batch of documents, so the cost
is a few vector passes a byte and no Python call per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; bounds the vectors to about 100 times this.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection of 64-bit values that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_odd(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    start = (seed * 0x9E3779B97F4A7C15) % (1 << 64)
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(start)) | U64(1)


_BY_PLACE = random_odd(256, 11)


def _by_place(n: int) -> np.ndarray:
    global _BY_PLACE
    if n > len(_BY_PLACE):
        _BY_PLACE = random_odd(2 * n, 11)
    return _BY_PLACE


@dataclass
class Words:
    """Words of a batch: bytes, word starts and ends, words of document i at offsets[i]:offsets[i+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split_words(texts: pa.Array | pa.ChunkedArray, lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    """Words and their 64-bit hashes; lower folds A-Z only; space tells for each byte whether it parts words."""
    data, at = utf8(texts)
    if lower:
        data = _LOWER[data]
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    offsets = np.searchsorted(starts, at)
    if not len(starts):
        return Words(data, starts, ends, offsets, np.zeros(0, U64))
    long = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(long[:-1], out=first[1:])
    place = np.arange(first[-1] + long[-1]) - np.repeat(first, long)
    value = data[inside].astype(U64)
    value += U64(1)
    value *= _by_place(int(long.max()))[place]
    hashes = mix(np.add.reduceat(value, first) + long.astype(U64) * U64(0x9E3779B97F4A7C15))
    return Words(data, starts, ends, offsets, hashes)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def window_hashes(hashes: np.ndarray, k: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A hash of every k consecutive values (windows that cross documents included): len - k + 1."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    power = np.full(n, base, U64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(n - k + 1, _inverse(base), U64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    total = np.zeros(n + 1, U64)
    np.cumsum(hashes * power, out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * back)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values: len - w + 1."""
    if len(values) < w:
        return values[:0]
    least, width = values, 1
    while width < w:
        step = min(width, w - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return least


def window_starts(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of every window of k words inside one document, and that document's index."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=first[1:])
    return np.arange(int(counts.sum())) - np.repeat(first, counts) + np.repeat(offsets[:-1], counts), doc


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text; a longer document is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
