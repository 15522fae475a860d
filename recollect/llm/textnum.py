"""Vectorised text primitives: Arrow strings to byte arrays, word and shingle hashes.

Every function takes whole texts; a batch is cut into slices of bounded bytes between documents, never inside one.
Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are 64-bit polynomials modulo 2**64 with a
finaliser, so a word has the same hash wherever it stands; long words go through xxhash.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
LONG_SPAN = 256
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {BASE: np.ones(1, np.uint64), BASE_INVERSE: np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        table = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        table[0] = 1
        _powers[base] = np.multiply.accumulate(table)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with about `most` bytes; a longer text stands alone."""
    data, offsets = flat(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def small_batches(batches: Iterator[pa.RecordBatch], text: int, most: int = 2 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of column `text`, so that Python objects are made for a few rows only;
    the pool's free memory goes back in the end, as workers stay and wait."""
    for batch in batches:
        _, offsets = flat(batch.column(text))
        i, n = 0, len(batch)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    give_back()


def give_back() -> None:
    """Free memory goes back to the system: Python workers stay and wait between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the index of its first word (len + 1)."""
    inside = IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]. Spans over ``LONG_SPAN`` bytes go through xxhash: on long regular words a
    polynomial modulo a power of two has known collisions."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=prefix[1:])
    body = (prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts]
    out = mix(body ^ ((ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(salt))
    for k in np.flatnonzero(ends - starts > LONG_SPAN):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), salt)
    return out


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and their bounds per document. A document of 1 to k-1 words has one shingle: all its words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    counts = np.diff(bounds)
    ends = np.repeat(bounds[1:], counts)
    at = np.arange(n)
    total = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        here = at + j
        term = np.where(here < ends, words[np.minimum(here, n - 1)], np.uint64(0x5BD1E995))
        total += term * np.uint64(factor)
        factor = factor * 0x9FB21C651E98DF25 % (1 << 64)
    starts = np.repeat(bounds[:-1], counts)
    ok = (at + k <= ends) | ((at == starts) & (ends - starts < k))
    each = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    return mix(total[ok]), np.concatenate([[0], np.cumsum(each)])


def shingles_of(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = word_spans(data, offsets)
    return shingle_hashes(span_hashes(data, starts, ends), bounds, k)
