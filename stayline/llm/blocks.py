"""Words and their hashes for whole batches of texts, on the UTF-8 bytes and without a Python object per word."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 4_000_000
#: Bytes whose powers are kept for the hashes of words.
HASH_BYTES = 1_000_000

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd numbers


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end the process gives back what it has freed.

    A worker waits for its next task with all the memory that its allocators keep, beside whatever the executor does
    meanwhile.
    """
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, and each row's first word (one more at the end).

    A word is a run of bytes other than ASCII white space inside one row.
    """
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of a public hash), in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial of prefix sums, spread by ``mix``."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        begin = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, begin + HASH_BYTES, "right")))
        size = int(ends[high - 1] - begin)
        up, down = _powers(base, HASH_BYTES if size <= HASH_BYTES else size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[begin : begin + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        s, e = starts[low:high] - begin, ends[low:high] - begin
        out[low:high] = (sums[e] - sums[s]) * down[s]
        low = high
    return mix(out + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, length: int, base: int = BASES[1]) -> np.ndarray:
    """Hash of the ``length`` words from each position, unmixed; positions near the end give a short result.

    Windows of twice a length are made from two of half of it.
    """
    if length == 1 or len(words) < length:
        return words[: max(0, len(words) - length + 1)]
    half = length // 2
    short = window_hashes(words, half, base)
    n = len(words) - length + 1
    out = short[:n] * np.uint64(pow(base, half, 1 << 64)) + short[half : half + n]
    if length % 2:
        out = out * np.uint64(base) + words[length - 1 :]
    return out
