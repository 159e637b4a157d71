"""Numpy helpers over Arrow text columns: bytes, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Odd multipliers of the rolling hashes (any would do).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in row slices whose texts have about ``most`` bytes; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < len(sizes):
            yield batch.slice(start)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POWERS = powers(4096)


def word_hashes(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text): words are runs of letters and digits."""
    isword = _LETTER[data]
    first = isword.copy()
    first[1:] &= ~isword[:-1]
    cuts = offsets[:-1][(offsets[:-1] < offsets[1:])]
    first[cuts] = isword[cuts]
    starts = np.flatnonzero(first)
    last = isword.copy()
    last[:-1] &= ~isword[1:]
    ends_at = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
    last[ends_at] = isword[ends_at]
    ends = np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step)))
        s, e = starts[lo:hi], ends[lo:hi]
        n = e - s
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        values = (data[np.repeat(s, n) + place].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095]
        out[lo:hi] = np.add.reduceat(values, begin)
        lo = hi
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return mixed(out), counts


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * BASE + words[j : j + len(out)]
    return mixed(out)
