"""Words of texts as arrays: byte ranges and 64-bit hashes, without a Python object per word.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of every word."""
    word = ~_SEPARATOR[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, block: int = 1 << 18, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges are sorted and disjoint.  About ``block`` bytes at a time."""
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + block, side="right")))
        sizes = end[i:j] - begin[i:j]
        starts = np.cumsum(sizes) - sizes
        inner = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        values = data[np.repeat(begin[i:j], sizes) + inner].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(values * powers(int(sizes.max()), base)[inner], starts)
        out[i:j] = mix(sums + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring hashes: one for each place that has so many."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    # Horner over doubling widths: H(2w)[i] = H(w)[i] * B^w + H(w)[i + w]
    part, size, offset = hashes.astype(np.uint64), 1, 0
    left = width
    while left:
        if left & 1:
            out = out * _power(size) + part[offset : offset + n]
            offset += size
        left >>= 1
        if left:
            part = part[: len(part) - size] * _power(size) + part[size:]
            size *= 2
    return mix(out)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def text_slices(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs [i, j) of texts of about ``size`` characters, one text at least, and their bytes."""
    i = 0
    while i < len(texts):
        j, total = i + 1, len(texts[i])
        while j < len(texts) and total + len(texts[j]) <= size:
            total += len(texts[j])
            j += 1
        yield i, j, [x.encode() for x in texts[i:j]]
        give_back()
        i = j


def arrow_slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """As ``text_slices``, of a column of strings of an Arrow batch, without making Python texts of all of it."""
    texts = batch.column(column)
    stops = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(stops, (stops[i - 1] if i else 0) + size, side="right")))
        yield i, j, texts.slice(i, j - i).cast(pa.binary()).to_pylist()
        give_back()
        i = j


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes joined by line ends, the words' ranges in them and hashes, and where each text's words begin."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begin, end = word_ranges(data)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, begin, end, word_hashes(data, begin, end), np.searchsorted(begin, bounds)
