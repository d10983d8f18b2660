"""Windows of texts grouped by their smallest k-gram: the unit in which repeated windows are looked up.

Two equal windows have the same smallest k-gram hash, so windows need to be compared only where that hash, the *anchor*,
occurs in several documents.  Neighbouring windows with the same anchor form a *unit*; about 2/(w + 1) of all places
begin one, w being the number of k-grams in a window.  Units of equal content hold equal windows.
"""

from __future__ import annotations

import numpy as np

from .word_hashes import mix, window_hashes


SLICE = 1 << 15


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < width:
        rest = width - size
        x = np.minimum(x[:-rest], x[rest:])
    return x


def units(hashes: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window (places in ``hashes``) and anchor of every unit.

    ``bounds[i]:bounds[i + 1]`` are the places of text i; windows don't cross texts.  A unit has ``window`` windows at most.
    """
    n = len(hashes) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64)
    anchor = np.empty(n, np.uint64)
    for a in range(0, n, SLICE):  # a slice's arrays stay in the processor's cache
        anchor[a : a + SLICE] = sliding_min(window_hashes(hashes[a : a + SLICE + window - 1], gram), window - gram + 1)
    whole = np.ones(n + 1, bool)
    for b in bounds[1:-1]:
        whole[max(0, b - window + 1) : min(b, n)] = False
    whole[n] = False
    whole = whole[:n]
    starts = whole.copy()
    starts[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    # texts that follow each other without a gap of invalid windows (window 1) begin anew too
    first = bounds[:-1][bounds[:-1] < n]
    starts[first] = whole[first]
    begin = np.flatnonzero(starts)
    if not len(begin):
        return none, none, np.zeros(0, np.uint64)
    ends = bounds[np.searchsorted(bounds, begin, side="right")] - window + 1
    size = np.minimum(np.append(begin[1:], n), ends) - begin
    # long units, of texts that repeat themselves, are cut
    pieces = -(-size // window)
    which = np.repeat(np.arange(len(begin)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    l = begin[which] + nth * window  # noqa: E741
    r = np.minimum(l + window, begin[which] + size[which]) - 1
    return l, r, anchor[l]


def content_hashes(hashes: np.ndarray, l: np.ndarray, r: np.ndarray, window: int, seed: int) -> np.ndarray:  # noqa: E741
    """A 64-bit hash of everything that the windows l to r cover.  ``r - l < window``, so the first and last say it all."""
    full = window_hashes(mix(hashes ^ np.uint64(seed)), window)
    return mix(full[l] * np.uint64(0xC2B2AE3D27D4EB4F) + full[r] + (r - l).astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def covered(places: int, l: np.ndarray, r: np.ndarray, window: int) -> np.ndarray:  # noqa: E741
    """Which of ``places`` places lie in one of the windows l to r (arrays of ranges)."""
    steps = np.zeros(places + 1, np.int64)
    np.add.at(steps, l, 1)
    np.add.at(steps, np.minimum(r + window, places), -1)
    return np.cumsum(steps[:-1]) > 0
