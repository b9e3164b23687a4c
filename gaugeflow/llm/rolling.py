"""Polynomial (Rabin-Karp) hashes of words and of word windows, over whole arrays.

Arithmetic is modulo 2**64. Bytes are first mapped to random 64-bit values and word hashes are mixed,
so that the low bits of a window's hash depend on all bits of its words.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (constants of a published finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def spread(seed: int, count: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
               + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base & (1 << 64) - 1, np.uint64)
    if count:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of an odd base and of its inverse, as long as needed."""

    def __init__(self, seed: int):
        self.base = int(spread(seed, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def grow(self, count: int) -> None:
        if len(self.up) < count:
            self.up, self.down = _powers(self.base, count), _powers(self.inverse, count)


def word_spans(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-last byte of every word, and the number of words before each row (and in all).

    ``offsets`` are the rows' byte offsets; a word ends where its row ends. ``space`` tells for each
    byte value whether it stands between words.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, powers: Powers) -> np.ndarray:
    """64-bit hash of each word's bytes, block by block so that memory stays small."""
    table = spread(seed, 256)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        powers.grow(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * powers.up[:high - low], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * powers.down[a]
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, first: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window of ``length`` words that lies in one row.

    ``first`` is the number of words before each row, and in all.
    """
    if len(words) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    powers.grow(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers.up[:len(words)], out=sums[1:])
    rolled = (sums[length:] - sums[:-length]) * powers.down[:len(words) - length + 1]
    row_end = np.repeat(first[1:], np.diff(first))
    start = np.flatnonzero(np.arange(len(words) - length + 1) + length <= row_end[:len(words) - length + 1])
    return mix(rolled[start]), start
