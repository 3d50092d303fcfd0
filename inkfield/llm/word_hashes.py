"""Words of many texts hashed at once in numpy, and runs of words from prefix sums."""

from __future__ import annotations

import numpy as np

PLACES = 64  # places of a word with tables of their own; longer words take powers besides
SLICE = 4 << 20  # bytes hashed at once, about
_SEEDS = (71_993, 40_487)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TABLES = [np.random.default_rng(s).integers(0, 1 << 64, (PLACES, 256), dtype=np.uint64).ravel() for s in _SEEDS]


def words(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First byte and the byte after each word of UTF-8 ``data``; words end at ASCII white space and at ``breaks``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    opens, closes = ~inside[:-1], ~inside[1:]
    if breaks is not None:
        opens[breaks] = closes[breaks] = True
    return np.flatnonzero(inside[1:] & opens), np.flatnonzero(inside[:-1] & closes)


def hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word: sums of random table entries by place and byte."""
    out = np.empty((2, len(first)), np.uint64)
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(last, first[at] + SLICE)))
        sizes = last[at:end] - first[at:end]
        starts = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(starts, sizes)
        source = np.repeat(first[at:end], sizes) + place
        entry = (place % PLACES) * 256 + data[source]
        long = int(sizes.max()) > PLACES
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(sizes.max()) // PLACES, _STEP)]) if long else None
        for k, table in enumerate(_TABLES):
            v = table[entry]
            if long:
                v *= powers[place // PLACES]
            out[k, at:end] = np.add.reduceat(v, starts)
        at = end
    return out[0], out[1]


class Runs:
    """Hashes of runs of consecutive words, any lengths, from prefix sums of the words' hashes times powers."""

    def __init__(self, word_hashes: tuple[np.ndarray, np.ndarray]):
        n = len(word_hashes[0])
        self.sums, self.back = [], []
        for h, base in zip(word_hashes, _BASES):
            power = np.ones(n + 1, np.uint64)
            np.multiply.accumulate(np.full(n, base), out=power[1:])
            back = np.ones(n + 1, np.uint64)
            np.multiply.accumulate(np.full(n, np.uint64(pow(int(base), -1, 1 << 64))), out=back[1:])
            self.sums.append(np.r_[np.uint64(0), np.cumsum(h * power[:n], dtype=np.uint64)])
            self.back.append(back)

    def __call__(self, first: np.ndarray, size: np.ndarray | int, side: int) -> np.ndarray:
        """The hash of ``size`` words from each of ``first``, by word hash ``side``; equal runs have equal hashes wherever they are."""
        raw = (self.sums[side][first + size] - self.sums[side][first]) * self.back[side][first]
        return mixed(raw + np.asarray(size).astype(np.uint64) * _MIX)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread, one to one."""
    h = (h ^ (h >> np.uint64(31))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def lowest_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    n, have = len(h) - width + 1, 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h
