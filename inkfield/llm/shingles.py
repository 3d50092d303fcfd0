"""Word shingles of a text as 64-bit hashes, and the minhash collections drawn from them."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_PER_SHINGLE = 5
WORD_CACHE = 400_000
BLOCK = 2048  # shingles hashed at once, to stay in the processor's cache

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)


class WordHashes:
    """Hash of each word, remembered for the words seen last; the memory is bounded by WORD_CACHE entries."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        if len(known) > WORD_CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased and other letters left alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], hashes: WordHashes, width: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word runs; fewer words than ``width`` make one run, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(len(h), width)):
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> _SHIFT
        out *= _MIX2
    return np.unique(out)


class Collections:
    """Two small collections of minhash groups; a table key is any group of the first with any of the second.

    ``groups`` groups of ``rows`` minhashes a side give ``groups ** 2`` tables of ``2 * rows`` minhashes each for
    the price of ``2 * groups * rows`` minhashes.
    """

    def __init__(self, groups: int, rows: int, seed: int = 20_011):
        self.groups, self.rows = groups, rows
        rng = np.random.default_rng(seed)
        n = 2 * groups * rows
        self.factor = (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.place = rng.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit value for each group, the first side's groups before the second's."""
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        low = (self.factor * h[:BLOCK]).min(axis=1)
        for at in range(BLOCK, len(h), BLOCK):
            np.minimum(low, (self.factor * h[at : at + BLOCK]).min(axis=1), out=low)
        low = (low.astype(np.uint64) + np.uint64(1)) * self.place
        low ^= low >> _SHIFT
        return low.reshape(2 * self.groups, self.rows).sum(axis=1, dtype=np.uint64).view(np.int64)
