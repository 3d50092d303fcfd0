"""A gap-weighted subsequence kernel between words, against a fixed set of landmark words."""

from __future__ import annotations

import numpy as np

DECAY = 0.55
SPAN = 5
SYMBOLS = 64
#: Steps between three letters: one character may be left out between each two.
STEPS = [(a, b) for a in (1, 2) for b in (1, 2) if a + b < SPAN]


def letters(word: str) -> str:
    """Letters and digits of a word between word marks; other characters do not count as gaps."""
    return f"^{word}$" if word.isalnum() else "^" + "".join(filter(str.isalnum, word)) + "$"


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words in a row, and the word of each symbol."""
    marked = [letters(w) for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    plain = (c >= 97) & (c <= 122)
    c = np.where(plain, c - 96, 27 + c % (SYMBOLS - 27)).astype(np.int32)
    return c, np.repeat(np.arange(len(words), dtype=np.int32), size)


def triples(c: np.ndarray, w: np.ndarray):
    """(word, code, weight) arrays of every three letters in order within the span, by step pattern."""
    for a, b in STEPS:
        n = len(c) - a - b
        if n <= 0:
            continue
        own = np.flatnonzero(w[:n] == w[a + b :])
        code = (c[own] * SYMBOLS + c[own + a]) * SYMBOLS + c[own + a + b]
        yield w[own], code, DECAY ** (a + b + 1)


def vectors(words: list[str]) -> list[dict[int, float]]:
    """Each word's subsequence vector, whole."""
    out: list[dict[int, float]] = [{} for _ in words]
    for at, code, weight in triples(*_codes(words)):
        for k, x in zip(at.tolist(), code.tolist()):
            out[k][x] = out[k].get(x, 0.0) + weight
    return out


def squared_lengths(words: list[str]) -> np.ndarray:
    """Each word's kernel with itself."""
    parts = list(triples(*_codes(words)))
    if not parts:
        return np.ones(len(words))
    key = np.concatenate([at.astype(np.int64) * SYMBOLS**3 + code for at, code, _ in parts])
    weight = np.concatenate([np.full(len(at), x) for at, _, x in parts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    total = np.add.reduceat(weight[order], first)
    out = np.bincount(key[first] // SYMBOLS**3, total * total, len(words))
    return np.where(out > 0, out, 1.0)


#: By length with its marks, the least squared length of a word: that of one whose subsequences all differ.
_LEAST = np.array([sum(max(0, n - a - b) * DECAY ** (2 * (a + b + 1)) for a, b in STEPS) for n in range(64)])


class Landmarks:
    """Cosine kernel of words with landmark words."""

    def __init__(self, words: list[str]):
        self.words = words
        own = vectors(words)
        codes = sorted({c for v in own for c in v})
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.row[codes] = np.arange(len(codes))
        self.table = np.zeros((len(codes), len(words)), np.float32)
        for k, v in enumerate(own):
            size = np.sqrt(sum(x * x for x in v.values())) or 1.0
            for c, x in v.items():
                self.table[self.row[c], k] = x / size
        self.most = self.table.max(axis=1, initial=0.0)

    def kernel(self, words: list[str], least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows by landmarks, and the words of the rows: those whose kernel with some landmark is ``least`` or more."""
        none = np.zeros((0, len(self.words))), np.zeros(0, int)
        if not words or not self.words:
            return none
        parts = []
        symbols, of = _codes(words)
        for at, code, weight in triples(symbols, of):
            row = self.row[code]
            hit = np.flatnonzero(row >= 0)
            parts.append((at[hit], row[hit], weight))
        # No landmark shares more than the sum of the greatest entries, and no word is shorter than its length allows.
        bound = sum((np.bincount(at, x * self.most[row], len(words)) for at, row, x in parts), np.zeros(len(words)))
        size = np.minimum(np.bincount(of, minlength=len(words)), 63)
        chosen = np.flatnonzero(bound >= least * np.sqrt(_LEAST[size]) * (1 - 1e-6))
        if not len(chosen):
            return none
        place = np.full(len(words), -1)
        place[chosen] = np.arange(len(chosen))
        out = np.zeros((len(chosen), len(self.words)), np.float32)
        for at, row, x in parts:
            mine = np.flatnonzero(place[at] >= 0)
            if len(mine):
                at, row = place[at[mine]], row[mine]
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                out[at[first]] += np.float32(x) * np.add.reduceat(self.table[row], first)
        out = out / np.sqrt(squared_lengths([words[i] for i in chosen]))[:, None]
        near = np.flatnonzero(out.max(axis=1) >= least)
        return out[near], chosen[near]
