"""A small causal self-attention model over subword ids, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

WINDOW, OVERLAP = 32, 8
SIZE, HEADS, INNER = 32, 2, 64
CLASSES, TAIL_CLASSES, INPUTS = 192, 32, 4096
STEPS, BATCH = 1200, 96
AT_ONCE = 256  # windows scored together


@dataclass
class Vocabulary:
    """Classes of ids by frequency: the most frequent are classes of their own, the others share classes of near ranks.

    ``within`` is the natural logarithm of an id's share of its class; ``row`` is the input row of an id.
    """

    kind: np.ndarray
    within: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        smooth = counts + 0.01
        order = np.argsort(-smooth, kind="stable")
        own = CLASSES - TAIL_CLASSES
        kind = np.empty(len(counts), np.int64)
        kind[order[:own]] = np.arange(own)
        # Shared classes hold equal shares of what is left.
        rest = np.cumsum(smooth[order[own:]])
        kind[order[own:]] = own + np.minimum(TAIL_CLASSES - 1, (rest / rest[-1] * TAIL_CLASSES).astype(np.int64)) if len(rest) else own
        within = np.log(smooth / np.bincount(kind, smooth, CLASSES)[kind])
        row = np.empty(len(counts), np.int64)
        row[order] = np.minimum(np.arange(len(counts)), INPUTS)
        row[order[INPUTS:]] = INPUTS + kind[order[INPUTS:]]
        return cls(kind, within.astype(np.float32), row)


@dataclass
class Weights:
    token: np.ndarray
    place: np.ndarray
    qkv: np.ndarray
    out: np.ndarray
    up: np.ndarray
    up_shift: np.ndarray
    down: np.ndarray
    classes: np.ndarray
    class_shift: np.ndarray

    @classmethod
    def drawn(cls, rng) -> Weights:
        draw = lambda *s, by=None: (rng.standard_normal(s) * (by or s[0] ** -0.5)).astype(np.float32)
        return cls(
            draw(INPUTS + CLASSES, SIZE, by=0.3), draw(WINDOW, SIZE, by=0.3), draw(SIZE, 3 * SIZE), draw(SIZE, SIZE),
            draw(SIZE, INNER), np.zeros(INNER, np.float32), draw(INNER, SIZE, by=0.05), draw(SIZE, CLASSES, by=0.1),
            np.zeros(CLASSES, np.float32),
        )

    def all(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_LARGEST = 60.0  # of a logit, so that exponentials stay finite


def _split(x: np.ndarray) -> np.ndarray:
    return x.reshape(x.shape[0], x.shape[1], HEADS, SIZE // HEADS).transpose(0, 2, 1, 3)


def _join(x: np.ndarray) -> np.ndarray:
    return x.transpose(0, 2, 1, 3).reshape(x.shape[0], x.shape[2], SIZE)


def _forward(w: Weights, rows: np.ndarray) -> tuple:
    x = w.token[rows] + w.place
    q, k, v = (_split(part) for part in np.split(x @ w.qkv, 3, axis=2))
    a = (q * np.float32((SIZE // HEADS) ** -0.5)) @ k.transpose(0, 1, 3, 2)
    np.exp(np.minimum(a, _LARGEST, out=a), out=a)
    a *= _MASK
    total = a.sum(axis=3, keepdims=True)
    o = _join((a @ v) / total)
    y = x + o @ w.out
    u = y @ w.up + w.up_shift
    np.maximum(u, 0, out=u)
    h = y + u @ w.down
    z = h @ w.classes + w.class_shift
    np.minimum(z, _LARGEST, out=z)
    return x, q, k, v, a, total, o, y, u, h, z


def _backward(w: Weights, rows: np.ndarray, state: tuple, dz: np.ndarray) -> list[np.ndarray]:
    x, q, k, v, a, total, o, y, u, h, _ = state
    a = a / total
    flat = lambda m: m.reshape(-1, m.shape[-1])
    dh = dz @ w.classes.T
    du = (dh @ w.down.T) * (u > 0)
    dy = dh + du @ w.up.T
    do = _split(dy @ w.out.T)
    da = do @ v.transpose(0, 1, 3, 2)
    ds = a * (da - (da * a).sum(axis=3, keepdims=True)) * (SIZE // HEADS) ** -0.5
    dqkv = np.concatenate([_join(ds @ k), _join(ds.transpose(0, 1, 3, 2) @ q), _join(a.transpose(0, 1, 3, 2) @ do)], axis=2)
    dx = dy + dqkv @ w.qkv.T
    dtoken = np.zeros_like(w.token)
    np.add.at(dtoken, rows.ravel(), flat(dx))
    return [
        dtoken, dx.sum(axis=0), flat(x).T @ flat(dqkv), flat(o).T @ flat(dy), flat(y).T @ flat(du), flat(du).sum(axis=0),
        flat(u).T @ flat(dh), flat(h).T @ flat(dz), flat(dz).sum(axis=0),
    ]


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, text and number of positions already scored, for windows that score each position of each text once."""
    step = WINDOW - OVERLAP
    n = np.maximum(1, -(-(sizes - OVERLAP) // step))
    text = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return number * step, text, np.where(number > 0, OVERLAP, 0)


def _chosen(ids: np.ndarray, sizes: np.ndarray, end: int, first: np.ndarray, text: np.ndarray, seen: np.ndarray) -> tuple:
    """For the given windows the ids before their positions, the ids at them, and whether each is to be scored.

    ``ids`` holds the texts one after another, each ended by ``end``; the end before a text begins it.
    """
    start = np.cumsum(sizes) - sizes
    at = first[:, None] + np.arange(WINDOW)
    inside = at < sizes[text][:, None]
    place = np.where(inside, start[text][:, None] + at, 0)
    before = np.where(at > 0, ids[np.maximum(place - 1, 0)], end)
    return before, ids[place], inside & (np.arange(WINDOW) >= seen[:, None])


def fit(ids: np.ndarray, sizes: np.ndarray, words: Vocabulary, end: int, steps: int = STEPS, seed: int = 3) -> Weights:
    """Weights fitted by Adam to the windows of some texts."""
    rng = np.random.default_rng(seed)
    w = Weights.drawn(rng)
    if not len(ids):
        return w
    every = windows(sizes)
    w.class_shift += np.log(np.bincount(words.kind[ids], minlength=CLASSES) + 1.0).astype(np.float32)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in w.all()]
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(every[0]), BATCH)
        _step(w, moments, t, 0.01 * min(1.0, t / 50) * (1 - 0.95 * t / steps), words, _chosen(ids, sizes, end, *(x[pick] for x in every)))
    return w


def _step(w: Weights, moments: list, t: int, rate: float, words: Vocabulary, chosen: tuple) -> None:
    """Step t of Adam, on the windows chosen."""
    before, target, on = chosen
    rows, kind = words.row[before], words.kind[target]
    state = _forward(w, rows)
    p = np.exp(state[-1])
    p /= p.sum(axis=2, keepdims=True)
    np.put_along_axis(p, kind[:, :, None], np.take_along_axis(p, kind[:, :, None], 2) - 1, 2)
    dz = p * (on[:, :, None] / max(1, on.sum()))
    rate = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
    for x, g, (m, v) in zip(w.all(), _backward(w, rows, state, dz.astype(np.float32)), moments):
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


class Learner:
    """Weights that go on from fitted ones with all windows of the texts they are given, each once."""

    RATE = 0.001

    def __init__(self, start: Weights, words: Vocabulary, end: int):
        self.w = Weights(*(x.copy() for x in start.all()))
        self.moments = [(np.zeros_like(x), np.zeros_like(x)) for x in self.w.all()]
        self.words, self.end, self.steps, self.windows = words, end, 0, 0

    def learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        every = windows(sizes)
        order = np.random.default_rng(len(ids)).permutation(len(every[0]))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            self.steps += 1
            _step(self.w, self.moments, self.steps, self.RATE, self.words, _chosen(ids, sizes, self.end, *(x[pick] for x in every)))
        self.windows += len(order)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w.all()])


def unflattened(like: Weights, flat: np.ndarray) -> Weights:
    """Weights of the shapes of ``like`` from their values in a row."""
    out, at = [], 0
    for x in like.all():
        out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    return Weights(*out)


def log10_probability(w: Weights, words: Vocabulary, ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Of each text with its end: every id is scored once, with at least OVERLAP ids before it or all there are."""
    total = np.zeros(len(sizes))
    every = windows(sizes)
    for k in range(0, len(every[0]), AT_ONCE):
        first, text, seen = (x[k : k + AT_ONCE] for x in every)
        before, target, on = _chosen(ids, sizes, end, first, text, seen)
        rows = words.row[before]
        z = _forward(w, rows)[-1]
        kind = words.kind[target]
        chosen = np.take_along_axis(z, kind[:, :, None], 2)[:, :, 0]
        np.exp(z, out=z)
        log = chosen - np.log(z.sum(axis=2)) + words.within[target]
        log = np.where(on, log, 0.0)
        total += np.bincount(text, log.sum(axis=1, dtype=np.float64), len(sizes))
    return total / np.log(10)
