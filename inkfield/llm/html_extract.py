"""Main text of web pages: a bidirectional LSTM labels every block of a page with the whole page as context."""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import arrow_rows
from inkfield.llm.html_blocks import Block, blocks_of

SAMPLE_PAGES = 400  # pages that the labeller is fitted on, at most
LAYOUTS = 4  # made-up layouts of each page, besides its own
PATH, WORDS, FIGURES = 160, 48, 8
WIDTH = PATH + WORDS + FIGURES
HIDDEN = 24
EPOCHS = 10
BATCH = 32
PAGES_AT_ONCE = 512

_hashes: dict[str, int] = {}


def _hash(name: str) -> int:
    h = _hashes.get(name)
    if h is None:
        if len(_hashes) > 500_000:
            _hashes.clear()
        h = _hashes[name] = zlib.crc32(name.encode("utf-8", "surrogatepass"))
    return h


_paths: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Hashed names of the elements: the innermost by itself, the others as ancestors."""
    v = _paths.get(path)
    if v is None:
        v = np.zeros(PATH, np.float32)
        for k, names in enumerate(reversed(path)):
            for name in names:
                h = _hash(("in " if k else "is ") + name)
                v[h % PATH] += 1.0
                v[(h >> 12) % PATH] += 1.0
        v = np.minimum(v, 2.0)
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = v
    return v


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block: its tag path, its hashed words, and figures such as length and share of links."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    for k, b in enumerate(blocks):
        out[k, :PATH] = _path_vector(b.path)
        words = b.text.lower().split()
        n = len(words)
        hashed = np.fromiter(map(_hash, words), np.int64, n) % WORDS
        out[k, PATH : PATH + WORDS] = np.bincount(hashed, minlength=WORDS) / n**0.5 / 4
        size = len(b.text)
        out[k, PATH + WORDS :] = (
            np.log1p(size) / 5, np.log1p(n) / 4, min(1.0, b.link_chars / size), b.text[-1] in ".!?", (b.text.count(",") + b.text.count(".")) / n,
            k / len(blocks), len(b.path) / 10, 1.0,
        )
    return out


@dataclass
class Labeller:
    """Weights of the two directions (inputs, state, bias) and of the last layer."""

    forward: tuple[np.ndarray, np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray, np.ndarray]
    out: np.ndarray
    shift: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.forward, *self.backward, self.out, self.shift]

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log odds of being main text for pages side by side: x is (blocks, pages, features)."""
        mask = (np.arange(len(x))[:, None] < sizes).astype(np.float32)[:, :, None]
        f, _ = _run(x, mask, self.forward)
        b, _ = _run(x[::-1], mask[::-1], self.backward)
        return (np.concatenate([f, b[::-1]], axis=2) @ self.out + self.shift)[:, :, 0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, weights) -> tuple[np.ndarray, list]:
    """States of one direction, and what is needed to go back. Behind a page's end the state stays zero."""
    wx, wh, bias = weights
    n = wh.shape[0]
    inputs = x @ wx + bias
    h = c = np.zeros((x.shape[1], n), np.float32)
    states, steps = np.empty((len(x), x.shape[1], n), np.float32), []
    for t in range(len(x)):
        z = inputs[t] + h @ wh
        gates, new = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        after = (f * c + i * new) * mask[t]
        tanh = np.tanh(after)
        steps.append((h, c, i, f, o, new, tanh))
        h, c = o * tanh * mask[t], after
        states[t] = h
    return states, steps


def _back(x: np.ndarray, mask: np.ndarray, weights, steps: list, grad: np.ndarray) -> list[np.ndarray]:
    """Gradients of one direction's weights."""
    wx, wh, _ = weights
    n = wh.shape[0]
    dz_all = np.empty((len(x), x.shape[1], 4 * n), np.float32)
    dwh = np.zeros_like(wh)
    dh = dc = np.zeros((x.shape[1], n), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, new, tanh = steps[t]
        dh = (dh + grad[t]) * mask[t]
        do = dh * tanh
        dc = (dc + dh * o * (1 - tanh * tanh)) * mask[t]
        dz = np.concatenate(
            [dc * new * i * (1 - i), dc * c * f * (1 - f), do * o * (1 - o), dc * i * (1 - new * new)], axis=1
        )
        dz_all[t] = dz
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    flat = dz_all.reshape(-1, 4 * n)
    return [x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)]


def fit(pages: list[list[tuple[Block, int]]], epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """A labeller from pages of labelled blocks, by Adam on the cross entropy of all blocks."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    one = lambda: (draw(WIDTH, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32))
    model = Labeller(one(), one(), draw(2 * HIDDEN, 1), np.zeros(1, np.float32))
    data = [(features([b for b, _ in p]), np.array([y for _, y in p], np.float32)) for p in pages if p]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
    step = 0
    for epoch in range(epochs):
        by_size = sorted(range(len(data)), key=lambda k: (len(data[k][1]), rng.random()))
        batches = [by_size[k : k + BATCH] for k in range(0, len(by_size), BATCH)]
        for k in rng.permutation(len(batches)):
            x, y, sizes = _padded([data[i] for i in batches[k]])
            mask = (np.arange(len(x))[:, None] < sizes).astype(np.float32)[:, :, None]
            f, fs = _run(x, mask, model.forward)
            b, bs = _run(x[::-1], mask[::-1], model.backward)
            both = np.concatenate([f, b[::-1]], axis=2)
            p = _sigmoid(both @ model.out + model.shift)
            d = (p - y[:, :, None]) * mask / mask.sum()
            flat = both.reshape(-1, both.shape[2])
            grad = d @ model.out.T
            grads = [
                *_back(x, mask, model.forward, fs, grad[:, :, :HIDDEN]),
                *_back(x[::-1], mask[::-1], model.backward, bs, grad[::-1, :, HIDDEN:]),
                flat.T @ d.reshape(-1, 1), d.sum(axis=(0, 1)),
            ]
            step += 1
            rate = 0.01 * min(1.0, step / 30) * (0.5 if epoch >= epochs // 2 else 1.0) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, (m, v) in zip(model.weights(), grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


def _padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(y) for _, y in pages])
    x = np.zeros((sizes.max(), len(pages), WIDTH), np.float32)
    y = np.zeros((sizes.max(), len(pages)), np.float32)
    for k, (a, b) in enumerate(pages):
        x[: len(b), k], y[: len(b), k] = a, b
    return x, y, sizes


# Names that page authors give to elements, by what stands in them.
_MAIN = "article main content post entry story body text page section single"
_ASIDE = {
    "menu": "nav menu navigation navbar topnav breadcrumb breadcrumbs pagination tabs links",
    "head": "header masthead top branding logo site tagline",
    "foot": "footer bottom copyright legal colophon imprint credits",
    "side": "sidebar aside related widget recommended popular trending teaser secondary rail more",
    "note": "cookie notice consent banner alert gdpr popup modal subscribe newsletter signup paywall message",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion commercial",
    "form": "form search login contact register feedback",
    "talk": "comment comments discussion replies reply disqus responses thread reader",
    "share": "share social tools meta byline tags",
}


def own_labels(blocks: list[Block]) -> list[int]:
    """Labels that a page's own markup gives: main text stands in an article or main element and in no other part."""
    aside = {w for words in _ASIDE.values() for w in words.split()} | {"header", "hidden"}
    out = []
    for b in blocks:
        names = [n for e in b.path for n in e]
        out.append(int(("article" in names or "main" in names) and not aside.intersection(names)))
    return out


def made_up(blocks: list[Block], labels: list[int], others: list[str], rng: random.Random) -> list[tuple[Block, int]]:
    """The page's blocks in another layout: other elements and names around the main text, and other parts about it."""
    text = [b for b, y in zip(blocks, labels) if y]
    rest = [b.text for b, y in zip(blocks, labels) if not y] or ["Home"]
    short = lambda: rng.choice([rng.choice(rest), " ".join(rng.choice(others).split()[: rng.randint(1, 6)])])
    long = lambda: " ".join(rng.choice(others).split()[: rng.randint(5, 80)])
    body = [("html",), ("body",)] + [("div", *rng.sample(["wrapper", "container", "page", "site", "layout"], 1))] * rng.randint(0, 2)

    def names(words: str) -> tuple[str, ...]:
        return tuple(rng.sample(words.split(), rng.randint(1, 2)))

    def part(kind: str, outer: list) -> list[tuple[Block, int]]:
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "section")
        plain = rng.random() < 0.4
        own = outer + [(tag,) if plain and kind not in ("note", "ad", "talk", "share") else (rng.choice([tag, "div", "div"]), *names(_ASIDE[kind]))]
        if kind in ("menu", "share", "head", "foot") and rng.random() < 0.7:
            n = rng.randint(1, 8)
            made = [(own + [("ul",), ("li",)] if kind != "foot" else own, short()) for _ in range(n)]
            return [(Block(tuple(p), t, len(t) if kind in ("menu", "share") or rng.random() < 0.5 else 0), 0) for p, t in made]
        if kind in ("talk", "side") and rng.random() < 0.8:
            inner = [("div", "comment")] if kind == "talk" and rng.random() < 0.6 else [(rng.choice(["div", "li", "article"]),)]
            title = [(Block(tuple(own + [("h3",)]), short()), 0)] if rng.random() < 0.6 else []
            return title + [(Block(tuple(own + inner + [("p",)]), long()), 0) for _ in range(rng.randint(1, 6))]
        inner = [("p",)] if rng.random() < 0.4 else []
        return [(Block(tuple(own + inner), long() if rng.random() < 0.7 else short()), 0) for _ in range(rng.randint(1, 3))]

    shape = rng.random()
    if shape < 0.35:
        main = [("article",)] if rng.random() < 0.5 else [("main",), ("article", *names(_MAIN))]
    elif shape < 0.5:
        main = [("main",)] if rng.random() < 0.5 else [("main", *names(_MAIN)), ("div", *names(_MAIN))]
    elif shape < 0.6:
        main = [("div",)] * rng.randint(0, 2)
    else:
        main = [(rng.choice(["div", "div", "section"]), *names(_MAIN))] + [("div", *names(_MAIN))] * rng.randint(0, 1)
    outer = body + main
    story = []
    for k, b in enumerate(text):
        leaf = b.path[-1][0] if b.path else "p"
        if leaf == "p" and rng.random() < 0.15:
            leaf = rng.choice(["p", "blockquote", "pre", "h2", "h3", "div"])
        path = outer + ([("ul",), ("li",)] if leaf == "p" and rng.random() < 0.05 else [(leaf,)])
        story.append((Block(tuple(path), b.text if rng.random() < 0.9 else " ".join(b.text.split()[: rng.randint(2, 12)])), 1))
        if rng.random() < 0.05:
            story += part(rng.choice(["ad", "share", "note", "side"]), outer)
    before = [part(k, body) for k in ("head", "menu", "note", "ad", "side", "form") if rng.random() < 0.45]
    after = [part(k, body) for k in ("talk", "side", "ad", "form", "share", "note", "foot") if rng.random() < 0.5]
    if rng.random() < 0.3:
        after.insert(0, part("talk", outer))
    rng.shuffle(before)
    return [x for p in before for x in p] + story + [x for p in after for x in p]


def fitted(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """A labeller from at most ``sample_pages`` pages, those with the least hash of page_id.

    Pages carry no labels. Those whose own markup sets the main text apart teach what main text looks like, in
    their own layout and in LAYOUTS made-up ones each, so that the labeller does not depend on one site's markup.
    """
    rows = pages.where(F.col("html").isNotNull()).orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    parsed = [blocks_of(r["html"]) for r in rows.select("html").collect()]
    marked = [(b, own_labels(b)) for b in parsed if b]
    marked = [(b, y) for b, y in marked if any(y) and not all(y)]
    others = [x.text for b, _ in marked for x in b if len(x.text) > 40] or ["."]
    rng = random.Random(11)
    data = []
    for b, y in marked:
        data.append(list(zip(b, y)))
        data += [made_up(b, y, others, rng) for _ in range(LAYOUTS)]
    return fit(data) if data else fit([[(Block((("p",),), "text."), 1)]], epochs=1)


def main_text(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html), from its whole html.

    ``text`` has the blocks labelled as main text, in page order, each with its white space turned into single blanks and
    its character references decoded, joined by line feeds. Null and empty pages have an empty text. Repeated rows stay;
    other columns are ignored.
    """

    def extract(c):
        texts = []
        html = c["html"].to_pylist()
        for at in range(0, len(html), PAGES_AT_ONCE):
            texts += _texts(html[at : at + PAGES_AT_ONCE], model)
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_rows(pages.select("page_id", "url", "html"), extract, "page_id long, url string, text string, n_chars long")


def _texts(pages: list[str | None], model: Labeller) -> list[str]:
    parsed = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if parsed[k]), key=lambda k: len(parsed[k]))
    for at in range(0, len(order), 64):  # pages of like length side by side
        part = order[at : at + 64]
        x, _, sizes = _padded([(features(parsed[k]), np.zeros(len(parsed[k]), np.float32)) for k in part])
        scores = model.scores(x, sizes)
        for j, k in enumerate(part):
            out[k] = "\n".join(b.text for b, s in zip(parsed[k], scores[:, j]) if s > 0)
    return out


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Main text of every page by a labeller fitted on some of them."""
    return main_text(pages, fitted(pages, sample_pages))
