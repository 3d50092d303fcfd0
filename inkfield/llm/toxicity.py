"""Toxicity of whole texts: a subsequence string-kernel support vector machine on Nyström landmarks.

A text is as toxic as its worst word. Words are compared with landmark words by a gap-weighted subsequence kernel, so
insults with gaps, inserted characters or other endings stay near their landmark. The machine learns from texts that
are labelled as a whole: which word of a toxic text makes it so is found in turns with the fit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import of_process, remainder
from inkfield.llm.string_kernel import Landmarks

FOLDS = 5
SAMPLE_ROWS = 4000  # labelled texts of either class that the fit looks at, at most
LANDMARKS = 96
NEUTRAL = 32
TURNS = 4
SUSPECT = 8.0  # least odds of a landmark that stands for toxic texts
NEAR = 0.35  # kernel with the nearest landmark below which a word is no evidence
KNOWN_WORDS = 1_000_000
WORDS_AT_ONCE = 2048  # of a fit, whose kernels are worked out together

_SPELLED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")


@dataclass(frozen=True)
class Model:
    """``weights`` and ``bias`` of the machine on the landmarks' kernel; ``slope`` and ``shift`` make it a probability."""

    landmarks: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    slope: float
    shift: float


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; letters spelled one by one count as one word too."""
    if not text:
        return []
    text = text.lower()
    words = text.split()
    if _SPELLED.search(text):
        words += [m.group().replace(" ", "") for m in _SPELLED.finditer(text)]
    return words


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1), on at most ``sample_rows`` texts of either class.

    The fold of a row is crc32 of its doc_id as text, modulo 5; fold 0 is held out. The sample is those of the other
    labelled rows with the least hash of doc_id, so it does not depend on their order or partitions, and only the
    texts of the sample leave the table. Rows without a label or text are left out; a document with both
    labels counts as toxic. Without both classes the model finds nothing toxic.
    """
    known = (
        labels.where((remainder("doc_id", FOLDS) != 0) & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample_rows).collect() for c in (1, 0)]
    sample = docs.sparkSession.createDataFrame(
        [(r["doc_id"], int(r["toxic"])) for rows in chosen for r in rows], "doc_id long, __toxic int"
    )
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    rows = sorted(texts.distinct().collect(), key=lambda r: (r["doc_id"], r["text"]))
    of_class = lambda c: (set(words_of(r["text"])) for r in rows if r["__toxic"] == c)
    return _fit_words(of_class(1), of_class(0))


def score_of(text: str, model: Model) -> Column:
    """Score (0 to 1) of the whole text in a column; a null or empty text has the score of one without evidence."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        scorer = of_process(_WordScores, model)
        parts = [texts.iloc[k : k + 1000] for k in range(0, len(texts), 1000)]
        return pd.Series(np.concatenate([scorer.of_texts([words_of(t) for t in p]) for p in parts] or [np.zeros(0)]))

    return scores(F.col(text))


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below one half; null and empty texts stay."""
    model = fit(docs, labels, sample_rows)
    return docs.where((score_of("text", model) < 0.5) | (F.coalesce("text", F.lit("")) == ""))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labelled rows outside the held-out fold, scored for all rows.

    Null and empty texts are scored too, as texts without evidence. Repeated rows stay; other columns are ignored. An empty
    table gives an empty result. The fold of a row is crc32 of its doc_id as text, modulo 5; fold 0 is held out. Labels serve the fit only.
    """
    model = fit(docs, labels, sample_rows)
    out = docs.select("doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), score_of("text", model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


class _WordScores:
    """Decisions for words, remembered for those seen last: at most KNOWN_WORDS, and apart those that are evidence."""

    def __init__(self, model: Model):
        self.model, self.known, self.evidence, self.landmarks = model, set(), {}, None

    def of_texts(self, texts: list[list[str]]) -> np.ndarray:
        m = self.model
        if self.landmarks is None:
            self.landmarks = Landmarks(list(m.landmarks))
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            self.evidence.clear()
        new = list(set().union(*texts).difference(self.known)) if texts else []
        evidence = self.evidence
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            found = _decide(self.landmarks, m, part)
            evidence.update((part[i], float(found[i])) for i in np.flatnonzero(found > m.bias))
        self.known.update(new)
        best = np.array([max([evidence[w] for w in t if w in evidence], default=m.bias) for t in texts])
        return 1.0 / (1.0 + np.exp(-(m.slope * best + m.shift)))


def _decide(landmarks: Landmarks, model: Model, words: list[str]) -> np.ndarray:
    """The machine's decision for each word."""
    k, near = landmarks.kernel(words, NEAR)
    out = np.full(len(words), model.bias)
    out[near] += k @ np.array(model.weights)
    return np.maximum(out, model.bias)


def _numbered(*groups: Iterable[Iterable[str]]) -> tuple[list[str], list[list[np.ndarray]]]:
    """All words in order, and each group's texts as the numbers of their words: a word is held once, however many texts have it."""
    seen: dict[str, int] = {}
    found = [[np.array([seen.setdefault(w, len(seen)) for w in t], np.int32) for t in texts] for texts in groups]
    words = sorted(seen)
    place = np.empty(len(words), np.int32)
    place[[seen[w] for w in words]] = np.arange(len(words))
    return words, [[np.sort(place[t]) for t in texts] for texts in found]


def _unlike(texts: list[np.ndarray], hashes: np.ndarray) -> list[np.ndarray]:
    """One of the texts that share the words with the least hashes, so that copies count once."""
    first = {}
    for t in texts:
        first.setdefault(tuple(np.sort(hashes[t])[:4].tolist()), t)
    return list(first.values())


def _near(landmarks: Landmarks, words: list[str], least: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks' kernel of the words near one, and which words these are; some words at a time, as a word takes much memory."""
    kernel, near = [np.zeros((0, len(landmarks.words)))], [np.zeros(0, int)]
    for at in range(0, len(words), WORDS_AT_ONCE):
        k, i = landmarks.kernel(words[at : at + WORDS_AT_ONCE], least)
        kernel.append(k)
        near.append(i + at)
    return np.concatenate(kernel), np.concatenate(near)


def _fit_words(toxic: Iterable[Iterable[str]], clean: Iterable[Iterable[str]]) -> Model:
    """A model from the distinct words of toxic and clean texts."""
    nothing = Model((), (), -1.0, 4.0, 0.0)
    words, (toxic, clean) = _numbered(toxic, clean)
    if not toxic or not clean:
        return nothing
    hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint32)
    once, spared = _unlike(toxic, hashes), _unlike(clean, hashes)
    in_toxic, in_clean = (np.bincount(np.concatenate(texts), minlength=len(words)) for texts in (once, spared))

    def odds(w: int, n: int) -> float:
        """How much more of the toxic texts have a word, both counts taken two deviations to its disfavour."""
        c = int(in_clean[w])
        return (n - 2 * n**0.5) / len(once) / ((c + 2 * c**0.5 + 1) / len(spared))

    # A suspect stands in many toxic texts, or in texts that the suspects before it leave unexplained.
    by_word = np.argsort(np.concatenate(once), kind="stable")
    texts_by_word = np.repeat(np.arange(len(once), dtype=np.int32), [len(t) for t in once])[by_word]
    starts = np.r_[0, np.cumsum(in_toxic)]
    ranked, unexplained = [], np.ones(len(once), bool)
    for w in np.argsort(-in_toxic, kind="stable").tolist():
        n, texts = int(in_toxic[w]), texts_by_word[starts[w] : starts[w + 1]]
        if n < 5 or len(ranked) == LANDMARKS - NEUTRAL:
            break
        if odds(w, n) >= SUSPECT and (n >= 0.05 * len(once) or odds(w, int(unexplained[texts].sum())) >= SUSPECT):
            ranked.append(w)
            unexplained[texts] = False
    if not ranked:
        return nothing
    # Neutral landmarks: frequent words of clean texts that look most like a suspect.
    frequent = np.argsort(-in_clean, kind="stable")
    frequent = frequent[in_clean[frequent] > 0][:20_000]
    frequent = [words[w] for w in frequent[~np.isin(frequent, ranked)].tolist()]
    suspects = [words[w] for w in ranked]
    k, near = _near(Landmarks(suspects), frequent)
    order = np.argsort(-k.max(axis=1, initial=0.0), kind="stable")[:NEUTRAL]
    landmarks = Landmarks(suspects + [frequent[near[i]] for i in order])
    # Words of clean texts are innocent; in a toxic text, the word that the machine likes most is the guilty one.
    own = np.flatnonzero(in_toxic + in_clean)
    kernel, near = _near(landmarks, [words[w] for w in own.tolist()])
    own = own[near]
    place = np.full(len(words), -1)
    place[own] = np.arange(len(own))
    of_toxic, of_clean = in_toxic[own], in_clean[own]
    between, _ = landmarks.kernel(landmarks.words)
    values, axes = np.linalg.eigh((between + between.T) / 2)
    keep = values > 1e-6 * values.max()
    whiten = axes[:, keep] / np.sqrt(values[keep])
    z = kernel @ whiten
    known = lambda t: place[t][place[t] >= 0]
    bags = [b for b in map(known, toxic) if len(b)]
    innocent = np.flatnonzero(of_clean)
    if not bags:
        return nothing
    often = of_clean[innocent] ** 0.5
    often *= 0.5 / max(1.0, often.sum())
    blamed = np.array([place[w] for w in ranked if place[w] >= 0 and not in_clean[w]], int)
    suspicion = kernel[:, : len(ranked)].max(axis=1)
    suspicion[innocent] -= 2.0
    for _ in range(TURNS):
        guilty = np.array([b[np.argmax(suspicion[b])] for b in bags])
        # Texts whose nearest words all stand in clean texts teach nothing.
        guilty = np.union1d(guilty[suspicion[guilty] > -1], blamed).astype(int)
        if not len(guilty):
            return nothing
        blame = of_toxic[guilty] + 1.0
        x = np.concatenate([z[guilty], z[innocent]])
        y = np.r_[np.ones(len(guilty)), -np.ones(len(innocent))]
        theta, bias = _machine(x, y, np.r_[0.5 * blame / blame.sum(), often])
        suspicion = z @ theta + bias
        suspicion[innocent] -= 2.0
    bias = min(bias, -1.0)
    decide = np.maximum(z @ theta + bias, bias)
    f = np.array([decide[known(t)].max(initial=bias) for t in (*toxic, *clean)])
    slope, shift = _split(f, np.r_[np.ones(len(toxic)), np.zeros(len(clean))])
    return Model(tuple(landmarks.words), tuple((whiten @ theta).tolist()), float(bias), slope, shift)


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear support vector machine by weighted squared hinge loss, fitted by accelerated gradient steps."""
    a = np.c_[x, np.ones(len(x))]
    size = 2 * np.linalg.norm(a * np.sqrt(weight)[:, None], 2) ** 2 + penalty
    w = v = np.zeros(a.shape[1])
    for t in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (a @ v))
        grad = -2 * a.T @ (weight * slack * y) + penalty * np.r_[v[:-1], 0.0]
        after = v - grad / size
        v = after + t / (t + 3) * (after - w)
        w = after
    return w[:-1], float(w[-1])


def _split(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve that is one half where the fewest texts are on the wrong side."""
    order = np.argsort(f, kind="stable")
    f, y = f[order], y[order]
    below = np.cumsum(np.where(y > 0, -1.0, 1.0))
    border = np.flatnonzero(f[1:] > f[:-1])
    if not len(border):
        return 4.0, -4.0 * float(f[-1]) - 1.0
    at = border[np.argmax(below[border])]
    middle = (f[at] + f[at + 1]) / 2
    guilty = f[(y > 0) & (f > middle)]
    slope = 4.0 / max(0.1, float(np.median(guilty) - middle)) if len(guilty) else 4.0
    return slope, float(-slope * middle)
