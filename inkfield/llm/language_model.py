"""Language-model scores of whole texts: a smoothed word model over the corpus and a causal self-attention model."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm import attention
from inkfield.llm.common import Tables, arrow_rows, of_process, remainder
from inkfield.llm.tokens import DocumentIds

FOLDS = 10
TOKENIZER, END, IDS = "byte_bpe_50k.json", 50256, 50257
FIT_ROWS = 2000  # texts that the attention model is fitted on, at most
HEAD_WORDS = 100_000  # most frequent words, whose counts are shipped to every task; the others are joined
CHARS_AT_ONCE = 500_000
TEXTS_AT_ONCE = 200  # texts that a task learns from at a time, in an order drawn among their windows
SLICE = 4096  # weights that are averaged together
_NO_WORD, _LINE = b"", b"\n"  # entries that no word can have: the end of a text, and its line feeds


def _lower(text: str | None) -> bytes:
    """The text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of ``docs`` (text), added up in each task first; also the ends of texts and the line feeds."""

    def count(c):
        found: Counter[bytes] = Counter()
        for t in c["text"].to_pylist():
            t = _lower(t)
            found.update(t.split())
            found[_NO_WORD] += 1
            found[_LINE] += t.count(b"\n")
        return {"word": list(found.keys()), "n": list(found.values())}

    return arrow_rows(docs.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _id_counts(counts: DataFrame) -> np.ndarray:
    """How often each subword id comes in the words counted, each word with the blank before it."""
    def count(c):
        encode = of_process(DocumentIds, TOKENIZER, END)
        words, n = c["word"].to_pylist(), c["n"].to_numpy()
        texts = ["\n" if w == _LINE else " " + w.decode("utf-8", "surrogatepass") if w else "" for w in words]
        ids, sizes = encode(texts)
        own = np.ones(len(ids), bool)
        own[np.cumsum(sizes) - 1] = [not w for w in words]  # the end counts for the ends of texts alone
        total = np.bincount(ids[own], np.repeat(n, sizes)[own], IDS)
        used = np.flatnonzero(total)
        return {"id": used, "n": total[used].astype(np.int64)}

    out = np.zeros(IDS)
    for r in arrow_rows(counts, count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # IDS rows at most
        out[r["id"]] = r["n"]
    return out


def learned(training: DataFrame, start: attention.Weights, vocabulary: attention.Vocabulary) -> attention.Weights:
    """The weights after every window of ``training`` (text): each task goes on from ``start``, the mean of the tasks counts.

    A task weighs as many as its windows. Means are taken by slices of the weights, so one set of them comes to the driver.
    """
    shipped = training.sparkSession.sparkContext.broadcast((start, vocabulary))

    def run(batches):
        learner = attention.Learner(*shipped.value, END)
        encode = of_process(DocumentIds, TOKENIZER, END)
        for b in batches:
            texts = b.column(0)
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                part = [_lower(t).decode("utf-8", "surrogatepass") for t in texts.slice(at, TEXTS_AT_ONCE).to_pylist()]
                learner.learn(*encode(part))
        if learner.windows:
            flat = learner.flat().astype(np.float64) * learner.windows
            parts = [flat[k : k + SLICE].tobytes() for k in range(0, len(flat), SLICE)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([learner.windows] * n, pa.int64()), pa.array(parts, pa.binary())],
                ["slice", "windows", "total"],
            )

    def mean(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in t.column("total").to_pylist()) / sum(t.column("windows").to_pylist())
        return pa.table({"slice": t.column("slice").slice(0, 1), "mean": pa.array([total.tobytes()], pa.binary())})

    totals = training.select("text").mapInArrow(run, "slice int, windows long, total binary")
    means = totals.groupBy("slice").applyInArrow(mean, "slice int, mean binary").collect()
    if not means:
        return start
    return attention.unflattened(start, np.concatenate([np.frombuffer(r["mean"]) for r in sorted(means, key=lambda r: r["slice"])]))


def scores(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    Tokens are words between ASCII white space, A-Z lower-cased, and one end. Rows whose crc32 of doc_id as text, modulo 10, is
    not 0 are learned from. ``base_score`` is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) with the counts of all of
    them. ``score`` is log10 of the probability of the lower-cased text under a causal self-attention model over subword
    ids: it predicts the class of the next id from a window of ids before it, and the id within its class from
    the counts of the whole corpus. Windows overlap and each id is scored once. Its weights start from a fit on at
    most ``fit_rows`` rows, those with the least hash of doc_id, and are then learned from all training rows (``learned``).

    A null or empty text has the end alone. Repeated rows are scored like any others; rows without doc_id count as text "".
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "language-model")
    docs = docs.select("doc_id", "text")
    training = docs.where(remainder("doc_id", FOLDS) != 0)
    counts = tables.keep(word_counts(training))
    words = counts.where(F.col("word") != F.lit(_LINE))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = total + 0.1 * (distinct + 1)
    head = words.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).toArrow()
    sample = training.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "text").limit(fit_rows).select("text").collect()
    ids, sizes = DocumentIds(TOKENIZER, END)([_lower(r["text"]).decode("utf-8", "surrogatepass") for r in sample])
    vocabulary = attention.Vocabulary.of(_id_counts(counts))
    weights = learned(training, attention.fit(ids, sizes, vocabulary, END), vocabulary)
    shipped = spark.sparkContext.broadcast(
        ({w: k for k, w in enumerate(head["word"].to_pylist())}, head["n"].to_numpy(), vocabulary, weights)
    )

    def score(batches):
        place, n, vocabulary, weights = shipped.value
        log = np.log10((np.r_[n, 0] + 0.1) / scale)
        encode = of_process(DocumentIds, TOKENIZER, END)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = [_lower(t) for t in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and chars < CHARS_AT_ONCE:
                    chars += len(texts[end])
                    end += 1
                yield _scored(row, b.column(0).slice(at, end - at), texts[at:end], place, log, vocabulary, weights, encode)
                row += end - at
                at = end

    scored = tables.keep(
        docs.mapInArrow(
            score,
            "row long, doc_id long, n_tokens long, known long, base double, score double, tail array<binary>, times array<int>",
        )
    )
    rare = scored.where(F.size("tail") > 0).select("row", F.explode(F.arrays_zip("tail", "times")).alias("x"))
    rare = rare.select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    of_rare = (
        rare.join(counts, "word", "left").groupBy("row").agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.log10((c + F.lit(0.1)) / F.lit(scale))).alias("rare_base"),
        )
    )
    return scored.drop("tail", "times").join(of_rare, "row", "left").select(
        "doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )


def _scored(row, doc_id, texts, place, log, vocabulary, weights, encode) -> pa.RecordBatch:
    n, known, base, tails, times = [], [], [], [], []
    for t in texts:
        words = t.split()
        words.append(_NO_WORD)
        at = np.array([place.get(w, -1) for w in words])
        rare = Counter(w for w, k in zip(words, at) if k < 0) if (at < 0).any() else {}
        n.append(len(words))
        known.append(int((at >= 0).sum()))
        base.append(float(log[at[at >= 0]].sum()))
        tails.append(list(rare.keys()))
        times.append(list(rare.values()))
    ids, sizes = encode([t.decode("utf-8", "surrogatepass") for t in texts])
    score = attention.log10_probability(weights, vocabulary, ids, sizes, END)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(row, row + len(texts))), doc_id, pa.array(n, pa.int64()), pa.array(known, pa.int64()),
            pa.array(base), pa.array(score), pa.array(tails, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())),
        ],
        ["row", "doc_id", "n_tokens", "known", "base", "score", "tail", "times"],
    )
