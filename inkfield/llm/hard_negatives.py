"""Hard negatives by exact whole-number inner products, several candidates to a multiplication.

Candidates' components, biased so that none is negative, stand side by side in separated fields of one wide integer: each component of
an anchor multiplies all of them at once, and the fields of the sum hold the exact scores. The wide integer is kept in a double, whose
53 bits hold it exactly, as products of double matrices are the fast ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfield.llm.common import Batches, Tables

SCALE = 256  # a component x becomes floor(SCALE * x)
K = 5
LOWEST_PERCENT, HIGHEST_PERCENT = 80, 100  # a negative's score in per cent of its positive's
BITS = 53  # of the wide integer
CANDIDATES, ANCHORS = 4096, 512  # vectors of a block at most
BLOCK_BYTES = 8 << 20  # of a block's components at most
PART_BYTES = 128 << 20  # of candidates that are compared with a group of anchors in one go
GROUP = 128  # anchor blocks of such a group, about
HELD = GROUP * ANCHORS  # anchors whose best rows a task keeps at once
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Packed:
    """Candidates (rows of whole numbers) packed for exact products with anchors of components up to ``largest`` in size.

    Anchors are biased too and cut into limbs so small that a field cannot run over into the next.
    """

    rows: np.ndarray
    largest: int

    def __post_init__(self):
        n, d = self.rows.shape
        bias = int(np.abs(self.rows).max()) if n else 0
        field = lambda limb: max(1, (d * 2 * bias * (2**limb - 1)).bit_length())
        whole = max(1, (2 * self.largest).bit_length())
        limb = whole
        while field(limb) > BITS:
            limb -= 1
        fields = BITS // field(limb)
        set_ = lambda k, v: object.__setattr__(self, k, v)
        set_("bias", bias)
        set_("limbs", [(at, min(limb, whole - at)) for at in range(0, whole, limb)])
        set_("width", field(limb))
        set_("fields", fields)
        words = np.zeros((-(-n // fields), d))
        biased = np.zeros((len(words) * fields, d))
        biased[:n] = self.rows + bias
        for k in range(fields):
            words += biased[k * len(words) : (k + 1) * len(words)] * 2.0 ** (k * self.width)
        set_("words", words.T.copy())
        set_("sums", self.rows.sum(axis=1))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors x candidates, as 64-bit numbers."""
        (n, d), step = self.rows.shape, self.words.shape[1]
        out = np.zeros((len(anchors), step * self.fields), np.int64)
        moved, mask = anchors + self.largest, (1 << self.width) - 1
        for at, bits in self.limbs:
            wide = (((moved >> at) & ((1 << bits) - 1)).astype(np.float64) @ self.words).astype(np.int64)
            for k in range(self.fields):
                out[:, k * step : (k + 1) * step] += ((wide >> (k * self.width)) & mask) << at
        out = out[:, :n]
        # (a + A)(c + B) summed, less what the biases add
        out -= self.bias * anchors.sum(axis=1)[:, None] + self.largest * self.sums[None, :] + d * self.largest * self.bias
        return out


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    k: int = K,
    lowest: int = LOWEST_PERCENT,
    highest: int = HIGHEST_PERCENT,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where ``anchor`` holds.

    ``vectors`` has vec_id, label and embedding; ``anchor`` is a condition on vec_id. Other columns are ignored. A row's score is its
    whole-number inner product with the anchor; higher scores come first, equal ones by vec_id. An anchor's positives are its
    first ``k`` other rows of the same label; for each of them come the first ``k`` rows of other labels whose score is between ``lowest``
    and ``highest`` per cent of the positive's. Anchors without positives, and positives without such rows, give nothing.

    Rows with a null vec_id or label take no part, nor do vectors that are null, empty or hold a null or non-finite
    component, nor those with components so large that scores could leave a long. Zero vectors score 0. Of several rows of one vec_id
    the least by label and components counts. Vectors of different lengths are never compared. Empty tables give an
    empty result.

    Vectors travel in blocks of bounded size. Every part of the candidates meets every group of anchor blocks by an equi-join on
    (part, group), and a task keeps ``k`` rows for each anchor (then for each of its positives) of what it has seen; only these are
    shuffled and ranked.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "hard-negatives")
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable("embedding"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), whole.alias("x")).alias("row"))
    rows = rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.x", F.size("row.x").alias("dim"))
    blocks = tables.keep(rows.mapInArrow(_blocks(CANDIDATES), _BLOCK_COLUMNS))
    asked = rows.where(anchor).mapInArrow(_blocks(ANCHORS), _BLOCK_COLUMNS)
    asked = tables.keep(asked.select(*[F.col(c).alias(f"a_{c}") for c in asked.columns]))
    size, number = blocks.agg(F.sum(F.octet_length("x")), F.count("*")).first()
    parts = max(1, min(number, max(2 * spark.sparkContext.defaultParallelism, -(-(size or 0) // PART_BYTES))))
    groups = -(-asked.count() // GROUP) or 1
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = blocks.withColumn("part", dealt("id", parts)).withColumn("group", every(groups))
    asked = asked.withColumn("group", dealt("a_id", groups)).withColumn("part", every(parts))

    best = _compared(asked, candidates, "a_id long, anchor_id long, found_id long, score long", _Positives(k))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id")
    positives = tables.keep(
        best.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k).drop("at")
    )
    wanted = positives.groupBy("a_id").agg(F.collect_list(F.struct("anchor_id", "found_id", "score")).alias("wanted"))
    near = _compared(
        asked.join(wanted, "a_id"), candidates,
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", _Negatives(k, lowest, highest),
    )
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select(*[c.split()[0] for c in RESULT.split(", ")])


def _usable(column: str) -> Column:
    """Finite vectors whose scores fit a long: no component beyond the root of 2**62 / length, once scaled."""
    limit = F.sqrt(F.lit(2.0**62) / F.size(column)) / SCALE - 1
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > limit))
    return F.coalesce(~bad & (F.size(column) > 0), F.lit(False))


_BLOCK_COLUMNS = "id long, dim int, largest long, ids binary, labels binary, x binary"


def _blocks(most: int):
    """Rows of (vec_id, label, x, dim) put together by length, ``most`` at a time; a block's id is its first vec_id."""

    def run(batches: Batches) -> Batches:
        schema = pa.schema([
            ("id", pa.int64()), ("dim", pa.int32()), ("largest", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary()),
        ])
        for b in batches:
            ids, labels, dims = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                x = b.column(2).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                size = max(1, min(most, BLOCK_BYTES // (8 * dim)))
                for at in range(0, len(mine), size):
                    rows, part = mine[at : at + size], x[at : at + size]
                    block = {
                        "id": int(ids[rows[0]]), "dim": dim, "largest": int(np.abs(part).max()), "ids": ids[rows].tobytes(),
                        "labels": labels[rows].tobytes(), "x": part.tobytes(),
                    }
                    yield pa.RecordBatch.from_pylist([block], schema=schema)

    return run


def _compared(asked: DataFrame, candidates: DataFrame, schema: str, kind) -> DataFrame:
    """What ``kind`` keeps of every anchor block beside all candidate blocks."""
    both = candidates.join(asked.withColumnRenamed("a_dim", "dim"), ["part", "group", "dim"])
    more = ["wanted"] if "wanted" in asked.columns else []
    both = both.select("id", "dim", "ids", "labels", "x", "a_id", "a_ids", "a_labels", "a_x", "a_largest", *more)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        held, packed, anchors_held = {}, (None, None), 0
        for b in batches:
            for at in range(b.num_rows):
                row = {name: b.column(i)[at] for i, name in enumerate(b.schema.names)}
                dim, here = row["dim"].as_py(), (row["id"].as_py(), row["a_largest"].as_py())
                if packed[0] != here:
                    packed = here, Packed(_numbers(row["x"]).reshape(-1, dim), here[1])
                anchors = held.get(row["a_id"].as_py())
                if anchors is None:
                    if anchors_held > HELD:
                        yield from _kept(kind, held)
                        held, anchors_held = {}, 0
                    anchors = held[row["a_id"].as_py()] = kind.anchors(row)
                    anchors_held += len(anchors[0])
                scores = packed[1].scores(_numbers(row["a_x"]).reshape(-1, dim))
                kind.take(anchors, scores, _numbers(row["ids"]), _numbers(row["labels"]))
        yield from _kept(kind, held)

    return both.mapInArrow(run, schema)


def _kept(kind, held: dict) -> Iterator[pa.RecordBatch]:
    for a_id, anchors in held.items():
        out = kind.rows(a_id, anchors)
        if out.num_rows:
            yield out


def _numbers(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.int64)


class _Best:
    """The ``k`` best (score, id) seen so far of each of ``n`` rows."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def add(self, row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.ids[row]) == self.k:
            good = scores >= self.scores[row][-1]
            if not good.any():
                return
            ids, scores = ids[good], scores[good]
        if len(ids) > 4 * self.k:  # ties at the k-th score stay
            good = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[good], scores[good]
        ids, scores = np.r_[self.ids[row], ids], np.r_[self.scores[row], scores]
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[row], self.scores[row] = ids[order], scores[order]


@dataclass(frozen=True)
class _Positives:
    """The best other rows of each anchor's label."""

    k: int

    def anchors(self, row):
        ids, labels = _numbers(row["a_ids"]), _numbers(row["a_labels"])
        return ids, labels, _Best(len(ids), self.k)

    def take(self, anchors, scores, ids, labels) -> None:
        own, kinds, best = anchors
        for kind in np.unique(kinds).tolist():
            columns = np.flatnonzero(labels == kind)
            for i in np.flatnonzero(kinds == kind).tolist():
                mine = columns[ids[columns] != own[i]]
                if len(mine):
                    best.add(i, ids[mine], scores[i, mine])

    def rows(self, a_id, anchors) -> pa.RecordBatch:
        own, _, best = anchors
        sizes = [len(x) for x in best.ids]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(sum(sizes), a_id)), pa.array(np.repeat(own, sizes)), pa.array(np.concatenate(best.ids)),
                pa.array(np.concatenate(best.scores)),
            ],
            ["a_id", "anchor_id", "found_id", "score"],
        )


@dataclass(frozen=True)
class _Negatives:
    """The best rows of other labels within the bounds of each of an anchor's positives."""

    k: int
    lowest: int
    highest: int

    def anchors(self, row):
        ids, labels = _numbers(row["a_ids"]), _numbers(row["a_labels"])
        place = {v: i for i, v in enumerate(ids.tolist())}
        wanted: dict[int, list] = {}
        for at, w in enumerate(row["wanted"].as_py()):
            wanted.setdefault(place[w["anchor_id"]], []).append((at, w["found_id"], w["score"]))
        return ids, labels, wanted, _Best(sum(map(len, wanted.values())), self.k)

    def take(self, anchors, scores, ids, labels) -> None:
        _, kinds, wanted, best = anchors
        for i, bounds in wanted.items():
            # positive * lowest <= score * 100 <= positive * highest, in whole numbers
            lows, tops = ([f(w) for w in bounds] for f in (self._low, self._top))
            mine = np.flatnonzero((scores[i] >= min(lows)) & (scores[i] <= max(tops)) & (labels != kinds[i]))
            for (at, _, _), low, top in zip(bounds, lows, tops):
                good = mine[(scores[i, mine] >= low) & (scores[i, mine] <= top)]
                if len(good):
                    best.add(at, ids[good], scores[i, good])

    def _low(self, wanted) -> int:
        return -(-wanted[2] * self.lowest // 100)

    def _top(self, wanted) -> int:
        return wanted[2] * self.highest // 100

    def rows(self, a_id, anchors) -> pa.RecordBatch:
        own, _, wanted, best = anchors
        sizes = [len(x) for x in best.ids]
        spread = lambda values: pa.array(np.repeat(np.array(values, np.int64), sizes))
        pairs = sorted((at, own[i], found, score) for i, bounds in wanted.items() for at, found, score in bounds)
        return pa.RecordBatch.from_arrays(
            [
                spread([p[1] for p in pairs]), spread([p[2] for p in pairs]), spread([p[3] for p in pairs]),
                pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores)),
            ],
            ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
        )
