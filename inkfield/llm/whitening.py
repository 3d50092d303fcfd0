"""Whitening of embeddings: principal components of whole-number vectors, scaled to unit variance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.llm.bidiagonal import right_singular
from inkfield.llm.common import Tables

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000  # an entry c becomes the whole number floor(SCALE * c) + OFFSET
LARGEST = 2.0**34  # entries beyond this have no exact whole number beside the others
FAN_IN = 32  # triangular factors joined at once
RANK = 1e-12  # singular values below this share of the largest are rounding
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row of ``vectors``.

    ``vectors`` has vec_id and embedding; other columns are ignored. The components are fitted on each distinct whole-number vector
    once, so repeated rows do not weigh; each of them gets its result, with a null vec_id too. Rows take no part whose vector
    is null, empty, holds a null, a non-finite entry or one beyond 2**34, or has another length than most (of lengths equally
    common the greater one). Components without variance are not returned: a table of one distinct vector, like an empty
    one, gives no rows. Components of equal variance come in no special order. ``deviation`` is null where it
    does not fit a long.

    Sums are exact. Centred rows are reduced by QR in every task, the triangular factors joined FAN_IN at a time, and the last one is
    solved by ``bidiagonal.right_singular``; the covariance itself is never formed. One factor is d x d whatever the rows.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "whitening")
    rows = vectors.select("vec_id", "embedding").where(_usable("embedding"))
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    d = common["d"]
    rows = rows.where(F.size("embedding") == d).select("vec_id", _whole("embedding").alias("x"))
    fit = tables.keep(rows.select("x").distinct())
    n, sums = _sums(fit, d)
    values, axes = _principal(tables, fit, n, sums)
    kept = min(components, int((values > RANK * values[0]).sum())) if values[0] > 0 else 0
    if not kept:
        return spark.createDataFrame([], RESULT)
    variance = values * values / n
    weights = axes[:, :kept] / np.sqrt(variance[:kept])
    explained = variance[:kept] / variance.sum()
    error = _identity_error(fit, n, sums, weights)
    tables.drop(fit)
    whole, part = _mean(n, sums)

    def project(batches):
        for b in batches:
            near = _matrix(b.column(1), d) - whole
            out = (near - part / n) @ weights
            m = len(near)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * kept, n)),
                    pa.array(_deviation(near, part, n), pa.int64()).take(pa.array(np.repeat(np.arange(m), kept))),
                    pa.array(out.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * kept, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, RESULT)


def _usable(column: str) -> Column:
    """Whether every entry of a vector is there, finite and of a size whose whole number is exact."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    return F.coalesce(~bad & (F.size(column) > 0), F.lit(False))


def _whole(column: str) -> Column:
    return F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET).cast("long"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and the exact sum of each place; tasks send one row of sums for each place."""

    def partial(batches):
        for b in batches:
            x = _matrix(b.column(0), d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, len(x))), pa.array(x.sum(axis=0))], ["place", "n", "s"]
            )

    found = fit.mapInArrow(partial, "place int, n long, s long").groupBy("place")
    found = found.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()
    sums = {r["place"]: int(r["s"]) for r in found}
    return int(found[0]["n"]), [sums[k] for k in range(d)]


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and what is left of the sums beyond n times those, so that x - mean is exact but for one rounding."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def _principal(tables: Tables, fit: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors of the centred fit rows."""
    d = len(sums)
    whole, part = _mean(n, sums)

    def centred(b):
        return _matrix(b.column(0), d) - whole - part / n

    def factors(b):
        return _matrix(b.column(0), d)

    def reduced(rows_of):
        def run(batches):
            r = np.zeros((0, d))
            for b in batches:
                for at in range(0, len(x := rows_of(b)), 4 * d):
                    r = np.linalg.qr(np.vstack([r, x[at : at + 4 * d]]), mode="r")
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], ["r"])

        return run

    level = tables.keep(fit.mapInArrow(reduced(centred), "r array<double>"))
    while (count := level.count()) > FAN_IN:
        below, level = level, tables.keep(level.repartition(math.ceil(count / FAN_IN)).mapInArrow(reduced(factors), "r array<double>"))
        tables.drop(below)
    stacked = np.vstack([np.array(r["r"]).reshape(-1, d) for r in level.collect()])  # FAN_IN factors at most
    tables.drop(level)
    return right_singular(stacked)


def _identity_error(fit: DataFrame, n: int, sums: list[int], weights: np.ndarray) -> float:
    """Largest entry by which the covariance of the whitened fit rows differs from the identity."""
    (d, k), (whole, part) = weights.shape, _mean(n, sums)

    def moments(batches):
        total = np.zeros((k, k + 1))
        for b in batches:
            w = (_matrix(b.column(0), d) - whole - part / n) @ weights
            total += np.column_stack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros((k, k + 1))
    for r in fit.mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"] / n
    mean = out[:, k]
    return float(np.abs(out[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(near: np.ndarray, part: np.ndarray, n: int) -> list[int | None]:
    """Exact sums of (n x - S) ** 2 over the places, where near is x less the whole mean."""
    wide = not len(near) or int(np.abs(near).max()) ** 2 >= 2**62 // len(part) or int(np.abs(near).max()) * n >= 2**62 // len(part)
    x, p = (near.astype(object), part.astype(object)) if wide else (near, part)
    own, rest = sum(int(v) ** 2 for v in part.tolist()), (x * p).sum(axis=1).tolist()
    found = (n * n * a - 2 * n * b + own for a, b in zip((x * x).sum(axis=1).tolist(), rest))
    return [v if v < 2**63 else None for v in found]
