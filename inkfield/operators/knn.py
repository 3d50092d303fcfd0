"""Exact nearest neighbours: a scan for few queries, a pruned cell join for many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield import config
from inkfield.functions import vectors as X
from inkfield.functions.batches import pieces
from inkfield.operators import blocks as B
from inkfield.operators.cells import build_cells
from inkfield.operators.records import matrix_shape
from inkfield.session import materialize

# Queries up to this size travel to every task; beyond it they are joined.
QUERY_BROADCAST_BYTES = 64 << 20

METRICS = ("l2", "cosine")


def hits_schema(query_id: T.DataType, corpus_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_id),
            T.StructField("id", corpus_id),
            T.StructField("key", T.DoubleType()),
        ]
    )


def top_k(hits: DataFrame, k: int, by: list | None = None) -> DataFrame:
    """The k best hits per query, ranked from 1; a group limit prunes before the shuffle."""
    order = by or [F.col("key"), F.col("id")]
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distance(key: Column | str = "key", metric: str = "l2") -> Column:
    """User-facing value of a key: squared distance, distance or cosine."""
    key = F.col(key) if isinstance(key, str) else key
    if metric == "cosine":
        return -key
    return F.sqrt(key) if metric == "euclidean" else key


def plain(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v): whole-number ids as bigint, others as text; vectors as floats."""
    whole = isinstance(df.schema[id_].dataType, T.IntegralType)
    return df.select(
        F.col(id_).cast("bigint" if whole else "string").alias("id"), F.col(vector).cast("array<float>").alias("v")
    )


def scan_topk(corpus: DataFrame, queries: pa.Table, dim: int, k: int, metric: str, query_id: T.DataType) -> DataFrame:
    """One pass over the corpus with the queries at hand; each task keeps k hits per query.

    ``corpus`` is (id, v); ``queries`` must be of checked size.
    """
    sc = corpus.sparkSession.sparkContext
    held = sc.broadcast((queries.column("id").combine_chunks(), B.matrix_of(queries.column("v"), dim)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = held.value
        q = B.prepare(q, metric, "query")
        state = None
        for b in (p for batch in batches for p in pieces(batch)):
            c = B.prepare(B.matrix_of(b.column(1), dim), metric, "corpus")
            found = B.block_topk(q, c, b.column(0), k, metric)
            if state is not None:
                found = tuple(np.concatenate(p) for p in zip(state, found))
                pick = B.best(*found, k)
                found = tuple(p[pick] for p in found)
            state = found
        if state is not None:
            qi, ids, key = state
            yield pa.RecordBatch.from_arrays(
                [q_ids.take(pa.array(qi)), pa.array(ids), pa.array(key)], names=["query_id", "id", "key"]
            )

    return corpus.mapInArrow(scan, hits_schema(query_id, corpus.schema["id"].dataType))


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = config.BENCH_K,
    metric: str = "l2",
    *,
    id_: str = "id",
    vector: str = "embedding",
    query_id: str | None = None,
    query_vector: str | None = None,
    exclude_self: bool = False,
    broadcast_bytes: int = QUERY_BROADCAST_BYTES,
) -> DataFrame:
    """Exact k nearest neighbours of every query: (query_id, id, key, rank).

    ``key`` is the squared distance or minus the cosine; see ``distance``. Ties are broken by id.
    The number of queries decides the way: at most ``broadcast_bytes`` of them are shipped to one scan of
    the corpus, more are joined through cells (``knn_join``).
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    q = plain(queries, query_id or id_, query_vector or vector)
    c = plain(corpus, id_, vector)
    n, dim = matrix_shape(q, "v")
    wanted = k + 1 if exclude_self else k
    if n * dim * 8 <= broadcast_bytes:
        hits = scan_topk(c, q.toArrow(), dim, wanted, metric, q.schema["id"].dataType)
    else:
        hits = knn_join(c, q, dim, wanted, metric)
    if exclude_self:
        hits = hits.where(F.col("id") != F.col("query_id"))
    return top_k(hits, k)


def first_copies(rows: DataFrame, k: int) -> DataFrame:
    """At most k rows per distinct vector, those with the smallest ids.

    Further copies can never be among k nearest: k rows at the same distance come before them. A vector
    that fills a third of the table shrinks to k rows per task before the shuffle.
    """
    w = Window.partitionBy("v").orderBy("id")
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def knn_join(corpus: DataFrame, queries: DataFrame, dim: int, k: int, metric: str, pivots: int | None = None) -> DataFrame:
    """Exact k nearest neighbours for any number of queries: up to k hits per (query_id, id, key).

    Both sides are (id, v). Copies are searched once. The corpus is cut into cells around pivots; each
    query first visits its nearest cell, which bounds its k-th distance, and then only those cells that
    the triangle inequality cannot rule out, in tiles of queries and of the corpus that are not shuffled. Nothing is sampled away: pivots only shape the cells.
    """
    reps = queries.groupBy("v").agg(F.min("id").alias("id"))
    reps = materialize(reps.select("id", "v"), "knn-queries")
    distinct = materialize(first_copies(corpus, k), "knn-corpus")
    index = build_cells(distinct, dim, metric, pivots=pivots)
    near = materialize(index.search(reps, k, probes=1), "knn-near")
    bound = top_k(near, k).groupBy("query_id").agg(F.max("key").alias("kth"), F.count("*").alias("n"))
    kth = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("inf")))
    bounded = reps.join(bound, reps["id"] == bound["query_id"], "left").select("id", "v", kth.alias("kth"))
    found = index.nearest(bounded, k, "kth")
    # Written, so that the join below is of two plain shuffles and a vector with many owners can be split.
    hits = materialize(top_k(found, k), "knn-hits").select(
        F.col("query_id").alias("__rep"), F.col("id").alias("hit"), "key"
    )
    owners = queries.join(reps.select(F.col("id").alias("__rep"), "v"), "v").select(F.col("id").alias("query_id"), "__rep")
    return owners.join(hits, "__rep").select("query_id", F.col("hit").alias("id"), "key")


def similar_pairs(
    rows: DataFrame, threshold: float, *, id_: str = "id", vector: str = "embedding", pivots: int | None = None
) -> DataFrame:
    """Pairs of distinct vectors with a cosine of at least ``threshold``: (id_a, id_b, score, n_a, n_b).

    The all-pairs matrix, restricted to what is similar. Copies stand behind their smallest id, with their
    number, so a vector held by many rows gives one row per partner and not one per pair of rows.
    ``threshold`` must be positive.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive: below it, the result is every pair")
    named = plain(rows, id_, vector)
    _, dim = matrix_shape(named, "v")
    reps = named.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    reps = materialize(reps.select("id", "v", "n"), "pair-reps")
    nonzero = reps.where(F.exists("v", lambda x: x != 0) & F.col("id").isNotNull())
    pairs = build_cells(nonzero, dim, "cosine", pivots=pivots, carry="n").pairs(threshold)
    return pairs.withColumnsRenamed({"carried_a": "n_a", "carried_b": "n_b"})


def score_against(corpus: DataFrame, query: list[float], metric: str, *, id_: str, vector: str) -> DataFrame:
    """Every corpus row with its distance or cosine to one vector: (id, value)."""
    q = F.lit([float(x) for x in query]).cast("array<double>")
    f = {"l2": X.squared_l2, "euclidean": X.l2, "cosine": X.cosine}[metric]
    return corpus.select(F.col(id_).alias("id"), F.round(f(vector, q), B.KEY_DIGITS).alias("value"))


def nearest(corpus: DataFrame, query: list[float], k: int, metric: str = "euclidean", *, id_="id", vector="embedding") -> DataFrame:
    """The k rows nearest to one vector; a bounded heap per task."""
    order = F.desc("value") if metric == "cosine" else F.asc("value")
    return score_against(corpus, query, metric, id_=id_, vector=vector).orderBy(order, "id").limit(k)


def ranked(corpus: DataFrame, query: list[float], metric: str = "cosine", *, id_="id", vector="embedding") -> DataFrame:
    """All rows ordered by their closeness to one vector."""
    order = F.desc("value") if metric == "cosine" else F.asc("value")
    return score_against(corpus, query, metric, id_=id_, vector=vector).orderBy(order, "id")


def mean_vectors(rows: DataFrame, by: str | None, vector: str = "embedding") -> DataFrame:
    """Mean vector per group (or of all rows): element sums are combined map-side."""
    keys = [by] if by else []
    elements = rows.select(*keys, F.posexplode(vector).alias("pos", "x"))
    means = elements.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One value per dimension is left per group.
    at = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(*keys).agg(F.transform(at, lambda e: e["m"]).alias(vector))
