"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfield.llm.common import Tables, arrow_rows
from inkfield.llm.vectors import cosines, matrix, unit, usable

K = 5
SAMPLE_ROWS = 20_000  # rows that the tree is fitted on, at most
BRANCHES = 16
LEAF_ROWS = 256
MAX_LEAVES = 4096  # bounds what is shipped to the tasks: the tree's centres
CALIBRATION = 200  # queries whose true neighbours calibrate the visits, at most
RECALL = 0.97
BLOCK = 4096


@dataclass(frozen=True)
class Tree:
    """Centres of all nodes; a node's children are ``first[i]`` to ``first[i] + count[i] - 1``, a leaf has none."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each unit row falls into, going to the nearest child at every level."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.count[at] > 0)
            if not len(inner):
                return at
            for node in np.unique(at[inner]):
                mine = inner[at[inner] == node]
                children = slice(self.first[node], self.first[node] + self.count[node])
                at[mine] = self.first[node] + np.argmax(x[mine] @ self.centres[children].T, axis=1)

    def leaves(self, x: np.ndarray):
        """Leaves for one unit vector, best bin first: a queue holds the unvisited nodes by their nearness."""
        queue = [(-1.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            n = self.count[node]
            if not n:
                yield node
                continue
            children = range(self.first[node], self.first[node] + n)
            near = self.centres[self.first[node] : self.first[node] + n] @ x
            for score, child in zip(near.tolist(), children):
                heapq.heappush(queue, (-score, child))


def fit_tree(sample: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 7) -> Tree:
    """A tree of about ``leaves`` leaves on unit rows, split by k-means level by level, the largest node first."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] if len(sample) else 1
    centres, first, count = [np.zeros(dim)], [0], [0]
    queue = [(-len(sample), 0, np.arange(len(sample)))]
    n = 1
    while queue and n < leaves:
        size, node, rows = heapq.heappop(queue)
        k = min(branches, leaves - n + 1, len(rows))
        if k < 2:
            continue
        own, parts = _kmeans(sample[rows], k, rng)
        if len(own) < 2:
            continue
        first[node], count[node] = len(centres), len(own)
        for c, part in zip(own, parts):
            heapq.heappush(queue, (-len(part), len(centres), rows[part]))
            centres.append(c)
            first.append(0)
            count.append(0)
        n += len(own) - 1
    return Tree(np.array(centres), np.array(first), np.array(count))


def _kmeans(x: np.ndarray, k: int, rng, turns: int = 12) -> tuple[np.ndarray, list[np.ndarray]]:
    """Spherical k-means; centres that lose all rows are given up."""
    centres = np.unique(x[rng.choice(len(x), k, replace=False)], axis=0)
    for _ in range(turns):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        kept = size > 1e-12
        centres = sums[kept] / size[kept][:, None]
    own = np.argmax(x @ centres.T, axis=1)
    used = np.unique(own)
    return centres[used], [np.flatnonzero(own == u) for u in used]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row of ``queries``, by cosine.

    ``vectors`` and ``queries`` have vec_id and embedding; a query's own vec_id is no candidate. Rows without vec_id and vectors
    that are null, zero or hold null or non-finite components take no part; repeated rows count once. Equal scores are
    ranked by vec_id. With fewer than ``k`` candidates all are returned; empty tables give an empty result.

    The tree is fitted on at most SAMPLE_ROWS rows, those with the least hash of vec_id, and every row is put in a leaf of it.
    How many leaves a query visits is calibrated: at most CALIBRATION queries are compared with all rows, and the
    visits are widened until the leaves hold ``recall`` of their true neighbours. Scores are exact.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "tree-search")
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable("embedding"))
    asked = tables.keep(
        queries.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable("embedding")).dropDuplicates(["vec_id"])
    )
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow()["embedding"]
    points = unit(matrix(sample.combine_chunks()))
    tree = fit_tree(points, max(1, min(MAX_LEAVES, n // LEAF_ROWS)))
    shipped = spark.sparkContext.broadcast(tree)
    kind = vectors.schema["embedding"].dataType.simpleString()
    leafed = tables.keep(
        arrow_rows(
            rows, lambda c: {"vec_id": c["vec_id"], "embedding": c["embedding"], "leaf": shipped.value.leaf_of(unit(matrix(c["embedding"])))},
            f"vec_id long, embedding {kind}, leaf long",
        )
    )
    sizes = {r["leaf"]: r["n"] for r in leafed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # at most MAX_LEAVES
    visits = _calibrated(leafed, asked, tree, k, recall)

    def visit(batches):
        tree = shipped.value
        for b in batches:
            at, leaf = [], []
            for i, x in enumerate(unit(matrix(b.column("embedding")))):
                seen = held = 0
                for node in tree.leaves(x):
                    if seen >= visits and held > k:
                        break
                    seen, held = seen + 1, held + sizes.get(node, 0)
                    if node in sizes:
                        at.append(i)
                        leaf.append(node)
            taken = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(leaf, pa.int64())], ["query_id", "x", "leaf"])

    asking = tables.keep(asked.select("vec_id", "embedding").mapInArrow(visit, f"query_id long, x {kind}, leaf long"))
    # Leaves with many rows or many queries are compared in blocks of either.
    parts = spark.createDataFrame([(leaf, -(-n // BLOCK)) for leaf, n in sizes.items()], "leaf long, blocks int")
    chunks = tables.keep(
        asking.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")).join(parts, "leaf")
    )
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left = leafed.join(chunks, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).withColumn(
        "chunk", every("chunks")
    )
    theirs = chunks.select(F.col("leaf").alias("leaf"), F.col("chunks").alias("m"), F.col("blocks").alias("n"))
    right = asking.join(theirs, "leaf").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("m"))).withColumn(
        "block", every("n")
    )

    def compare(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return best_of(
            asked["query_id"].to_numpy(), np.array(asked["x"].tolist(), np.float64),
            rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), np.float64), k,
        )

    keys = ["leaf", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def best_of(query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest of the rows for each query; every score is summed on its own, so equal vectors have equal scores."""
    near = unit(q) @ unit(x).T
    near[query_id[:, None] == vec_id[None, :]] = -2.0
    take = min(k, len(x))
    least = np.partition(near, len(x) - take, axis=1)[:, len(x) - take]
    i, j = np.nonzero((near >= least[:, None] - 1e-9) & (near > -1.5))
    out = pd.DataFrame({"query_id": query_id[i], "vec_id": vec_id[j], "score": cosines(q[i], x[j])}).drop_duplicates()
    out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return out.groupby("query_id", sort=False).head(k)


def exact_nearest(vectors: DataFrame, asked: pd.DataFrame, k: int = K) -> DataFrame:
    """The true neighbours of a few queries (at most CALIBRATION rows on the driver), with other columns of ``vectors``."""
    query_id = asked["vec_id"].to_numpy()
    q = np.array(asked["embedding"].tolist(), np.float64)
    more = [c for c in vectors.columns if c not in ("vec_id", "embedding")]

    def scan(batches):
        for b in batches:
            if len(b) and len(q):
                best = best_of(query_id, q, b.column("vec_id").to_numpy(), matrix(b.column("embedding")), k)
                yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    found = vectors.select("vec_id", "embedding").mapInArrow(scan, "query_id long, vec_id long, score double")
    return _ranked(found, k).join(vectors.select("vec_id", *more).dropDuplicates(["vec_id"]), "vec_id")


def _calibrated(leafed: DataFrame, asked: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit so that they hold ``recall`` of the true neighbours of the calibration queries."""
    some = asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATION).toPandas()
    if not len(some):
        return 1
    truth = exact_nearest(leafed, some, k).select("query_id", "leaf").toPandas()
    if not len(truth):
        return 1
    place = {}
    for query, x in zip(some["vec_id"], unit(np.array(some["embedding"].tolist(), np.float64))):
        place[query] = {leaf: i for i, leaf in enumerate(tree.leaves(x))}
    needed = np.sort([place[q][leaf] + 1 for q, leaf in zip(truth["query_id"], truth["leaf"])])
    return int(needed[math.ceil(recall * len(needed)) - 1])
