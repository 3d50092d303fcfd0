"""Vectors laid out in cells around centroids, and searches that visit some of the cells.

The layout serves the approximate search (a fixed number of cells) and the exact joins (as many cells as
the triangle inequality demands). A cell is a set of blocks, so a crowded cell is many rows of work.

The exact joins may have to compare everything. Their vectors travel in tiles of some thousands, and each pair of
tiles meets in a product of the two tables that is not shuffled: what is moved and stored grows with the rows, not
with the cells that each of them visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield.operators import blocks as B
from inkfield.session import materialize

# Blocks of a cell that share one join key; more blocks are spread over more keys.
BLOCKS_PER_KEY = 16

# Cells of the exact joins: the square root of the rows, within these.
MIN_PIVOTS, MAX_PIVOTS = 16, 4096

# Vectors of a tile of the exact joins.
TILE_ROWS = 4096

# Rows of visits that a task hands on at a time.
VISITS_AT_ONCE = 16_384

# Queries up to this number travel to every task of an approximate search.
HELD_QUERIES = 2048

# Visits up to this size are broadcast.
VISIT_BROADCAST_BYTES = 64 << 20


def pick_pivots(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """n rows spread by the hash of their id, as float32; the same ones every time."""
    top = rows.orderBy(F.xxhash64("id"), "id").limit(n).select("v")
    return B.matrix_of(top.toArrow().column("v"), dim)


def assign(rows: DataFrame, centroids: np.ndarray, metric: str, *carry: str) -> DataFrame:
    """(id, v, *carry) with the nearest centroid and the distance to it: (id, v, *carry, cell, dist)."""
    dim = centroids.shape[1]
    held = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType(
        [
            rows.schema["id"],
            rows.schema["v"],
            *(rows.schema[c] for c in carry),
            T.StructField("cell", T.IntegerType()),
            T.StructField("dist", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = B.prepare(held.value, metric, "corpus")
        for b in batches:
            x = B.prepare(B.matrix_of(b.column(1), dim), metric, "corpus")
            cell, dist = B.nearest_centre(x, c)
            dist = np.sqrt(dist)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], names=schema.names)

    return rows.select("id", "v", *carry).mapInArrow(run, schema)


class Bounds:
    """Which cells may hold something near a query, by the triangle inequality."""

    def __init__(self, centroids: np.ndarray, cells: dict[int, tuple[float, int]], metric: str):
        self.names = np.array(sorted(cells), np.int32)
        self.radii = np.array([cells[c][0] for c in self.names])
        self.c = B.prepare(centroids[self.names], metric, "corpus")
        self.gaps = np.sqrt(B.squared_distances(self.c, self.c))
        self.size = float(np.sqrt(np.einsum("ij,ij->i", self.c, self.c).max()))

    def visit(self, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of prepared queries and their radii, queries by cells: which to visit; and the nearest cell of each."""
        d2 = B.squared_distances(q, self.c)
        home = np.argmin(d2, axis=1)
        # Rounding grows with the vectors' length; two centroids in one place bound nothing.
        size = max(1.0, self.size, float(np.sqrt(np.einsum("ij,ij->i", q, q).max())))
        reach = r[:, None] + 1e-6 * size
        visit = np.sqrt(d2) - self.radii[None, :] <= reach
        gap = self.gaps[home]
        plane = (d2 - d2[np.arange(len(q)), home][:, None]) / np.maximum(2 * gap, 1e-6 * size)
        visit &= (plane <= reach) | (gap <= 1e-6 * size)
        return visit, home

    def visits(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """What ``visit`` says of any number of queries, some at a time."""
        step = max(1, 500_000 // len(self.names))
        return np.concatenate([self.visit(q[at : at + step], r[at : at + step])[0] for at in range(0, len(q), step)])


@dataclass
class CellIndex:
    """Blocks of vectors by cell on shared storage, with centroids and per-cell radius."""

    blocks: DataFrame  # cell, n, ids, data, radius
    centroids: np.ndarray
    metric: str
    id_type: T.DataType
    cells: dict[int, tuple[float, int]]  # cell -> (radius, keys to spread over)

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    @staticmethod
    def open(blocks: DataFrame, centroids: np.ndarray, metric: str) -> "CellIndex":
        # One row per cell: as many as there are centroids.
        stats = blocks.groupBy("cell").agg(F.max("radius").alias("r"), F.count("*").alias("n")).collect()
        cells = {s["cell"]: (s["r"], -(-s["n"] // BLOCKS_PER_KEY)) for s in stats}
        return CellIndex(blocks, centroids, metric, blocks.schema["ids"].dataType.elementType, cells)

    def _keyed_blocks(self, only: list[int] | None) -> DataFrame:
        spark = self.blocks.sparkSession
        spread = spark.createDataFrame([(c, s) for c, (_, s) in self.cells.items()], "cell int, spread int")
        blocks = self.blocks if only is None else self.blocks.where(F.col("cell").isin(only))
        return (
            blocks.join(F.broadcast(spread), "cell")  # one row per centroid
            .withColumn("part", F.pmod(F.xxhash64("ids"), F.col("spread")).cast("int"))
            .select("cell", "part", F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
        )

    def _visits(self, queries: DataFrame, probes: int | None, theta: str | None, radius: float | None) -> DataFrame:
        """(cell, part, id, v): each query once per cell to visit and per key of that cell.

        ``probes`` visits the nearest cells; ``theta`` (a column, null = unbounded) or ``radius`` visit all
        cells that may hold something that near. With ``theta`` the nearest cell counts as visited.
        """
        dim, metric, cells = self.dim, self.metric, self.cells
        held = queries.sparkSession.sparkContext.broadcast(self.centroids)
        schema = T.StructType(
            [
                T.StructField("cell", T.IntegerType()),
                T.StructField("part", T.IntegerType()),
                T.StructField("id", queries.schema["id"].dataType),
                T.StructField("v", queries.schema["v"].dataType),
            ]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = np.array(sorted(cells), np.int32)
            bounds = Bounds(held.value, cells, metric) if probes is None else None
            spread = np.array([cells[c][1] for c in names], np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                step = max(1, 500_000 // len(names))
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    q = B.prepare(B.matrix_of(part.column(1), dim), metric, "query")
                    if probes is not None:
                        visit, _ = _nearest_cells(q, held.value, cells, metric, probes)
                    else:
                        if theta:
                            r = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                            r = np.where(np.isnan(r), np.inf, r)
                        else:
                            r = np.full(len(q), radius)
                        visit, home = bounds.visit(q, r)
                        if theta:
                            visit[np.arange(len(q)), home] = False
                    qi, ci = np.nonzero(visit)
                    if not len(qi):
                        continue
                    last = np.cumsum(spread[ci])
                    # The visits may be many times the queries: a bounded number of rows is made at a time.
                    for first in range(0, int(last[-1]), VISITS_AT_ONCE):
                        row = np.arange(first, min(first + VISITS_AT_ONCE, int(last[-1])))
                        of = np.searchsorted(last, row, side="right")
                        key = row - (last[of] - spread[ci[of]])
                        take = pa.array(qi[of])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(names[ci[of]]),
                                pa.array(key.astype(np.int32)),
                                part.column(0).take(take),
                                part.column(1).take(take),
                            ],
                            names=["cell", "part", "id", "v"],
                        )

        columns = ["id", "v"] + ([theta] if theta else [])
        return queries.select(*columns).mapInArrow(run, schema)

    def reading(self, queries: DataFrame, probes: int) -> dict:
        """How to search for this many queries: the cells to read, and whether the visits are few.

        A few queries visit a few cells, and only these are read. Few visits are broadcast, as their bytes
        are bounded by their number here; the planner would go by the size of the input they come from.
        """
        n = queries.count()
        spread = max((s for _, s in self.cells.values()), default=1)
        few = n * probes * spread * (self.dim * 4 + 64) <= VISIT_BROADCAST_BYTES
        if n * probes * 2 > len(self.cells):
            return {"few": few}
        visited = self._visits(queries, probes, None, None).select("cell").distinct()
        return {"few": few, "only": [r["cell"] for r in visited.collect()]}

    def scan(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """``search`` for at most HELD_QUERIES queries: they travel to every task, the lists are read where they lie.

        Up to k hits per query and task: (query_id, id, key).
        """
        dim, metric, cells = self.dim, self.metric, self.cells
        q = queries.toArrow()  # at most HELD_QUERIES rows
        held = queries.sparkSession.sparkContext.broadcast(
            (q.column("id").combine_chunks(), B.matrix_of(q.column("v"), dim), self.centroids)
        )
        schema = T.StructType(
            [
                T.StructField("query_id", queries.schema["id"].dataType),
                T.StructField("id", self.id_type),
                T.StructField("key", T.DoubleType()),
            ]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q, centroids = held.value
            q = B.prepare(q, metric, "query")
            visit, names = _nearest_cells(q, centroids, cells, metric, probes)
            at = {int(cell): k for k, cell in enumerate(names)}
            state = None
            for row in _rows(batches):
                rows = np.flatnonzero(visit[:, at[row["cell"].as_py()]])
                if not len(rows):
                    continue
                c = B.prepare(_matrix(row["data"], dim), metric, "corpus")
                qi, ids, key = B.block_topk(q[rows], c, row["ids"].values, k, metric)
                found = rows[qi], ids, key
                if state is not None:
                    found = tuple(np.concatenate(p) for p in zip(state, found))
                    pick = B.best(*found, k)
                    found = tuple(p[pick] for p in found)
                state = found
            if state is not None:
                qi, ids, key = state
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(qi)), pa.array(ids), pa.array(key)], names=schema.names)

        visit, names = _nearest_cells(B.prepare(held.value[1], metric, "query"), self.centroids, cells, metric, probes)
        visited = names[visit.any(axis=0)].tolist()
        blocks = self.blocks if len(visited) == len(cells) else self.blocks.where(F.col("cell").isin(visited))
        return blocks.select("cell", "ids", "data").mapInArrow(run, schema)

    def _meet(self, visits: DataFrame, only: list[int] | None = None, few: bool = False) -> DataFrame:
        """Query blocks next to the corpus blocks of their cell; an equi-join on (cell, part).

        Unless they are known to be few, the visits are never broadcast.
        """
        q = B.pack_blocks(visits, ["cell", "part"], "id", "v", self.dim)
        q = q.select("cell", "part", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
        q = F.broadcast(q) if few else q.hint("merge")
        return q.join(self._keyed_blocks(only), ["cell", "part"]).select("q_ids", "q_data", "c_ids", "c_data", "cell")

    def search(
        self, queries: DataFrame, k: int, probes: int | None = None, theta: str | None = None, **reading
    ) -> DataFrame:
        """Up to k hits per query and block pair: (query_id, id, key); rank them with ``top_k``.

        ``reading`` is what the method of that name says.
        """
        dim, metric = self.dim, self.metric
        schema = T.StructType(
            [
                T.StructField("query_id", queries.schema["id"].dataType),
                T.StructField("id", self.id_type),
                T.StructField("key", T.DoubleType()),
            ]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    q_ids, q, c_ids, c = _sides(b, i, dim)
                    qi, ids, key = B.block_topk(
                        B.prepare(q, metric, "query"), B.prepare(c, metric, "corpus"), c_ids, k, metric
                    )
                    yield pa.RecordBatch.from_arrays(
                        [q_ids.take(pa.array(qi)), pa.array(ids), pa.array(key)], names=["query_id", "id", "key"]
                    )

        return self._meet(self._visits(queries, probes, theta, None), **reading).mapInArrow(run, schema)

    def _tiles(self, blocks: DataFrame, radii=None) -> DataFrame:
        """Blocks of neighbouring cells put together: (tile, cells, sizes, ids, data[, carried][, visits]).

        ``cells`` and ``sizes`` say how many rows of which cell follow each other. ``radii``, a function of what is
        carried, gives the distance that each row looks around itself; ``visits`` are the cells in reach of any row.
        """
        dim, metric, cells = self.dim, self.metric, self.cells
        held = blocks.sparkSession.sparkContext.broadcast(self.centroids)
        carried = [f for f in blocks.schema if f.name == "carried"]
        whole = T.ArrayType(T.IntegerType())
        fields = [T.StructField("tile", T.LongType()), T.StructField("cells", whole), T.StructField("sizes", whole)]
        fields += [blocks.schema["ids"], blocks.schema["data"], *carried]
        fields += [T.StructField("visits", whole)] if radii else []
        schema = T.StructType(fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = Bounds(held.value, cells, metric) if radii else None
            tile = TaskContext.get().partitionId() << 33

            def together(rows: list[dict]) -> pa.RecordBatch:
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                data = b"".join(r["data"] for r in rows)
                sizes = pa.array([len(r["ids"]) for r in rows], pa.int32())
                out = [pa.array([tile]), one(pa.array([r["cell"] for r in rows], pa.int32())), one(sizes)]
                out += [one(pa.concat_arrays([r["ids"] for r in rows])), pa.array([data], pa.binary())]
                if carried:
                    values = pa.concat_arrays([r["carried"] for r in rows])
                    out.append(one(values))
                if bounds:
                    q = B.prepare(np.frombuffer(data, np.float32).reshape(-1, dim), metric, "query")
                    visit = bounds.visits(q, radii(values.to_numpy(zero_copy_only=False))).any(axis=0)
                    out.append(one(pa.array(bounds.names[visit])))
                return pa.RecordBatch.from_arrays(out, names=schema.names)

            rows, n = [], 0
            for b in batches:
                at = {name: b.column(k) for k, name in enumerate(b.schema.names)}
                for i in range(b.num_rows):
                    ids = at["ids"][i].values
                    if rows and n + len(ids) > TILE_ROWS:
                        yield together(rows)
                        rows, n, tile = [], 0, tile + 1
                    row = {"cell": at["cell"][i].as_py(), "ids": ids, "data": at["data"][i].as_py()}
                    rows.append(row | ({"carried": at["carried"][i].values} if carried else {}))
                    n += len(ids)
            if rows:
                yield together(rows)

        return blocks.select("cell", "ids", "data", *(f.name for f in carried)).mapInArrow(run, schema)

    def _product(self, q: DataFrame, c: DataFrame, tasks: int, only=None) -> DataFrame:
        """Pairs of tiles of which the first visits cells of the second; nothing is shuffled.

        A task holds a partition of ``q``, some tiles, and reads ``c`` once, or a part of it where the ``tasks`` are few.
        """
        parts = max(1, 2 * q.sparkSession.sparkContext.defaultParallelism // tasks)
        q = q.select(*(F.col(x).alias(f"q_{x}") for x in q.columns))
        c = c.coalesce(parts).select(*(F.col(x).alias(f"c_{x}") for x in c.columns if x != "visits"))
        meet = F.arrays_overlap("q_visits", "c_cells")
        c = c.hint("shuffle_replicate_nl")
        # The side named first is read as a stream, the other one is held.
        return c.join(q, meet if only is None else meet & only).drop("q_visits")

    def nearest(self, queries: DataFrame, k: int, kth: str) -> DataFrame:
        """Up to k hits per query and part of the corpus: (query_id, id, key); rank them with ``top_k``.

        The column ``kth`` is a key within which the query has k hits, inf where that is not known.
        """
        dim, metric, cells = self.dim, self.metric, self.cells
        radii = lambda keys: radii_of(keys, metric)
        held = queries.sparkSession.sparkContext.broadcast(self.centroids)
        assigned = assign(queries, self.centroids, metric, kth)
        parts = max(1, -(-queries.count() // TILE_ROWS))
        q = self._tiles(B.pack_blocks(assigned, ["cell"], "id", "v", dim, carry=kth, partitions=parts), radii)
        c = materialize(self._tiles(self.blocks.drop("carried")), "tiles")
        schema = T.StructType(
            [
                T.StructField("query_id", queries.schema["id"].dataType),
                T.StructField("id", self.id_type),
                T.StructField("key", T.DoubleType()),
            ]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = Bounds(held.value, cells, metric)
            searches = {}
            for row in _rows(batches):
                tile = row["q_tile"].as_py()
                if tile not in searches:
                    known = row["q_carried"].values.to_numpy(zero_copy_only=False)
                    found = B.Nearest(_matrix(row["q_data"], dim), known, k, metric)
                    ids = row["q_ids"].values.take(pa.array(np.arange(len(known))))  # a copy, as the batch goes
                    searches[tile] = ids, found, bounds.visits(found.q, radii(known))
                _, found, visits = searches[tile]
                q_at, c_at = _in_reach(row, bounds, visits)
                if len(q_at):
                    c_ids = row["c_ids"].values
                    every = len(c_at) == len(c_ids)
                    c = _matrix(row["c_data"], dim)
                    found.see(q_at, c if every else c[c_at], c_ids if every else c_ids.take(pa.array(c_at)))
            for q_ids, found, _ in searches.values():
                if found.found:
                    qi, ids, key = found.found
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(qi)), pa.array(ids), pa.array(key)], names=schema.names)

        return self._product(q, c, parts).mapInArrow(run, schema)

    def pairs(self, threshold: float) -> DataFrame:
        """Pairs of the vectors, for cosine cells with something carried: (id_a < id_b, score, carried_a, carried_b).

        Two tiles are compared once, by a task that a hash of both chooses.
        """
        dim, metric, cells = self.dim, self.metric, self.cells
        radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
        radii = lambda values: np.full(len(values), radius)
        held = self.blocks.sparkSession.sparkContext.broadcast(self.centroids)
        carried = self.blocks.schema["carried"].dataType.elementType
        schema = T.StructType(
            [
                T.StructField("id_a", self.id_type),
                T.StructField("id_b", self.id_type),
                T.StructField("score", T.DoubleType()),
                T.StructField("carried_a", carried),
                T.StructField("carried_b", carried),
            ]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = Bounds(held.value, cells, metric)
            tiles = {}
            for row in _rows(batches):
                tile = row["q_tile"].as_py()
                if tile not in tiles:
                    q = B.prepare(_matrix(row["q_data"], dim), metric, "query")
                    more = row["q_carried"].values.to_numpy(zero_copy_only=False).copy()
                    tiles[tile] = q, B.ids_of(row["q_ids"].values).copy(), more, bounds.visits(q, radii(q))
                q, left, left_more, visits = tiles[tile]
                q_at, c_at = _in_reach(row, bounds, visits)
                if not len(q_at):
                    continue
                c = B.prepare(_matrix(row["c_data"], dim), metric, "corpus")[c_at]
                right, right_more = B.ids_of(row["c_ids"].values), row["c_carried"].values.to_numpy(zero_copy_only=False)
                same = tile == row["c_tile"].as_py()
                for qi, ci, score in B.block_cosines(q[q_at], c, threshold):
                    qi, ci = q_at[qi], c_at[ci]
                    a, b = left[qi], right[ci]
                    keep = a < b if same else a != b
                    qi, ci, a, b, score = (x[keep] for x in (qi, ci, a, b, score))
                    first = a < b
                    ids = np.where(first, a, b), np.where(first, b, a)
                    m, n = left_more[qi], right_more[ci]
                    more = np.where(first, m, n), np.where(first, n, m)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*ids, score, *more)], names=schema.names)

        tiles = materialize(self._tiles(self.blocks, radii), "tiles")
        pair = F.pmod(F.xxhash64(F.least("q_tile", "c_tile"), F.greatest("q_tile", "c_tile")), F.lit(2)) == 0
        once = (F.col("q_tile") == F.col("c_tile")) | ((F.col("q_tile") < F.col("c_tile")) == pair)
        parts = max(1, tiles.count())
        return self._product(tiles.repartition(parts), tiles, parts, once).mapInArrow(run, schema)


def _nearest_cells(
    q: np.ndarray, centroids: np.ndarray, cells: dict[int, tuple[float, int]], metric: str, probes: int
) -> tuple[np.ndarray, np.ndarray]:
    """Of prepared queries, queries by cells: which are among the ``probes`` nearest; and the names of the cells."""
    names = np.array(sorted(cells), np.int32)
    d2 = B.squared_distances(q, B.prepare(centroids[names], metric, "corpus"))
    p = min(probes, len(names))
    visit = np.ones(d2.shape, bool)
    if p < len(names):
        visit[:] = False
        np.put_along_axis(visit, np.argpartition(d2, p - 1, axis=1)[:, :p], True, axis=1)
    return visit, names


def radii_of(keys: np.ndarray, metric: str) -> np.ndarray:
    """Distances in which everything with at most these keys lies."""
    return np.sqrt(np.maximum(2 + 2 * keys if metric == "cosine" else keys, 0.0) + 1e-8)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i] for k, name in enumerate(b.schema.names)}


def _matrix(data: pa.Scalar, dim: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.float32).reshape(-1, dim)


def _in_reach(row: dict[str, pa.Scalar], bounds: Bounds, visits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first tile that visit a cell of the second, and rows of the second in cells that are visited."""
    visit = visits[:, np.searchsorted(bounds.names, row["c_cells"].values.to_numpy())]
    sizes = row["c_sizes"].values.to_numpy()
    return np.flatnonzero(visit.any(axis=1)), np.flatnonzero(np.repeat(visit.any(axis=0), sizes))


def _sides(b: pa.RecordBatch, i: int, dim: int):
    """Ids and matrices of the two blocks in row i."""
    q = np.frombuffer(b.column(1)[i].as_buffer(), np.float32).reshape(-1, dim)
    c = np.frombuffer(b.column(3)[i].as_buffer(), np.float32).reshape(-1, dim)
    return b.column(0)[i].values, q, b.column(2)[i].values, c


def build_cells(rows: DataFrame, dim: int, metric: str, pivots: int | None = None, carry: str | None = None) -> CellIndex:
    """Cells around pivots taken from the rows, for the exact joins; the blocks also hold the column ``carry``."""
    n = pivots or int(min(MAX_PIVOTS, max(MIN_PIVOTS, rows.count() ** 0.5)))
    centroids = pick_pivots(rows, n, dim)
    assigned = assign(rows, centroids, metric, *([carry] if carry else []))
    packed = B.pack_blocks(assigned, ["cell"], "id", "v", dim, extra="dist", carry=carry)
    return CellIndex.open(materialize(packed, "cells"), centroids, metric)
