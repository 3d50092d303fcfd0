"""Numeric kernels over blocks of vectors, and the Arrow plumbing that feeds them.

Distances are taken in double. Keys are ascending (squared distance, or minus the cosine) and are rounded
to nine decimals, so that equal vectors tie exactly and ties are broken by id in every layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 4096
_CELLS_PER_PASS = 1_000_000
KEY_DIGITS = 9


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as a sortable array: integers, or text in code point order as Spark sorts it."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array(column.to_pylist(), dtype=str)


def matrix_of(column: pa.Array, dim: int, dtype=np.float32) -> np.ndarray:
    """A list column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim:
        raise ValueError(f"vectors are not all of dimension {dim}")
    return flat.astype(dtype, copy=False).reshape(-1, dim)


def list_column(m: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    m = np.ascontiguousarray(m)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def prepare(x: np.ndarray, metric: str, side: str) -> np.ndarray:
    """Vectors in double, ready for ``keys``.

    For the cosine, unit vectors with two more coordinates: a zero vector is put on an axis of its own,
    one per side, so its cosine with everything is zero and cosine order is distance order throughout.
    """
    x = x.astype(np.float64)
    if metric != "cosine":
        return x
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    zero = n == 0
    out = np.zeros((len(x), x.shape[1] + 2))
    out[:, :-2] = x / np.where(zero, 1.0, n)[:, None]
    out[zero, -2 if side == "corpus" else -1] = 1.0
    return out


def squared_distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances, by expansion; good for pruning, not for final keys."""
    d = q @ c.T
    d *= -2.0
    d += np.einsum("ij,ij->i", q, q)[:, None]
    d += np.einsum("ij,ij->i", c, c)[None, :]
    return np.maximum(d, 0.0, out=d)


def nearest_centre(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest row of ``c``, the first of equal ones, and the squared distance; as ``squared_distances`` has them.

    Distances in single precision pick those that may be the nearest; these alone are taken in double.
    """
    cell, dist = np.empty(len(x), np.int32), np.empty(len(x))
    x_size, c_size = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", c, c)
    scale = float(x_size.max(initial=0) + c_size.max())
    # Only the centres' part of a distance decides: |c|^2 - 2 x.c, one product with one more coordinate.
    factors = np.c_[-2 * c, c_size].astype(np.float32).T if scale < 1e30 else None
    eps = np.float32((c.shape[1] + 8) * 2.0**-22 * scale)
    step = max(1, _CELLS_PER_PASS // len(c))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        if factors is not None:
            near = np.c_[part, np.ones(len(part))].astype(np.float32) @ factors
            near = np.flatnonzero((near <= near.min(axis=1, keepdims=True) + 2 * eps).ravel())
        if factors is None or len(near) > 16 * len(part):
            d = squared_distances(part, c)
            cell[at : at + step], dist[at : at + step] = d.argmin(axis=1), d.min(axis=1)
            continue
        xi, ci = np.divmod(near, len(c))
        d = np.einsum("ij,ij->i", part[xi], c[ci])
        d = np.maximum((d * -2.0 + x_size[at : at + step][xi]) + c_size[ci], 0.0)
        order = np.lexsort((ci, d, xi))
        first = order[np.r_[True, xi[order][1:] != xi[order][:-1]]]
        cell[at : at + step], dist[at : at + step] = ci[first], d[first]
    return cell, dist


def pair_keys(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Exact keys of row pairs."""
    if metric == "cosine":
        key = -np.einsum("ij,ij->i", q, c)
    else:
        key = np.einsum("ij,ij->i", q - c, q - c)
    return np.round(key, KEY_DIGITS) + 0.0


def keys_at(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray, metric: str) -> np.ndarray:
    """``pair_keys`` of the rows at (qi, ci), a bounded number at a time."""
    out = np.empty(len(qi))
    step = max(1, _CELLS_PER_PASS // q.shape[1])
    for at in range(0, len(qi), step):
        s = slice(at, at + step)
        out[s] = pair_keys(q[qi[s]], c[ci[s]], metric)
    return out


def best(qi: np.ndarray, ids: np.ndarray, key: np.ndarray, k: int):
    """Positions of the k best (key, id) per query."""
    order = np.lexsort((ids, key, qi))
    s = qi[order]
    first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) if len(s) else np.zeros(0, int)
    return order[np.arange(len(s)) - start < k]


def smallest(d: np.ndarray, k: int, eps: float):
    """(row, column) of everything up to ``eps`` beyond the k-th smallest of its row."""
    if d.shape[1] > k:
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        return np.nonzero(d <= kth[:, None] + eps)
    return np.divmod(np.arange(d.size), max(1, d.shape[1]))


def thin_copies(c: np.ndarray, c_ids: pa.Array, k: int):
    """The k smallest ids of each distinct row: more copies can not be among k best."""
    rows = np.ascontiguousarray(c).view(np.dtype((np.void, c.itemsize * c.shape[1]))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    keep = np.sort(best(group, ids_of(c_ids), np.zeros(len(c)), k))
    return c[keep], c_ids.take(pa.array(keep))


def block_topk(q: np.ndarray, c: np.ndarray, c_ids: pa.Array, k: int, metric: str):
    """(query row, id, key) of the k best corpus rows per query row.

    Everything within rounding of the k-th preliminary distance is kept for the exact comparison, so
    copies of one vector are ordered by id whatever the block they sit in.
    """
    out = []
    step = max(1, _CELLS_PER_PASS // max(1, len(c)))
    c_scale = float(np.einsum("ij,ij->i", c, c).max()) if len(c) else 0.0
    thinned = False
    for at in range(0, len(q), step):
        part = q[at : at + step]
        eps = 1e-8 + 1e-12 * (c_scale + float(np.einsum("ij,ij->i", part, part).max()))
        qi, ci = smallest(squared_distances(part, c), k, eps)
        if len(qi) > 4 * k * len(part) and not thinned:
            c, c_ids = thin_copies(c, c_ids, k)
            thinned = True
            qi, ci = smallest(squared_distances(part, c), k, eps)
        ids = ids_of(c_ids.take(pa.array(ci)))
        key = keys_at(part, c, qi, ci, metric)
        pick = best(qi, ids, key, k)
        out.append((qi[pick] + at, ids[pick], key[pick]))
    return tuple(np.concatenate(p) for p in zip(*out))


class Nearest:
    """The k best corpus rows of some queries, of all blocks that were shown.

    ``kth`` has for each query a key within which k rows are known to lie, inf where there are none. Distances in
    single precision, with room for their rounding, tell what is compared exactly.
    """

    def __init__(self, q: np.ndarray, kth: np.ndarray, k: int, metric: str):
        self.q, self.kth, self.k, self.metric = prepare(q, metric, "query"), kth.astype(np.float64), k, metric
        self.size = np.einsum("ij,ij->i", self.q, self.q)
        self.factors = np.c_[-2 * self.q, np.ones(len(q))].astype(np.float32)
        self.found = None

    def see(self, rows: np.ndarray, c: np.ndarray, c_ids: pa.Array) -> None:
        """Shows the corpus rows ``c`` to the queries ``rows``."""
        c = prepare(c, self.metric, "corpus")
        c_size = np.einsum("ij,ij->i", c, c)
        scale = float(self.size[rows].max() + c_size.max())
        known = np.isfinite(self.kth[rows]) & bool(scale < 1e30)
        parts = [self._all(rows[~known], c, c_ids)] if not known.all() else []
        rows = rows[known]
        if len(rows):
            factors = np.c_[c, c_size].astype(np.float32).T
            most = 2 + 2 * self.kth[rows] if self.metric == "cosine" else self.kth[rows]
            most = most - self.size[rows] + 1e-8 + (c.shape[1] + 8) * 2.0**-22 * scale
            step = max(1, _CELLS_PER_PASS // len(c))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                near = self.factors[part] @ factors <= most[at : at + step, None].astype(np.float32)
                near = np.flatnonzero(near.ravel())
                if len(near) > (8 * self.k + 32) * len(part):
                    parts.append(self._all(part, c, c_ids))
                    continue
                qi, ci = np.divmod(near, len(c))
                qi = part[qi]
                key = keys_at(self.q, c, qi, ci, self.metric)
                ok = key <= self.kth[qi]
                parts.append((qi[ok], ids_of(c_ids.take(pa.array(ci[ok]))), key[ok]))
        self._add(tuple(np.concatenate(p) for p in zip(*parts)))

    def _all(self, rows: np.ndarray, c: np.ndarray, c_ids: pa.Array) -> tuple:
        qi, ids, key = block_topk(self.q[rows], c, c_ids, self.k, self.metric)
        return rows[qi], ids, key

    def _add(self, new: tuple) -> None:
        if not len(new[0]):
            return
        if self.found is None:
            rest, mixed = None, new
        else:
            touched = np.zeros(len(self.q), bool)
            touched[new[0]] = True
            old = touched[self.found[0]]
            rest = tuple(x[~old] for x in self.found)
            mixed = tuple(np.concatenate([x[old], y]) for x, y in zip(self.found, new))
        pick = best(*mixed, self.k)
        mixed = tuple(x[pick] for x in mixed)
        worst = np.full(len(self.q), -np.inf)
        np.maximum.at(worst, mixed[0], mixed[2])
        full = np.bincount(mixed[0], minlength=len(self.q)) >= self.k
        self.kth[full] = np.minimum(self.kth[full], worst[full])
        self.found = mixed if rest is None else tuple(np.concatenate(p) for p in zip(rest, mixed))


def block_cosines(q: np.ndarray, c: np.ndarray, threshold: float) -> Iterator[tuple]:
    """(query row, corpus row, cosine) of all pairs of unit vectors with at least ``threshold``, some query rows at a time."""
    step = max(1, _CELLS_PER_PASS // max(1, len(c)))
    for at in range(0, len(q), step):
        cosine = (q[at : at + step] @ c.T).ravel()
        near = np.flatnonzero(cosine >= threshold - 2 * 10.0**-KEY_DIGITS)
        cosine = np.round(cosine[near], KEY_DIGITS) + 0.0
        ok = cosine >= threshold
        qi, ci = np.divmod(near[ok], len(c))
        yield qi + at, ci, cosine[ok]


def block_within(q: np.ndarray, c: np.ndarray, radius: float, metric: str, limit: float) -> Iterator[tuple]:
    """(query row, corpus row, key) of all pairs with key at most ``limit``, some query rows at a time; ``radius`` prunes."""
    step = max(1, _CELLS_PER_PASS // max(1, len(c)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        qi, ci = np.nonzero(squared_distances(part, c) <= radius * radius + 1e-6)
        key = keys_at(part, c, qi, ci, metric)
        ok = key <= limit
        yield qi[ok] + at, ci[ok], key[ok]


def pack_blocks(
    df: DataFrame, keys: list[str], id_: str, vector: str, dim: int, extra: str | None = None, dtype=np.float32,
    carry: str | None = None, partitions: int | None = None,
) -> DataFrame:
    """Rows laid out by ``keys`` into blocks of up to 4096 vectors: (*keys, n, ids, data[, radius][, carried]).

    ``carried`` has the values of the column ``carry`` beside the ids. The layout is by range over the keys and the id, so a key that holds a large share of the rows is cut
    over many partitions, and every partition is packed in one streaming pass.
    """
    id_type = df.schema[id_].dataType
    fields = [df.schema[k] for k in keys] + [
        T.StructField("n", T.IntegerType()),
        T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("data", T.BinaryType()),
    ]
    if extra:
        fields.append(T.StructField("radius", T.DoubleType()))
    if carry:
        fields.append(T.StructField("carried", T.ArrayType(df.schema[carry].dataType)))
    columns = [*keys, id_, vector] + ([extra] if extra else []) + ([carry] if carry else [])
    laid = (
        df.select(*columns)
        .repartitionByRange(*([partitions] if partitions else []), *keys, F.xxhash64(id_))
        .sortWithinPartitions(*keys)
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key, held_rows = [], None, 0

        def flush():
            t = pa.Table.from_batches(held)
            data = matrix_of(t.column(vector), dim, dtype)
            row = [pa.array([v], type=t.schema.field(k).type) for k, v in zip(keys, held_key)]
            ids = t.column(id_).combine_chunks()
            row += [
                pa.array([len(data)], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), ids),
                pa.array([data.tobytes()], pa.binary()),
            ]
            names = [*keys, "n", "ids", "data"]
            if extra:
                row.append(pa.array([float(np.max(t.column(extra).to_numpy()))]))
                names.append("radius")
            if carry:
                row.append(pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), t.column(carry).combine_chunks()))
                names.append("carried")
            return pa.RecordBatch.from_arrays(row, names=names)

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(b.num_rows, bool)
            for col in cols:
                change[1:] |= col[1:] != col[:-1]
            starts = np.r_[0, np.flatnonzero(change)]
            for s, e in zip(starts, np.r_[starts[1:], b.num_rows]):
                key = tuple(col[s].item() for col in cols)
                if held and key != held_key:
                    yield flush()
                    held, held_rows = [], 0
                held_key = key
                while s < e:
                    take = min(e - s, BLOCK_ROWS - held_rows)
                    held.append(b.slice(s, take))
                    held_rows += take
                    s += take
                    if held_rows == BLOCK_ROWS:
                        yield flush()
                        held, held_rows = [], 0
        if held:
            yield flush()

    return laid.mapInArrow(pack, T.StructType(fields))
