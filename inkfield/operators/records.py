"""Keyed vector records: upsert, checked insert, shard merge, set checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_id(df: DataFrame, id_: str, ordinal: str) -> DataFrame:
    """One row per id, the last in order; combined map-side."""
    row = F.struct(*[c for c in df.columns if c != id_])
    picked = df.groupBy(id_).agg(F.max_by(row, F.col(ordinal)).alias("__row"))
    return picked.select(id_, *[F.col("__row")[c].alias(c) for c in df.columns if c != id_])


def upsert(base: DataFrame, updates: DataFrame, id_: str, ordinal: str | None = None) -> DataFrame:
    """Base rows without an update, and the last update of each id."""
    u = last_per_id(updates, id_, ordinal) if ordinal else updates
    u = u.select(*base.columns)
    return base.join(u.select(id_), id_, "left_anti").unionByName(u)


def insert_conflicts(base: DataFrame, new: DataFrame, id_: str) -> DataFrame:
    """Ids that break the key: already in the base, or more than once among the new rows."""
    n = new.groupBy(id_).agg(F.count("*").alias("n"))
    twice = n.where("n > 1").select(id_, F.lit("repeated").alias("reason"))
    there = n.select(id_).join(base.select(id_), id_, "left_semi").select(id_, F.lit("exists").alias("reason"))
    return there.unionByName(twice)


def insert(base: DataFrame, new: DataFrame, id_: str) -> DataFrame:
    """Append with a key check; a conflict is an error, as with a primary key."""
    bad = insert_conflicts(base, new, id_).take(1)
    if bad:
        raise ValueError(f"key conflict on {id_}={bad[0][id_]} ({bad[0]['reason']})")
    return base.unionByName(new.select(*base.columns))


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """Shards that carry global ids, as one table."""
    return reduce(DataFrame.unionByName, shards)


def vector_checks(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: count, smallest and largest dimension, missing vectors."""
    return df.agg(
        F.count("*").alias("n"),
        F.min(F.size(vector)).cast("int").alias("min_dim"),
        F.max(F.size(vector)).cast("int").alias("max_dim"),
        F.sum(F.col(vector).isNull().cast("int")).cast("bigint").alias("n_missing"),
    )


def matrix_shape(df: DataFrame, vector: str = "embedding") -> tuple[int, int]:
    """Number of vectors and their dimension; empty sets, missing vectors and mixed lengths are errors."""
    r = vector_checks(df, vector).first()
    if not r["n"]:
        raise ValueError("no vectors")
    if r["n_missing"] or r["min_dim"] != r["max_dim"] or not r["min_dim"]:
        raise ValueError(f"vectors do not form a matrix: dimensions {r['min_dim']}..{r['max_dim']}")
    return r["n"], r["min_dim"]
