"""What the operators share: intermediate tables, whole-table counts, connected components, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.session import scratch_path, ship

Batches = Iterator[pa.RecordBatch]


class Tables:
    """Intermediate tables of one run in the shared folder; a lost executor costs a task and not a table.

    ``keep`` writes and rereads a table, ``drop`` deletes those that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root, self.n = spark, scratch_path(spark, name), 0
        self.where: dict[int, tuple[DataFrame, str]] = {}  # a frame is held, so that no other takes its id

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.where[id(out)] = out, path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            known = self.where.pop(id(df), None)
            if known:
                place = jvm.org.apache.hadoop.fs.Path(known[1])
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


_OF_PROCESS: dict[tuple, object] = {}


def of_process(kind: Callable, *args):
    """One ``kind(*args)`` for all tasks of a Python worker, so that what it has learned serves the next task too.

    A worker lives through the stages of a pipeline: what kinds of other modules have learned is dropped first.
    """
    key = (kind, args)
    if key not in _OF_PROCESS:
        for other in [k for k in _OF_PROCESS if k[0].__module__ != kind.__module__]:
            del _OF_PROCESS[other]
        if len(_OF_PROCESS) >= 8:
            _OF_PROCESS.pop(next(iter(_OF_PROCESS)))
        _OF_PROCESS[key] = kind(*args)
    return _OF_PROCESS[key]


def arrow_rows(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list | pa.Array]], schema: str) -> DataFrame:
    """``f`` on the columns of each Arrow batch; it returns the columns of ``schema``, in any number of rows."""
    to = _arrow_schema(df.sparkSession, schema)

    def run(batches: Batches) -> Batches:
        for b in batches:
            out = f({k: b.column(i) for i, k in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([_array(out[x.name], x.type) for x in to], schema=to)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def connected(tables: Tables, links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over ``links`` (a, b), for every node that has a link.

    Alternates two star contractions until the links form stars around the least nodes; the number of passes grows
    with the logarithm of the longest path, and no step gathers a component in one place.
    """
    edges = tables.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _digest(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = tables.keep(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = tables.keep(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        own = tables.keep(large.groupBy("a").agg(F.min("b").alias("low")))
        rest = large.join(own, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = tables.keep(rest.unionAll(own.select("a", F.col("low").alias("b"))).distinct())
        tables.drop(edges, low, large, own)
        now = _digest(after)
        if now == seen:
            stars = after.select(F.col("a").alias("node"), F.col("b").alias("component"))
            roots = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return stars.unionAll(roots)
        edges, seen = after, now


def _digest(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def quoted(name: str) -> str:
    """A column's name for use in expressions, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def free_name(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it."""
    while name in columns:
        name += "_"
    return name


def remainder(column: str, by: int) -> Column:
    """crc32 of a column's text, modulo ``by``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by
