"""Dense record ids in input order, row caps, and range slices for parallel loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield.session import materialize


BROADCAST_ROWS = 100_000  # offsets, one for each file or partition, that are shipped; more are joined by a shuffle


def running_offsets(spark: SparkSession, counts: DataFrame, key: str) -> DataFrame:
    """(key, offset) from (key, n): one row per file or partition, the size of a file listing."""
    total, rows = 0, []
    for r in counts.orderBy(key).toLocalIterator():
        rows.append((r[key], total))
        total += r["n"]
    schema = T.StructType([T.StructField(key, counts.schema[key].dataType), T.StructField("__offset", T.LongType())])
    offsets = spark.createDataFrame(rows, schema)
    return F.broadcast(offsets) if len(rows) <= BROADCAST_ROWS else offsets


def file_ordinals(spark: SparkSession, path, schema: T.StructType | None = None, name: str = "_ordinal") -> DataFrame:
    """Parquet rows with their position 0..n-1 over the files in path order.

    A file's rows know their index, so the position is that index plus the rows of the files before:
    one metadata-only count per file and no shuffle of rows.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    raw = reader.parquet(path)
    counts = (
        raw.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__i"))
        .groupBy("__file")
        .agg((F.max("__i") + 1).alias("n"))
    )
    offsets = running_offsets(spark, counts, "__file")
    rows = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__i"))
    return rows.join(offsets, "__file").select(*raw.columns, (F.col("__offset") + F.col("__i")).alias(name))


def first_rows(
    spark: SparkSession, path, max_rows: int, schema: T.StructType | None = None
) -> DataFrame:
    """The first ``max_rows`` rows in file order, the same ones every time, with their ids.

    Unlike ``limit`` this gathers nothing in one task.
    """
    return file_ordinals(spark, path, schema).where(F.col("_ordinal") < max_rows)


def dense_ordinals(df: DataFrame, order_by: list, name: str = "_ordinal", partitions: int | None = None) -> DataFrame:
    """Position 0..n-1 in the given order, for any table.

    Rows are range-partitioned on the whole order key, so a common leading value is split, and written
    once with their place within the partition; the offsets of the partitions are then added.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = (
        df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ).sortWithinPartitions(*order)
    # The id holds the partition above bit 33 and the row's place in the partition below.
    tag = F.monotonically_increasing_id()
    placed = materialize(ranged.withColumn("__tag", tag), "ordinals").select(
        *df.columns,
        F.shiftright("__tag", 33).alias("__part"),
        F.col("__tag").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"),
    )
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    offsets = running_offsets(df.sparkSession, counts, "__part")
    return placed.join(offsets, "__part").select(*df.columns, (F.col("__offset") + F.col("__at")).alias(name))


def slice_of(ordinal, n_rows, workers: int = 8) -> Column:
    """Worker slice of a row: consecutive slices of ceil(n/workers) rows."""
    ordinal = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    size = F.greatest(F.lit(1).cast("bigint"), F.ceil((n_rows if isinstance(n_rows, Column) else F.lit(n_rows)) / F.lit(workers)))
    return F.floor(ordinal / size).cast("int")


def range_slices(df: DataFrame, id_column: str, workers: int = 8) -> DataFrame:
    """Rows tagged with their slice and laid out one slice after the other for a parallel load."""
    n = df.count()
    return df.withColumn("worker", slice_of(id_column, n, workers)).repartitionByRange(workers, "worker", id_column)
