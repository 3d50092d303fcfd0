"""JSON records, declared trip data and generated vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield import config
from inkfield.functions.values import with_value
from inkfield.operators.blocks import list_column
from inkfield.operators.ordinals import first_rows


def objects_of(values: DataFrame, value: str = "v") -> DataFrame:
    """Records of JSON roots: an object is one record, an array of objects is many; else an error.

    Adds ``_pos``, the place within an array; other columns are kept.
    """
    keep = [c for c in values.columns if c != value]
    v = F.col(value)
    refuse = lambda message, t: F.raise_error(F.lit(message)).cast(t)

    def item(x):
        ok = F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
        return F.when(ok, x).otherwise(refuse("JSON list of records holds something else", "variant"))

    def items(kind):
        return (
            F.when(kind.startswith("OBJECT"), F.array(v))
            .when(kind.startswith("ARRAY"), F.transform(v.try_cast("array<variant>"), item))
            .otherwise(refuse("JSON root is neither a record nor a list of records", "array<variant>"))
        )

    # The outer form, as for the inner one a size filter is inferred that checks all roots twice.
    listed = with_value(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), items)
    rows = values.select(*keep, F.posexplode_outer(listed).alias("_pos", value))
    return rows.where(F.col("_pos").isNotNull())


def read_json(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """JSON files as (v, _file, _pos). Malformed text stops the read.

    A file with one root value is one task; ``lines`` reads one record per line, in splits, and is the way
    for large data.
    """
    reader = spark.read.option("mode", "FAILFAST").option("singleVariantColumn", "v")
    if not lines:
        reader = reader.option("multiLine", "true")
    raw = reader.json(path)
    values = raw.select("v", F.col("_metadata.file_path").alias("_file"))
    return objects_of(values)


def parse_records(df: DataFrame, text: str, value: str = "v") -> DataFrame:
    """JSON text of a column as records; malformed text is an error."""
    return objects_of(df.withColumn(value, F.parse_json(text)).drop(text), value)


def require_records(records: DataFrame) -> DataFrame:
    if records.isEmpty():
        raise ValueError("no records found")
    return records


# Column names and types of the trip files.
TRIP_COLUMNS = {
    "VendorID": "int",
    "tpep_pickup_datetime": "timestamp",
    "tpep_dropoff_datetime": "timestamp",
    "passenger_count": "float",
    "trip_distance": "float",
    "RatecodeID": "float",
    "store_and_fwd_flag": "string",
    "PULocationID": "int",
    "DOLocationID": "int",
    "payment_type": "int",
    "fare_amount": "float",
    "extra": "float",
    "mta_tax": "float",
    "tip_amount": "float",
    "tolls_amount": "float",
    "improvement_surcharge": "float",
    "total_amount": "float",
    "congestion_surcharge": "float",
    "Airport_fee": "float",
}


def as_declared(df: DataFrame, columns: dict[str, str] = TRIP_COLUMNS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Declared columns with their types; a column the file lacks is null."""
    have = set(df.columns)
    return df.select(
        *keep, *[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
    )


def read_trips(spark: SparkSession, path, max_rows: int) -> DataFrame:
    """The first rows of trip files under the declared schema, with their record ids."""
    return as_declared(first_rows(spark, path, max_rows), keep=("_ordinal",)).withColumnRenamed("_ordinal", "record_id")


def uniform_vectors(ids: DataFrame, dim: int, seed: int = 42, id_: str = "id") -> DataFrame:
    """A vector with elements in [0, 1) per id; drawn from the id, so the layout does not matter."""
    schema = T.StructType([T.StructField(id_, T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_pylist()
            x = np.stack([np.random.default_rng((seed, k)).random(dim, dtype=np.float32) for k in keys])
            yield pa.RecordBatch.from_arrays([b.column(0), list_column(x)], names=[id_, "embedding"])

    return ids.select(F.col(id_).cast("bigint")).mapInArrow(run, schema)
