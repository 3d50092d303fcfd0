"""Sinks: keyed tables, relational tables, write modes, storage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def write_keyed(docs: DataFrame, path: str, *, id_: str = "record_id") -> None:
    """Documents into a keyed Parquet table: same ids replace, others stay.

    The new state is written beside the old and named in a pointer row that is replaced last, so a failed
    load leaves the table as it was.
    """
    from inkfield.operators.records import last_per_id, upsert

    spark = docs.sparkSession
    old = read_keyed(spark, path)
    # The last of several rows of an id is the one that stays, in the order of the input.
    at = "__at"
    docs = last_per_id(docs.withColumn(at, F.monotonically_increasing_id()), id_, at).select(*docs.columns)
    new = docs if old is None else upsert(old, docs, id_)
    version = 0 if old is None else _version(spark, path) + 1
    new.write.mode("overwrite").parquet(f"{path}/v{version}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{path}/current")


def _version(spark: SparkSession, path: str) -> int:
    return spark.read.schema("version int").parquet(f"{path}/current").agg(F.max("version")).first()[0]


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        version = _version(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return spark.read.parquet(f"{path}/v{version}")


def create_table(
    spark: SparkSession, table: str, schema, *, drop_existing: bool = False, path: str | None = None
) -> bool:
    """Create, recreate or keep a table; True when it was made now. No columns is an error.

    With ``path`` the table's files lie there and outlive it.
    """
    exists = spark.catalog.tableExists(table)
    if exists and drop_existing:
        spark.sql(f"DROP TABLE {table}")
        exists = False
    if exists:
        return False
    if not schema.fields:
        raise ValueError("no columns inferred from the records")
    place = {"path": path} if path else {}
    spark.createDataFrame([], schema).write.format("parquet").options(**place).saveAsTable(table)
    return True


def append_rows(df: DataFrame, table: str) -> None:
    """Append by column name; columns the rows lack are NULL. Loading twice appends twice."""
    target = df.sparkSession.table(table)
    have = set(df.columns)
    rows = df.select(
        *[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema]
    )
    rows.write.mode("append").insertInto(table)


def write_jdbc(df: DataFrame, url: str, table: str, *, batch_rows: int = 500, writers: int = 8, **options) -> None:
    """Append to a database table; ``writers`` caps the connections.

    A repeated task may insert twice where the table has no key: load into a staging table and swap.
    """
    rows = df.repartition(writers)
    rows.write.format("jdbc").mode("append").option("url", url).option("dbtable", table).option(
        "batchsize", batch_rows
    ).option("numPartitions", writers).options(**options).save()


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: all files and bytes below a folder, hidden names too, summed by the file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    summary = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place)
    return spark.createDataFrame([(summary.getFileCount(), summary.getLength())], "files bigint, bytes bigint")


def vector_bytes(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: vectors and their raw float32 bytes."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(vector).cast("bigint") * 4), F.lit(0)).alias("bytes"))
