"""Chunk tables that grow by batches: what a path last became is what counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
_FILES = "path string, action string, batch bigint"


@dataclass
class ChunkStore:
    """``chunks/batch=N`` holds the chunks a batch made, ``files/batch=N`` the paths it built or dropped.

    A batch is written under its own number and may be written again; files come last and make it count.
    Nothing older is rewritten: a path's earlier chunks are passed over when reading.
    """

    spark: SparkSession
    folder: str

    def write_batch(self, batch: int, actions: DataFrame, chunks: DataFrame) -> None:
        """``actions`` is (path, action) with action ``build`` or ``drop``."""
        chunks.select(*CHUNK_SCHEMA.names).write.mode("overwrite").parquet(f"{self.folder}/chunks/batch={batch}")
        actions.select("path", "action").where(F.col("action") != "keep").write.mode("overwrite").parquet(
            f"{self.folder}/files/batch={batch}"
        )

    def _read(self, name: str, schema) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def live(self) -> DataFrame | None:
        """(path, batch) of the paths that exist, each with the batch that last built it."""
        files = self._read("files", _FILES)
        if files is None:
            return None
        last = files.groupBy("path").agg(F.max_by(F.struct("action", "batch"), "batch").alias("last"))
        return last.where(F.col("last.action") == "build").select("path", F.col("last.batch").alias("batch"))

    def last_batch(self) -> int:
        files = self._read("files", _FILES)
        top = None if files is None else files.agg(F.max("batch")).first()[0]
        return -1 if top is None else top

    def chunks(self) -> DataFrame:
        """The current chunks."""
        stored = self._read("chunks", T.StructType([*CHUNK_SCHEMA.fields, T.StructField("batch", T.LongType())]))
        live = self.live()
        if stored is None or live is None:
            return self.spark.createDataFrame([], CHUNK_SCHEMA)
        live = live.withColumnRenamed("path", "source")
        return stored.join(live, ["source", "batch"], "left_semi").select(*CHUNK_SCHEMA.names)
