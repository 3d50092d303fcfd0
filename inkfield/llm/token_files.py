"""Token ids of documents as Parquet files in document order, for reading tokens or figures of chosen documents alone."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.llm.common import Tables, arrow_rows, of_process
from inkfield.llm.tokens import DocumentIds
from inkfield.operators.ordinals import running_offsets

TOKENIZER = "byte_bpe_50k.json"
#: Row groups small enough to be read alone, pages that their indexes can skip; ids by dictionary, whole numbers by delta.
FORMAT = {
    "parquet.block.size": 32 << 20,
    "parquet.page.size": 256 << 10,
    "parquet.page.row.count.limit": 2000,
    "parquet.dictionary.page.size": 1 << 20,
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#before": "false",
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Write doc_id, ids, n_tokens, file_no, before of ``docs`` (doc_id, text), in ascending doc_id order.

    ``ids`` are the text's ids with the end id 0 after them, for a null text the end only; ``before`` counts the ids before a
    document in its file, files are numbered in document order. Texts are dealt out by doc_id before they are
    encoded, so ids are never shuffled. Repeated rows are written as often as they come, rows without doc_id first.
    Other columns are ignored.
    """
    def run(batches):
        encode, total, number = of_process(DocumentIds, tokenizer), 0, TaskContext.get().partitionId()
        for b in batches:
            ids, sizes = encode(b.column(1).to_pylist())
            ends = np.cumsum(sizes)
            offsets = pa.array(np.r_[0, ends], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
                    pa.array(sizes, pa.int64()), pa.array(np.full(len(sizes), number), pa.int32()),
                    pa.array(ends - sizes + total, pa.int64()),
                ],
                ["doc_id", "ids", "n_tokens", "file_no", "before"],
            )
            total += int(ends[-1]) if len(ends) else 0

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, file_no int, before long")
    encoded.write.options(**FORMAT).parquet(path)


def read_figures(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """doc_id, start and ``more`` columns of the files; ids are read only if asked for."""
    files = spark.read.parquet(path)
    totals = files.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    starts = running_offsets(spark, totals, "file_no")
    return files.join(starts, "file_no").select("doc_id", (F.col("__offset") + F.col("before")).alias("start"), *more)


def read_tokens(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """doc_id and ids of the documents from ``first`` to ``last``; other row groups and pages are skipped."""
    return spark.read.parquet(path).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files that ``docs`` were written to, read back from them."""
    path = Tables(docs.sparkSession, "tokens").path()
    write_tokens(docs, path, tokenizer)

    def digest(c):
        ids = c["ids"]
        data = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(), "<u4")).cast("B")
        ends = np.cumsum(ids.value_lengths().to_numpy())
        sizes = ids.value_lengths().to_numpy()
        crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
        return {"doc_id": c["doc_id"], "start": c["start"], "n_tokens": sizes.astype(np.int64), "ids_crc32": crc}

    return arrow_rows(
        read_figures(docs.sparkSession, path, "ids"), digest, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
