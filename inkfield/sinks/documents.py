"""Documents sent to a store in batches, as a Python data source: what went wrong comes back with the tasks' commits."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from inkfield.session import scratch_path

# Takes a batch of records: (ids, documents) -> one error text or None per record.
BatchWriter = Callable[[list, list], list]

DOCUMENT_BATCH = 500
MAX_FIRST_ERRORS = 5
FORMAT = "inkfield_documents"
_STORED = pa.schema([("id", pa.string()), ("doc", pa.string())])


class FolderStore:
    """Keeps accepted documents as Parquet files (id, doc) of a folder; refuses what ``check`` refuses.

    A task's file lies under a name that readers pass over until the load is committed, so a failed or repeated task
    leaves nothing to be seen.
    """

    def __init__(self, folder: str, check: BatchWriter):
        self.folder, self.check, self.file, self.name = folder, check, None, None

    def __call__(self, ids: list, docs: list) -> list:
        errors = self.check(ids, docs)
        good = [k for k, e in enumerate(errors) if e is None]
        if good:
            if self.file is None:
                self.name = f"{uuid.uuid4().hex}.parquet"
                system, place = fs.FileSystem.from_uri(self.folder)
                system.create_dir(place)
                self.file = pq.ParquetWriter(f"{place}/_{self.name}", _STORED, filesystem=system)
            self.file.write_table(pa.table([[ids[k] for k in good], [docs[k] for k in good]], _STORED))
        return errors

    def close(self) -> str | None:
        """Finish a task's file; what the task's commit has to name."""
        if self.file is None:
            return None
        self.file.close()
        self.file = None
        return self.name

    def commit(self, names: list[str]) -> None:
        system, place = fs.FileSystem.from_uri(self.folder)
        system.create_dir(place)
        for name in names:
            system.move(f"{place}/_{name}", f"{place}/{name}")

    def abort(self, names: list[str]) -> None:
        system, place = fs.FileSystem.from_uri(self.folder)
        for name in names:
            if system.get_file_info(f"{place}/_{name}").type != fs.FileType.NotFound:
                system.delete_file(f"{place}/_{name}")


@dataclass
class TaskReport(WriterCommitMessage):
    """What a task sent: counts, its first errors as (ordinal, id, error), and the store's own word on it."""

    attempted: int = 0
    failed: int = 0
    errors: list = field(default_factory=list)
    kept: str | None = None


class _Sink(DataSourceWriter):
    def __init__(self, store: BatchWriter, batch_rows: int, most: int, report: str):
        self.store, self.batch_rows, self.most, self.report = store, batch_rows, most, report

    def write(self, iterator: Iterator) -> TaskReport:
        out, worst = TaskReport(), []  # the errors of the smallest ordinals, the largest of them on top
        rows = iter(iterator)
        while batch := list(islice(rows, self.batch_rows)):
            errors = self.store([r["id"] for r in batch], [r["doc"] for r in batch])
            out.attempted += len(batch)
            for r, error in zip(batch, errors):
                if error is not None:
                    out.failed += 1
                    heapq.heappush(worst, (-r["ordinal"], r["id"], error))
                    if len(worst) > self.most:
                        heapq.heappop(worst)
        out.errors = sorted((-o, i, e) for o, i, e in worst)
        out.kept = self.store.close() if hasattr(self.store, "close") else None
        return out

    def commit(self, messages: list) -> None:
        self._end("commit", messages)

    def abort(self, messages: list) -> None:
        self._end("abort", messages)

    def _end(self, how: str, messages: list) -> None:
        done = [m for m in messages if m is not None]
        if hasattr(self.store, how):
            getattr(self.store, how)([m.kept for m in done if m.kept])
        errors = heapq.nsmallest(self.most, (tuple(e) for m in done for e in m.errors))
        told = {
            "outcome": how, "attempted": sum(m.attempted for m in done), "failed": sum(m.failed for m in done),
            "errors": [{"ordinal": o, "record_id": i, "error": e} for o, i, e in errors],
        }
        system, place = fs.FileSystem.from_uri(self.report)
        system.create_dir(place)
        with system.open_output_stream(f"{place}/report.json") as f:
            f.write(json.dumps(told).encode())


def write_documents(
    docs: DataFrame, store: BatchWriter, *, id_: str = "record_id", doc: str = "doc", ordinal: str = "ordinal",
    batch_rows: int = DOCUMENT_BATCH, tasks: int | None = None, most_errors: int = MAX_FIRST_ERRORS,
) -> DataFrame:
    """Send documents in batches; one row: attempted, succeeded, failed, errors.

    ``errors`` are the first by ``ordinal``, as (ordinal, record_id, error); a load with refused documents is committed
    all the same. Counts and errors come with the commits of the tasks that counted, so retried and speculative tasks
    are not told twice. Where a task fails for good, the load is aborted and raises. ``store`` is called with a batch of ids
    and documents and names an error or None for each; it should be keyed by id, and may have ``close``, ``commit`` and
    ``abort`` as ``FolderStore`` has. ``tasks`` caps the writers that run at a time; what comes before them keeps its own
    partitions. A task sends at most ``most_errors`` errors.
    """
    spark = docs.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "load"))
    report = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm_path).toString()
    sink = _Sink(store, batch_rows, most_errors, report)

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return "id string, doc string, ordinal bigint"

        def writer(self, schema, overwrite) -> DataSourceWriter:
            return sink

    rows = docs.select(F.col(id_).cast("string").alias("id"), F.col(doc).alias("doc"), F.col(ordinal).cast("bigint").alias("ordinal"))
    if tasks:
        rows = rows.repartition(tasks)
    spark.dataSource.register(Documents)
    rows.write.format(FORMAT).mode("append").save()
    told = "outcome string, attempted bigint, failed bigint, errors array<struct<ordinal: bigint, record_id: string, error: string>>"
    read = spark.read.schema(told).json(f"{report}/report.json")
    return read.select("attempted", (F.col("attempted") - F.col("failed")).alias("succeeded"), "failed", "errors")


def first_errors(report: DataFrame) -> DataFrame:
    """(ordinal, record_id, error), one row each."""
    return report.select(F.inline("errors"))
