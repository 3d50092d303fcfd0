"""Running streams over what is there now, and the document refresh stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkfield.operators import snapshots
from inkfield.operators.encode import Encoder
from inkfield.plans.index import chunk_and_embed, store_plan
from inkfield.plans.store import ChunkStore
from inkfield.session import materialize, scratch_path
from inkfield.sources.documents import list_files, load_documents


def run_to_table(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run a stream over all available input into a Parquet folder and read that.

    The file sink and its checkpoint lie in the shared folder and give each row once, also after a restart.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def refresh_batch(files: DataFrame, batch: int, store: ChunkStore, encoder: Encoder, pages=None) -> None:
    """One micro-batch of files into the store; writing the same batch again changes nothing."""
    docs = load_documents(files, pages)
    actions = files.select("path", F.lit("build").alias("action"))
    store.write_batch(batch, actions, chunk_and_embed(docs, encoder))


def poll_documents(spark: SparkSession, folder: str, store_folder: str, encoder: Encoder, *, pages=None) -> int:
    """Compare a folder with the state of the poll before and bring the store up to it; the number of files that changed.

    New and edited files are cut and embedded, removed ones are passed over from then on; other files are listed but not
    read. The state is saved behind the chunks, so a poll that failed is done again and gives the same.
    """
    store = ChunkStore(spark, store_folder)
    files = list_files(spark, folder)
    current = materialize(snapshots.collect_state(files), "listing")
    last = store.last_batch()
    saved = snapshots.load_state(spark, f"{store_folder}/states/{last}") if last >= 0 else None
    plan = materialize(store_plan(snapshots.rebuild_plan(saved, current), current, store), "plan")
    n = plan.count()
    if n or last < 0 or saved is None:
        chosen = files.join(plan.where("action = 'build'").select("path"), "path", "left_semi")
        store.write_batch(last + 1, plan, chunk_and_embed(load_documents(chosen, pages), encoder))
        snapshots.save_state(current, f"{store_folder}/states/{last + 1}")
    return n


def document_stream(
    spark: SparkSession, folder: str, store_folder: str, encoder: Encoder, *, pages=None, interval: str = "1 minute"
) -> StreamingQuery:
    """Polls a folder every ``interval`` until stopped: additions, edits and removals flow into chunks and vectors."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        clock.writeStream.foreachBatch(lambda _, n: poll_documents(spark, folder, store_folder, encoder, pages=pages))
        .option("checkpointLocation", f"{store_folder}/checkpoint")
        .trigger(processingTime=interval)
        .start()
    )
