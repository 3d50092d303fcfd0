"""Building, refreshing and opening the document index of a folder of files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield import config
from inkfield.operators import ivf, snapshots
from inkfield.operators.cells import CellIndex
from inkfield.operators.chunks import require_chunks, split_documents
from inkfield.operators.encode import Encoder, embed_documents
from inkfield.plans.store import ChunkStore
from inkfield.sources.documents import load_documents


@dataclass
class DocumentIndex:
    store: ChunkStore
    index: CellIndex
    rebuilt: bool

    @property
    def chunks(self) -> DataFrame:
        return self.store.chunks()


def chunk_and_embed(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """(source, type, text) documents to stored chunks; no shuffle."""
    return embed_documents(split_documents(docs, doc_id="source"), encoder)


def _saved(spark: SparkSession, folder: str) -> tuple[DataFrame | None, str | None]:
    """State and index folder of the last finished build."""
    try:
        row = spark.read.schema("build bigint, batch bigint").parquet(f"{folder}/current").orderBy(F.desc("build")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None, None
        raise
    if row is None:
        return None, None
    return snapshots.load_state(spark, f"{folder}/build-{row['build']}/state"), f"{folder}/build-{row['build']}"


def store_plan(plan: DataFrame, current: DataFrame, store: ChunkStore) -> DataFrame:
    """The plan against what the store holds, which a failed build may have moved on from the saved state."""
    build = plan.where("action = 'build'").select("path")
    live = store.live()
    if live is None:
        return build.select("path", F.lit("build").alias("action"))
    missing = current.join(live, "path", "left_anti").select("path")
    gone = live.join(current, "path", "left_anti").select("path")
    return (
        build.unionByName(missing).distinct().select("path", F.lit("build").alias("action"))
        .unionByName(gone.select("path", F.lit("drop").alias("action")))
    )


def is_fresh(spark: SparkSession, files: DataFrame, folder: str, force: bool = False) -> bool:
    """Whether a saved index can be used as it is: not forced, present, sources unchanged."""
    state, build = _saved(spark, folder)
    return not force and build is not None and not snapshots.changed(state, snapshots.collect_state(files))


def open_or_refresh(
    spark: SparkSession,
    files: DataFrame,
    folder: str,
    encoder: Encoder,
    *,
    force: bool = False,
    retrain: bool = False,
    lists: int = config.IVF_LISTS,
    pq_m: int | None = config.PQ_SUBSPACES,
    pq_nbits: int = config.PQ_BITS,
    pages=None,
) -> DocumentIndex:
    """The index of a file listing, refreshed where the files changed.

    Only new and modified files are extracted, cut and embedded; removed ones are passed over. The lists
    are packed again from stored vectors, with the centroids and codebooks there are unless ``retrain``.
    ``force`` builds everything anew. The state is saved and named last: a failed build leaves the index
    before it in use, never a stale one.
    """
    store = ChunkStore(spark, f"{folder}/store")
    state, build = _saved(spark, folder)
    current = snapshots.collect_state(files)
    if not force and build is not None and not snapshots.changed(state, current):
        return DocumentIndex(store, ivf.load(spark, f"{build}/index"), False)
    plan = store_plan(snapshots.rebuild_plan(state if build else None, current, force), current, store)
    chosen = files.join(plan.where("action = 'build'").select("path"), "path", "left_semi")
    batch = store.last_batch() + 1
    store.write_batch(batch, plan, chunk_and_embed(load_documents(chosen, pages), encoder))
    chunks = require_chunks(store.chunks())
    target = f"{folder}/build-{batch}"
    if build is None or force or retrain:
        index = ivf.build(chunks, lists=lists, pq_m=pq_m, pq_nbits=pq_nbits, path=f"{target}/index", id_="chunk_id")
    else:
        index = ivf.repack(chunks, ivf.load(spark, f"{build}/index"), path=f"{target}/index", id_="chunk_id")
    snapshots.save_state(current, f"{target}/state")
    spark.createDataFrame([(batch, batch)], "build bigint, batch bigint").coalesce(1).write.mode("append").parquet(
        f"{folder}/current"
    )
    return DocumentIndex(store, index, True)
