"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
VECTORS, DIM, QUERIES, K = 100_000, 384, 100, 5


def drain(df) -> int:
    """Run a query whole; every row and column is produced."""
    df.write.format("noop").mode("overwrite").save()
    return 1


def timed(f):
    t = time.perf_counter()
    out = f()
    return out, time.perf_counter() - t


def vector_workload(spark, seconds: dict, extra: dict) -> None:
    """100 000 x 384 vectors, 100 queries, 5 neighbours: exact, by inverted lists, by product codes."""
    from inkfield.operators import ivf, knn
    from inkfield.session import scratch_path
    from inkfield.sources.records import uniform_vectors

    path = scratch_path(spark, "bench-vectors")
    _, seconds["vectors_generate_write"] = timed(
        lambda: uniform_vectors(spark.range(0, VECTORS, 1, int(CPUS)), DIM).write.parquet(path)
    )
    vectors = spark.read.parquet(path)
    queries = uniform_vectors(spark.range(QUERIES), DIM, seed=43)
    exact = lambda: {(r["query_id"], r["id"]) for r in knn.knn(vectors, queries, K).collect()}
    truth, seconds["vectors_knn_exact_100q"] = timed(exact)
    extra["exact_qps"] = round(QUERIES / seconds["vectors_knn_exact_100q"], 1)
    index, seconds["vectors_ivf_flat_build"] = timed(lambda: ivf.build(vectors, lists=64, pq_m=None))
    found, seconds["vectors_ivf_flat_search_100q"] = timed(
        lambda: {(r["query_id"], r["id"]) for r in ivf.search(index, queries, K, 16).collect()}
    )
    extra["ivf_flat_recall"] = round(len(found & truth) / len(truth), 3)
    index, seconds["vectors_ivfpq_build"] = timed(lambda: ivf.build(vectors, lists=64, pq_m=64, pq_nbits=8))
    found, seconds["vectors_ivfpq_search_100q"] = timed(
        lambda: {(r["query_id"], r["id"]) for r in ivf.search(index, queries, K, 16).collect()}
    )
    extra["ivfpq_recall"] = round(len(found & truth) / len(truth), 3)
    extra["ivf_flat_build_vectors_per_sec"] = round(VECTORS / seconds["vectors_ivf_flat_build"])


HEADLINE = (
    "normalize_text", "chunk_documents", "embed_documents_hash", "text_search_topk", "question_contexts",
    "knn_l2_exact", "knn_self_join", "semantic_search_cosine", "ivf_flat_search", "ivfpq_search",
    "join_embed_last_wins", "join_counters", "children_of", "infer_search_schema", "infer_sql_columns", "typed_records",
    "snapshot_diff", "vector_upsert", "record_ids", "file_record_ids", "json_safe_rows", "conversation_prompt",
    "token_segments", "document_segments", "document_load", "stream_sessions",
)


def main() -> None:
    from inkfield.plans.catalog import QUERIES as NAMED
    from inkfield.session import build_session

    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        f"local[{CPUS}]", "bench", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g",
        spark__local__dir=scratch, spark__checkpoint__dir=f"{scratch}/shared",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    extra: dict[str, float] = {}
    drain(NAMED["normalize_text"](spark, SF_DIR).limit(10))  # starts JVM code paths and Python workers
    for name in HEADLINE:
        _, seconds[name] = timed(lambda: drain(NAMED[name](spark, SF_DIR)))
        print(f"{name} {seconds[name]:.2f}", file=sys.stderr, flush=True)
    vector_workload(spark, seconds, extra)
    spark.stop()
    queries = {k: round(v, 3) for k, v in seconds.items()}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": queries,
        "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS), "vector_workload": extra,
    }))


if __name__ == "__main__":
    main()
