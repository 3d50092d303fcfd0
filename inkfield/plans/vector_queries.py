"""Named queries over vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfield import config
from inkfield.functions import vectors as X
from inkfield.operators import ivf, knn
from inkfield.operators import retrieve as R
from inkfield.operators.chunks import split_documents
from inkfield.operators.encode import HashEncoder, embed_documents
from inkfield.operators.records import vector_checks as checks
from inkfield.plans.registry import query, table, wide
from inkfield.session import materialize, scratch_path
from inkfield.sources.records import uniform_vectors as uniform

ENCODER = HashEncoder(256)

# One query vector per label: the mean of its vectors.
_MEANS_SQL = """u as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings),
  m as (select label, pos, avg(x) as m from u group by 1, 2),
  q as (select label::bigint as query_id, list(m::float order by pos)::double[] as v from m group by 1)"""
_ALL_MEAN_SQL = """u as (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings),
  m as (select pos, avg(x) as m from u group by 1), q as (select list(m order by pos) as v from m)"""


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _label_means(spark, sf_dir):
    return knn.mean_vectors(_embeddings(spark, sf_dir), "label").withColumnRenamed("label", "query_id")


def _mean_vector(spark, sf_dir) -> list[float]:
    return knn.mean_vectors(_embeddings(spark, sf_dir), None).first()["embedding"]


def _hits(df, metric, name):
    value = F.round(knn.distance(metric=metric), 6)
    return df.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("int").alias("rank"), value.alias(name))


def _knn_sql(select: str, k: int, value: str, source: str = _MEANS_SQL) -> str:
    return f"""
with {source},
d as (select query_id, vec_id, round(list_distance(embedding::double[], v) ** 2, 9) as key from embeddings, q),
r as (select *, row_number() over (partition by query_id order by key, vec_id) as rank from d)
select query_id, vec_id, rank::integer as rank, round({select}, 6) as {value} from r where rank <= {k}
"""


@query(_knn_sql("key", config.BENCH_K, "sq_distance"))
def knn_l2_exact(spark, sf_dir):
    hits = knn.knn(_embeddings(spark, sf_dir), _label_means(spark, sf_dir), id_="vec_id", query_id="query_id")
    return _hits(hits, "l2", "sq_distance")


@query(_knn_sql("sqrt(key)", config.BENCH_K, "distance"))
def knn_l2_euclid(spark, sf_dir):
    hits = knn.knn(_embeddings(spark, sf_dir), _label_means(spark, sf_dir), id_="vec_id", query_id="query_id")
    return _hits(hits, "euclidean", "distance")


_SELF_SQL = """
with d as (select a.vec_id as query_id, b.vec_id, round(list_distance(a.embedding::double[], b.embedding::double[]) ** 2, 9) as key
  from embeddings a, embeddings b where a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by key, vec_id) as rank from d)
select query_id, vec_id, rank::integer as rank, round(key, 6) as sq_distance from r where rank <= 5
"""


@query(_SELF_SQL)
def knn_self_join(spark, sf_dir):
    """Neighbours of every vector among all others, through the pruned cell join."""
    e = _embeddings(spark, sf_dir)
    return _hits(knn.knn(e, e, id_="vec_id", exclude_self=True, broadcast_bytes=0), "l2", "sq_distance")


@query(f"""
with {_ALL_MEAN_SQL},
d as (select vec_id, round(list_distance(embedding::double[], v), 9) as d from embeddings, q)
select vec_id, round(d, 6) as distance from d order by d, vec_id limit 5
""")
def knn_single_topk(spark, sf_dir):
    top = knn.nearest(_embeddings(spark, sf_dir), _mean_vector(spark, sf_dir), 5, id_="vec_id")
    return top.select(F.col("id").alias("vec_id"), F.round("value", 6).alias("distance"))


@query(f"""
with {_ALL_MEAN_SQL}
select vec_id, round(round(list_cosine_similarity(embedding::double[], v), 9), 6) as score from embeddings, q
""")
def ranked_candidates(spark, sf_dir):
    r = knn.ranked(_embeddings(spark, sf_dir), _mean_vector(spark, sf_dir), id_="vec_id")
    return r.select(F.col("id").alias("vec_id"), F.round("value", 6).alias("score"))


@query(f"""
with {_MEANS_SQL},
d as (select query_id, vec_id, round(list_cosine_similarity(embedding::double[], v), 9) as s from embeddings, q),
r as (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from d)
select query_id, vec_id, rank::integer as rank, round(s, 6) as score from r where rank <= 3
""")
def semantic_search_cosine(spark, sf_dir):
    hits = knn.knn(
        _embeddings(spark, sf_dir), _label_means(spark, sf_dir), config.SEARCH_K, "cosine", id_="vec_id", query_id="query_id"
    )
    return _hits(hits, "cosine", "score")


@query("""
with e as (select min(vec_id) as vec_id, count(*) as n, embedding from embeddings group by embedding),
p as (select a.vec_id as id_a, b.vec_id as id_b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as s,
  a.n as n_a, b.n as n_b from e a, e b where a.vec_id < b.vec_id)
select id_a, id_b, round(s, 6) as score, n_a, n_b from p where s >= 0.3
""")
def pairwise_cosine(spark, sf_dir):
    p = knn.similar_pairs(_embeddings(spark, sf_dir), 0.3, id_="vec_id")
    return p.withColumn("score", F.round("score", 6))


@query("""
with u as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos,
  sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings)
select vec_id, pos::integer - 1 as pos, round(3 * x / (3 * n), 6) as x from u
""")
def l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = _embeddings(spark, sf_dir).select("vec_id", X.l2_normalize(scaled).alias("v"))
    return unit.select("vec_id", F.posexplode_outer("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""
with u as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings),
m as (select label, pos, avg(x) as m from u group by 1, 2), q as (select label, list(m order by pos) as v from m group by 1)
select vec_id, round(list_distance(embedding::double[], v), 6) as distance, round(list_distance(embedding::double[], v) ** 2, 6) as sq_distance,
  round(list_cosine_similarity(embedding::double[], v), 6) as cosine, round(list_inner_product(embedding::double[], v), 6) as inner_product
from embeddings join q using (label)
""")
def vector_distances(spark, sf_dir):
    """Every vector against the mean of its label."""
    e = _embeddings(spark, sf_dir)
    means = knn.mean_vectors(e, "label").withColumnRenamed("embedding", "mean")
    pairs = e.join(materialize(means, "means"), "label")
    return pairs.select(
        "vec_id", F.round(X.l2("embedding", "mean"), 6).alias("distance"),
        F.round(X.squared_l2("embedding", "mean"), 6).alias("sq_distance"),
        F.round(X.cosine("embedding", "mean"), 6).alias("cosine"),
        F.round(X.dot("embedding", "mean"), 6).alias("inner_product"),
    )


@query("""
select count(*) as n, min(len(embedding))::integer as min_dim, max(len(embedding))::integer as max_dim,
  count(*) filter (where embedding is null) as n_missing from embeddings
""")
def vector_checks(spark, sf_dir):
    return checks(_embeddings(spark, sf_dir))


@query(_knn_sql("key", 5, "sq_distance"))
def ivf_flat_full_probe(spark, sf_dir):
    """An index of whole vectors, all lists visited: the exact answer."""
    index = ivf.build(_embeddings(spark, sf_dir), lists=16, pq_m=None, id_="vec_id")
    return _hits(ivf.search(index, _label_means(spark, sf_dir), 5, 16, id_="query_id"), "l2", "sq_distance")


def _lists(rows) -> int:
    """As many lists as the root of the rows: lists and what is read of them grow alike."""
    return max(16, int(rows.count() ** 0.5))


@query()
def ivf_flat_search(spark, sf_dir):
    """Approximate search in 4 lists, for every vector."""
    e = _embeddings(spark, sf_dir)
    index = ivf.build(e, lists=_lists(e), pq_m=None, id_="vec_id")
    return _hits(ivf.search(index, e, 5, 4, id_="vec_id"), "l2", "sq_distance")


@query()
def ivfpq_search(spark, sf_dir):
    """Approximate search over product codes, for every vector."""
    e = _embeddings(spark, sf_dir)
    index = ivf.build(e, lists=_lists(e), pq_m=16, pq_nbits=6, id_="vec_id")
    return _hits(ivf.search(index, e, 5, 8, id_="vec_id"), "l2", "sq_distance")


@query(_knn_sql("key", 5, "sq_distance"))
def index_save_load(spark, sf_dir):
    """Search through an index opened from its folder."""
    path = scratch_path(spark, "saved-index")
    ivf.build(_embeddings(spark, sf_dir), lists=16, pq_m=None, path=path, id_="vec_id")
    index = ivf.load(spark, path)
    return _hits(ivf.search(index, _label_means(spark, sf_dir), 5, 16, id_="query_id"), "l2", "sq_distance")


@query("select count(*) as n, 16 as min_dim, 16 as max_dim, true as in_range from events")
def uniform_vectors(spark, sf_dir):
    v = uniform(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), 16)
    return v.agg(
        F.count("*").alias("n"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
        F.bool_and(F.forall("embedding", lambda x: (x >= 0) & (x < 1))).alias("in_range"),
    )


# Hashed bag of words, unit length, in single precision as stored.
def _bags_sql(name: str, id_: str, source: str, text: str) -> str:
    return f"""{name}_t as (select {id_} as id, unnest(string_split_regex(lower({text}), '\\s+')) as tok from {source}),
{name}_c as (select id, ('0x' || substr(md5(tok), 1, 8))::bigint % 256 as bucket, count(*) as c from {name}_t where tok <> '' group by 1, 2),
{name} as (select id, bucket, (c / sqrt(sum(c * c) over (partition by id)))::float::double as w from {name}_c)"""


_SEARCH_SQL = f"""{_bags_sql('d', 'doc_id', 'documents', 'text')},
{_bags_sql('b', 'id', 'asked', f"'{config.QUERY_PROMPT}' || text")},
dn as (select id, sqrt(sum(w * w)) as n from d group by 1), bn as (select id, sqrt(sum(w * w)) as n from b group by 1),
s as (select b.id as query_id, d.id as doc_id, round(sum(b.w * d.w) / (any_value(bn.n) * any_value(dn.n)), 9) as s
  from b join d on b.bucket = d.bucket join dn on dn.id = d.id join bn on bn.id = b.id group by 1, 2),
r as (select *, row_number() over (partition by query_id order by s desc, doc_id) as rank from s)"""


@query(f"""
with {_bags_sql('d', 'doc_id', 'documents', 'text')}
select id as doc_id, bucket::integer as bucket, round(w, 6) as weight from d
""")
def embed_documents_hash(spark, sf_dir):
    d = embed_documents(wide(spark, sf_dir, "documents", "doc_id", "text"), ENCODER)
    # The outer form, as for the inner one a size filter is inferred that encodes every text once more.
    w = d.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "w")).where("w <> 0")
    return w.select("doc_id", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight"))


def _document_vectors(spark, sf_dir):
    return embed_documents(wide(spark, sf_dir, "documents", "doc_id", "text"), ENCODER).select("doc_id", "embedding")


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"""
with asked as (select item_id as id, text from benchmark), {_SEARCH_SQL}
select query_id, doc_id, rank::integer as rank, round(s, 6) as score from r where rank <= 3
""")
def text_search_topk(spark, sf_dir):
    hits = R.similarity_search(_questions(spark, sf_dir), _document_vectors(spark, sf_dir), ENCODER, id_="doc_id")
    return hits.select("query_id", F.col("id").alias("doc_id"), F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""
with asked as (select item_id as id, text from benchmark), {_SEARCH_SQL}
select query_id, rank::integer as rank, doc_id, source, md5(text) as text_md5 from r join documents using (doc_id) where rank <= 3
""")
def hit_payloads(spark, sf_dir):
    """Hits with text and metadata of the documents they point to."""
    hits = R.similarity_search(_questions(spark, sf_dir), _document_vectors(spark, sf_dir), ENCODER, id_="doc_id")
    found = R.payloads(hits, table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return found.select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "source", F.md5("text").alias("text_md5")
    )


@query(f"""
with asked as (select item_id as id, text from benchmark), {_SEARCH_SQL}
select query_id, md5(string_agg(text, chr(10) || chr(10) order by rank)) as context_md5
from r join documents using (doc_id) where rank <= 3 group by 1
""")
def assemble_context(spark, sf_dir):
    hits = R.similarity_search(_questions(spark, sf_dir), _document_vectors(spark, sf_dir), ENCODER, id_="doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = R.assemble_context(R.payloads(hits, docs, "doc_id"))
    return found.select("query_id", F.md5("context").alias("context_md5"))


@query(f"""
with asked as (select item_id as id, text from benchmark where item_id % 3 <> 0 and item_id % 4 < 2), {_SEARCH_SQL}
select query_id, md5(string_agg(text, chr(10) || chr(10) order by rank)) as context_md5
from r join documents using (doc_id) where rank <= 3 group by 1
""")
def retrieval_round(spark, sf_dir):
    """Questions a review sent back, retrieved again with the refined query or the question."""
    q = _questions(spark, sf_dir)
    critic = (
        F.when(F.col("query_id") % 3 == 0, "PASS")
        .when(F.col("query_id") % 3 == 1, "REVISE: thin")
        .otherwise(F.concat(F.lit("REVISE: thin\nREFINED_QUERY: "), F.replace("text", F.lit("\n"), F.lit(" "))))
    )
    answers = q.select(
        "query_id", F.col("text").alias("question"), critic.alias("critic"), (F.col("query_id") % 4).cast("int").alias("critic_iters")
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    vectors = _document_vectors(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id")
    found = R.retrieval_round(answers, docs, vectors, ENCODER)
    return found.select("query_id", F.md5("context").alias("context_md5"))


@query()
def question_contexts(spark, sf_dir):
    """Flagship: documents cut, cleaned and embedded; every question with its three best chunks as context."""
    docs = wide(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("source"), "text")
    chunks = embed_documents(split_documents(docs, doc_id="source"), ENCODER)
    # Searched and then read for the texts: cut and embedded once.
    chunks = materialize(chunks.select("chunk_id", "text", "embedding"), "chunks")
    return R.contexts(_questions(spark, sf_dir), chunks, chunks.select("chunk_id", "embedding"), ENCODER)


@query()
def indexed_question_contexts(spark, sf_dir):
    """The same through an inverted-list index of the chunks; a third of the lists hold over 0.9 of the true hits."""
    docs = wide(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("source"), "text")
    chunks = embed_documents(split_documents(docs, doc_id="source"), ENCODER)
    chunks = materialize(chunks.select("chunk_id", "text", "embedding"), "chunks")
    lists = _lists(chunks)
    index = ivf.build(chunks, lists=lists, pq_m=None, id_="chunk_id")
    return R.contexts(_questions(spark, sf_dir), chunks, index, ENCODER, probes=max(8, lists // 3))
