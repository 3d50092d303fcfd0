"""The named queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.llm import bpe, html_extract, language_model, packing, pii, repeated_passages, token_files, toxicity, tree_search
from inkfield.llm.hard_negatives import hard_negatives
from inkfield.llm.near_text import Settings, near_duplicates
from inkfield.llm.near_vectors import near_vectors
from inkfield.llm.whitening import whiten
from inkfield.plans.registry import table
from inkfield.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return tree_search.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.encoded_digests(table(spark, sf_dir, "documents"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced, and how many of each kind."""
    return pii.pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar sets of four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), Settings(words=4))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled documents outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids in the token files, read back from them."""
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under the word model and the attention model."""
    return language_model.scores(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened along its sixteen strongest components."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, with every seventh label moved on by one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 35 words and more that occur elsewhere too."""
    return repeated_passages.digests(table(spark, sf_dir, "documents"))


def _registered(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


_COMPONENTS = """
reach as (
    select id as node, id as root from nodes union select l.b, r.root from reach r join links l on l.a = r.node
),
components as (select node, min(root) as component_id from reach group by 1)
"""

ORACLES["op6_minhash_near_dedup"] = rf"""
with recursive texts as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
    from documents
),
shingles as (
    select distinct doc_id, case when len(words) < 4 then array_to_string(words, ' ') else array_to_string(words[i:i + 3], ' ') end as s
    from (select doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) as i from texts where len(words) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by 1),
links as (
    select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as common from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by all) p
    join sizes u on u.doc_id = p.a join sizes v on v.doc_id = p.b where 100 * common >= 80 * (u.n + v.n - common)
),
nodes as (select doc_id as id from documents), {_COMPONENTS}
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join components c on c.node = d.doc_id
"""

ORACLES["op7_near_vectors"] = f"""
with recursive rows as (
    select vec_id, label, list_transform(embedding, lambda c: cast(c as double)) as x from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
        and len(list_filter(embedding, lambda c: c <> 0)) > 0
),
links as (
    select a.vec_id as a, b.vec_id as b from rows a join rows b on a.label = b.label and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.x, b.x) >= 0.93
),
nodes as (select vec_id as id from embeddings), {_COMPONENTS}
select e.vec_id, count(l.b) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join components c on c.node = e.vec_id left join links l on l.a = e.vec_id group by all
"""

ORACLES["op12_hard_negatives"] = """
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x
    from embeddings
    where label is not null and embedding is not null
        and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
),
scored as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
        cast(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) as bigint) as score
    from rows a, rows b
    where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id,
    cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as integer) as rank,
    n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
    and 80 * p.positive_score <= 100 * n.score and n.score <= p.positive_score
qualify rank <= 5
"""

ORACLES["op13_substring_dedup"] = r"""
with texts as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
),
windows as (
    select r, i, hash(array_to_string(words[i:i + 34], ' ')) as h, md5(array_to_string(words[i:i + 34], ' ')) as m
    from (select r, words, unnest(range(1, len(words) - 33)) as i from texts)
),
repeated as (
    select r, i from windows semi join (select h, m from windows group by h, m having count(*) > 1) using (h, m)
),
gone as (select distinct r, unnest(range(i, i + 35)) as i from repeated),
kept as (
    select r, count(*) as n_removed, list(i) as gone from gone group by r
)
select doc_id, len(words) as n_words, coalesce(n_removed, 0) as n_removed,
    sha256(array_to_string(case when gone is null then words else
        list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda p: not list_contains(gone, p[2])), lambda p: p[1])
    end, ' ')) as kept_sha256
from texts left join kept using (r)
"""


for _f in (
    op1_tree_search, op2_bpe_round_trip, op3_html_main_text, op4_pii_pseudonyms, op5_best_fit_packing, op6_minhash_near_dedup, op7_near_vectors,
    op8_toxicity, op9_token_files, op10_language_model, op11_whitening, op12_hard_negatives,
    op13_substring_dedup,
):
    QUERIES[_f.__name__] = _registered(_f)
