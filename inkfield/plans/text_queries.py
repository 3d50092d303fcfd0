"""Named queries over text: normalisation, names, parsing of model outputs, chunks, segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfield.functions import text as X
from inkfield.operators import chunks as C
from inkfield.operators import retrieve as R
from inkfield.operators.conversation import conversation_prompts
from inkfield.operators.segments import segment, tokens_of
from inkfield.plans.registry import query, table, wide

# Noise the documents do not have: tabs, NUL-free control blanks, CR line ends, blank lines, a ligature.
_NOISY = "concat('  \t', replace(replace(text, ' ', ' \t '), '.', 'ﬁ.\r\n \r\n\r\t\n\n'), '\n \n')"


def _noisy():
    spread = F.replace(F.col("text"), F.lit(" "), F.lit(" \t "))
    return F.concat(F.lit("  \t"), F.replace(spread, F.lit("."), F.lit("ﬁ.\r\n \r\n\r\t\n\n")), F.lit("\n \n"))


def _clean_sql(text: str) -> str:
    out = f"replace({text}, 'ﬁ', 'fi')"
    out = f"regexp_replace({out}, '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    out = f"regexp_replace({out}, '(?m)^ +| +$', '', 'g')"
    out = f"regexp_replace({out}, '\\A\\s+|\\s+\\z', '', 'g')"
    return f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"""
select doc_id, md5(t) as text_md5, length(t)::integer as n_chars
from (select doc_id, {_clean_sql(_NOISY)} as t from documents)
""")
def normalize_text(spark, sf_dir):
    docs = wide(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.normalize_text(_noisy()).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query(f"""
with c as (
  select doc_id, {_NOISY} as t from documents union all select -doc_id - 1, ' ' || chr(9) || chr(10) from documents
)
select doc_id, md5(left(t, 1800)) as text_md5, length(left(t, 1800))::integer as n_chars
from (select doc_id, {_clean_sql('t')} as t from c) where t <> ''
""")
def sanitize_chunks(spark, sf_dir):
    docs = wide(spark, sf_dir, "documents", "doc_id", "text")
    blank = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(" \t\n").alias("text"))
    rows = C.sanitize(docs.select("doc_id", _noisy().alias("text")).unionByName(blank))
    return rows.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query()
def chunk_documents(spark, sf_dir):
    rows = C.split_documents(wide(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("chunk_id", "doc_id", "chunk_index", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query()
def chunk_load_counts(spark, sf_dir):
    return C.chunk_counts(wide(spark, sf_dir, "documents", "text"))


@query(r"""
with s as (
  select o_orderkey, case (o_orderkey % 7)::integer
    when 0 then strftime(o_orderdate, '%Y-%m-%d')
    when 1 then '  ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z ' || chr(10)
    when 2 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.125+02:00'
    when 3 then strftime(o_orderdate, '%d-%m-%Y')
    when 4 then strftime(o_orderdate, '%Y-%m-%d') || 'T'
    when 5 then '2024-99-99'
    else o_orderpriority end as s
  from orders)
select o_orderkey, regexp_matches(trim(s, ' ' || chr(10)),
  '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$') as is_date
from s
""")
def iso_date_filter(spark, sf_dir):
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    kind = F.col("o_orderkey") % 7
    s = (
        F.when(kind == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(kind == 1, F.concat(F.lit("  "), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z \n")))
        .when(kind == 2, F.concat(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit(".125+02:00")))
        .when(kind == 3, F.date_format(d, "dd-MM-yyyy"))
        .when(kind == 4, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T")))
        .when(kind == 5, "2024-99-99")
        .otherwise(F.col("o_orderpriority"))
    )
    return o.select("o_orderkey", X.is_iso_date(s).alias("is_date"))


@query(r"""
with n as (
  select page_id, lower(case when contains(f, '.') and not starts_with(f, '.') and not ends_with(f, '.')
    then regexp_replace(f, '\.[^.]+$', '') else f end) as stem
  from (select page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') || '.JSON' as f from pages)),
m as (
  select page_id,
    regexp_replace(regexp_replace(stem, '[^a-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') as index_name,
    regexp_replace(regexp_replace(stem, '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') as t
  from n)
select page_id, nullif(index_name, '') as index_name,
  nullif(case when regexp_matches(t, '^[0-9]') then 't_' || t else t end, '') as table_name
from m
""")
def sanitize_file_names(spark, sf_dir):
    f = F.concat(F.regexp_replace("url", r"/+\z", ""), F.lit(".JSON"))
    return table(spark, sf_dir, "pages").select(
        "page_id", X.index_name(f, on_empty="null").alias("index_name"), X.table_name(f, on_empty="null").alias("table_name")
    )


@query(r"""
with n as (
  select p_partkey, regexp_replace(regexp_replace(lower(k), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') as c
  from (select p_partkey, case when p_partkey % 2 = 0 then p_size || ' ' || p_type else ' #' || p_name || '-' || p_brand || '# ' end as k
        from part))
select p_partkey, nullif(case when regexp_matches(c, '^[0-9]') then 'f_' || c else c end, '') as column_name from n
""")
def sanitize_column_names(spark, sf_dir):
    key = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", F.col("p_size").cast("string"), "p_type")).otherwise(
        F.concat(F.lit(" #"), "p_name", F.lit("-"), "p_brand", F.lit("# "))
    )
    return table(spark, sf_dir, "part").select("p_partkey", X.column_name(key, on_empty="null").alias("column_name"))


_LINE_SQL = "replace(text, chr(10), ' ')"


def _line():
    return F.replace(F.col("text"), F.lit("\n"), F.lit(" "))


@query(f"""
select doc_id, md5(coalesce(nullif(regexp_replace(r, '^\\s+|\\s+$', '', 'g'), ''), text)) as query_md5
from (select doc_id, text, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then ' ' || chr(9) || chr(10)
        else '  ' || {_LINE_SQL} || chr(10) end as r from documents)
""")
def refined_query(spark, sf_dir):
    r = F.when(F.col("doc_id") % 3 == 1, " \t\n").when(F.col("doc_id") % 3 == 2, F.concat(F.lit("  "), _line(), F.lit("\n")))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.retrieval_query(r, "text")).alias("query_md5"))


_CRITIC_SQL = f"""case (doc_id % 7)::integer
    when 0 then 'PASS'
    when 1 then 'REVISE: ' || {_LINE_SQL} || chr(10) || 'refined_query:  ' || {_LINE_SQL} || '  '
    when 2 then {_LINE_SQL} || chr(10) || '  pass  ' || chr(10) || 'REFINED_QUERY: ' || {_LINE_SQL}
    when 3 then {_LINE_SQL}
    when 4 then ' ' || chr(10)
    when 5 then 'revise : ' || {_LINE_SQL} || chr(10) || 'PASS'
    else {_LINE_SQL} || ' so revise: ' || {_LINE_SQL} end"""


def critic_outputs(docs):
    kind = F.col("doc_id") % 7
    return docs.withColumn(
        "critic",
        F.when(kind == 0, "PASS")
        .when(kind == 1, F.concat(F.lit("REVISE: "), _line(), F.lit("\nrefined_query:  "), _line(), F.lit("  ")))
        .when(kind == 2, F.concat(_line(), F.lit("\n  pass  \nREFINED_QUERY: "), _line()))
        .when(kind == 3, _line())
        .when(kind == 4, " \n")
        .when(kind == 5, F.concat(F.lit("revise : "), _line(), F.lit("\nPASS")))
        .otherwise(F.concat(_line(), F.lit(" so revise: "), _line())),
    )


_VERDICT_SQL = """case when regexp_matches(t, '(?im)^\\s*PASS\\s*$') then 'PASS'
    when regexp_matches(t, '(?im)^\\s*REVISE\\s*:') or contains(upper(t), 'REVISE:') then 'REVISE' else 'PASS' end"""
_REFINED_SQL = "trim(regexp_extract(t, '(?im)^REFINED_QUERY:\\s*(.+)$', 1))"


@query(f"""
with o as (select doc_id, regexp_replace({_CRITIC_SQL}, '\\A\\s+|\\s+\\z', '', 'g') as t from documents)
select doc_id, {_VERDICT_SQL} as verdict, md5({_REFINED_SQL}) as refined_md5 from o
""")
def critic_verdict(spark, sf_dir):
    o = critic_outputs(wide(spark, sf_dir, "documents", "doc_id", "text"))
    return o.select(
        "doc_id", X.critic_verdict("critic").alias("verdict"), F.md5(X.critic_refined_query("critic")).alias("refined_md5")
    )


@query(f"""
with o as (select doc_id, text, (doc_id % 4)::integer as iters, regexp_replace({_CRITIC_SQL}, '\\A\\s+|\\s+\\z', '', 'g') as t
           from documents),
v as (select *, case when iters >= 2 then 'PASS' else {_VERDICT_SQL} end as verdict, {_REFINED_SQL} as refined from o)
select doc_id, verdict,
  case when verdict = 'REVISE' then md5(case when refined <> '' then refined else text end) end as query_md5,
  (iters + case when verdict = 'REVISE' then 1 else 0 end)::integer as next_iters
from v
""")
def review_round(spark, sf_dir):
    o = critic_outputs(wide(spark, sf_dir, "documents", "doc_id", "text"))
    o = o.withColumn("critic_iters", (F.col("doc_id") % 4).cast("int"))
    r = R.reviewed(o, question="text")
    return r.select("doc_id", "verdict", F.md5("retrieval_query").alias("query_md5"), "next_iters")


@query(f"""
with p as (
  select doc_id, case (doc_id % 3)::integer
    when 0 then '1) ' || {_LINE_SQL} || chr(10) || '###' || chr(10) || '2) ' || {_LINE_SQL} || chr(10) || '### ' || chr(10)
    when 1 then '1) ' || {_LINE_SQL} || chr(10) || '2) ' || {_LINE_SQL} || chr(10) || '3) c' || chr(10) || '4) d'
    else {_LINE_SQL} end as raw
  from documents),
s as (
  select doc_id, case when doc_id % 3 = 1 and not contains(text, '###')
    then [{_LINE_SQL}, {_LINE_SQL}, 'c']
    else [trim(x, ' ' || chr(10)) for x in string_split(raw, '###') if trim(x, ' ' || chr(10)) <> ''] end as steps
  from p join documents using (doc_id))
select doc_id, pos::integer as step, md5(steps[pos + 1]) as step_md5
from (select doc_id, steps, unnest(range(len(steps))) as pos from s)
""")
def plan_steps(spark, sf_dir):
    kind = F.col("doc_id") % 3
    raw = (
        F.when(kind == 0, F.concat(F.lit("1) "), _line(), F.lit("\n###\n2) "), _line(), F.lit("\n### \n")))
        .when(kind == 1, F.concat(F.lit("1) "), _line(), F.lit("\n2) "), _line(), F.lit("\n3) c\n4) d")))
        .otherwise(_line())
    )
    docs = wide(spark, sf_dir, "documents", "doc_id", "text")
    steps = docs.select("doc_id", F.posexplode(X.plan_steps(raw)).alias("step", "s"))
    return steps.select("doc_id", "step", F.md5("s").alias("step_md5"))


@query("select doc_id, md5(left(text, 8000)) as context_md5 from documents")
def context_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.truncate_context("text")).alias("context_md5"))


@query("select conv_id, turn, case when length(text) <= 256 then text end as keyword from conversations")
def keyword_field(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.keyword("text").alias("keyword"))


@query("""
select conv_id, turn, role, text <> '' and role in ('user', 'assistant') as accepted from conversations
""")
def accepted_messages(spark, sf_dir):
    ok, bad = R.reject_blank(table(spark, sf_dir, "conversations"))
    return ok.select("conv_id", "turn", "role", F.lit(True).alias("accepted")).unionByName(
        bad.select("conv_id", "turn", "role", F.lit(False).alias("accepted"))
    )


PROMPT_SQL = """
with m as (
  select conv_id, turn, role, text, case when role = 'user' then 'User: ' else 'Assistant: ' end || text as line
  from conversations where role in ('user', 'assistant')),
w as (
  select *, string_agg(line, chr(10)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as past
  from m)
select conv_id as session_id, {turn} md5(case when past is null then text else past || chr(10) || 'User: ' || text end) as prompt_md5
from w where role = 'user'
"""


@query(PROMPT_SQL.format(turn="turn,"))
def conversation_prompt(spark, sf_dir):
    ok, _ = R.reject_blank(table(spark, sf_dir, "conversations"))
    p = conversation_prompts(ok, session="conv_id")
    return p.select("session_id", "turn", F.md5("prompt").alias("prompt_md5"))


def message_tokens(spark, sf_dir):
    """Every message as a token stream."""
    ok, _ = R.reject_blank(wide(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return tokens_of(ok, F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


@query()
def token_segments(spark, sf_dir):
    return segment(message_tokens(spark, sf_dir))


@query()
def document_segments(spark, sf_dir):
    docs = wide(spark, sf_dir, "documents", "doc_id", "text")
    return segment(tokens_of(docs, "doc_id")).withColumnRenamed("stream_id", "doc_id")
