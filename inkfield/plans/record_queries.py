"""Named queries over records: joins, snapshots, ids, keyed tables, JSON values and schemas, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfield.functions import values as V
from inkfield.functions.vectors import format_bytes as bytes_text
from inkfield.operators import joins as J
from inkfield.operators import ordinals as O
from inkfield.operators import records as K
from inkfield.operators import schema as S
from inkfield.operators import snapshots as N
from inkfield.plans.registry import ORACLES, query, table, wide
from inkfield.session import scratch_path
from inkfield.sinks import documents as WD
from inkfield.sinks import tables as W
from inkfield.sources import records as SR

# Base keys with gaps: some null, some without a match.
_KEY_SQL = "case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then c_custkey + 1000000000 else c_custkey end"


def _base(spark, sf_dir):
    key = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 11 == 0, F.col("c_custkey") + 1_000_000_000)
    key = key.otherwise(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", key.alias("custkey"))


def _lookup(spark, sf_dir):
    """Orders by customer, the key as text: a customer's last order wins; some have no key."""
    o = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", key.alias("custkey"), "o_orderstatus", "o_totalprice")


@query(f"""
with l as (
  select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders where o_orderkey % 5 <> 0)
select c_custkey, c_name, o_orderkey as order_key, o_orderstatus as order_status, o_totalprice as order_price
from (select *, {_KEY_SQL} as k from customer) c left join l on c.k = l.o_custkey and l.rn = 1
""")
def join_embed_last_wins(spark, sf_dir):
    j = J.join_embed(
        _base(spark, sf_dir), _lookup(spark, sf_dir), join_on="custkey", embed_as="order", order_by="o_orderkey"
    )
    return j.select(
        "c_custkey",
        "c_name",
        F.col("order.o_orderkey").alias("order_key"),
        F.col("order.o_orderstatus").alias("order_status"),
        F.col("order.o_totalprice").alias("order_price"),
    )


@query(f"""
with b as (select {_KEY_SQL} as k from customer),
l as (select case when o_orderkey % 5 <> 0 then o_custkey end as k from orders),
d as (select distinct k from l where k is not null)
select (select count(*) from b) as base, (select count(*) from l) as lookup,
  (select count(*) from b where k in (select k from d)) as embedded,
  (select count(*) from b where k is not null and k not in (select k from d)) as missing_match,
  (select count(*) from b where k is null) as missing_key,
  (select count(k) - count(distinct k) from l) as duplicate_keys,
  (select count(*) from l where k is null) as skipped_lookup
""")
def join_counters(spark, sf_dir):
    c = J.join_counters(_base(spark, sf_dir), _lookup(spark, sf_dir), join_on="custkey")
    return c.select(*[F.col(x).cast("bigint").alias(x) for x in c.columns])


def _mixed(spark, sf_dir):
    """Customers and orders as two row types of one table."""
    c = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("relation"), F.col("c_custkey").alias("id"), F.lit(None).cast("bigint").alias("parent_id"),
        F.col("c_acctbal").alias("amount"),
    )
    o = table(spark, sf_dir, "orders").select(
        F.lit("order").alias("relation"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 9 == 0, F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey")).alias("parent_id"),
        F.col("o_totalprice").alias("amount"),
    )
    return J.split_relation(c.unionByName(o), "relation", "customer", "order")


_ORDERS_SQL = """o as (select o_orderkey as id, case when o_orderkey % 9 = 0 then o_custkey + 1000000000 else o_custkey end as parent_id,
  o_totalprice as amount from orders)"""


@query(f"""
with {_ORDERS_SQL}
select c_custkey as id, c_acctbal as amount from customer c where exists (select 1 from o where o.parent_id = c.c_custkey and o.amount > 100000)
""")
def has_child(spark, sf_dir):
    p, c = _mixed(spark, sf_dir)
    return J.has_child(p, c.where("amount > 100000"), "id", "parent_id").select("id", "amount")


@query(f"""
with {_ORDERS_SQL}
select c_custkey as id, c_acctbal as amount from customer c where not exists (select 1 from o where o.parent_id = c.c_custkey and o.amount > 300000)
""")
def has_no_child(spark, sf_dir):
    p, c = _mixed(spark, sf_dir)
    return J.has_child(p, c.where("amount > 300000"), "id", "parent_id", negate=True).select("id", "amount")


@query(f"""
with {_ORDERS_SQL}
select id, parent_id, amount from o where exists (select 1 from customer c where o.parent_id = c.c_custkey and c.c_acctbal > 0)
""")
def has_parent(spark, sf_dir):
    p, c = _mixed(spark, sf_dir)
    return J.has_parent(p.where("amount > 0"), c, "id", "parent_id").select("id", "parent_id", "amount")


@query(f"""
with {_ORDERS_SQL}
select c_custkey as parent_id, c_acctbal as parent_amount, o.id as child_id, o.amount as child_amount
from customer c left join o on o.parent_id = c.c_custkey
""")
def children_of(spark, sf_dir):
    p, c = _mixed(spark, sf_dir)
    j = J.children_of(p, c, "id", "parent_id")
    return j.select(F.col("parent_id"), "parent_amount", "child_id", "child_amount")


@query(f"""
with {_ORDERS_SQL}
select c_custkey as id, count(o.id) as n_children from customer c left join o on o.parent_id = c.c_custkey group by 1
""")
def child_counts(spark, sf_dir):
    p, c = _mixed(spark, sf_dir)
    return J.child_counts(p.select("id"), c, "id", "parent_id")


def _versions(spark, sf_dir):
    """Two states of one set of files: some were added, some removed, some edited."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    path = F.concat(F.lit("file:/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = d.select("doc_id", path.alias("path"), F.col("n_chars").alias("length"), F.timestamp_seconds("doc_id").alias("modified"))
    old = rows.where(F.col("doc_id") % 10 != 0).drop("doc_id")
    edited = F.when(F.col("doc_id") % 7 == 0, F.col("length") + 1).otherwise(F.col("length"))
    new = rows.where(F.col("doc_id") % 9 != 0).withColumn("length", edited).drop("doc_id")
    return old, new


_STATUS_SQL = """
with v as (select doc_id, 'file:/docs/' || source || '/' || doc_id || '.txt' as path, doc_id % 10 <> 0 as was,
  doc_id % 9 <> 0 as is_, doc_id % 7 = 0 as edited from documents),
s as (select path, case when not was then 'added' when not is_ then 'removed' when edited then 'modified' else 'same' end as status
  from v where was or is_)
"""


@query(f"{_STATUS_SQL} select path, status from s")
def snapshot_diff(spark, sf_dir):
    return N.diff(*_versions(spark, sf_dir))


@query(f"""{_STATUS_SQL}
select path, case status when 'same' then 'keep' when 'removed' then 'drop' else 'build' end as action from s""")
def incremental_plan(spark, sf_dir):
    return N.rebuild_plan(*_versions(spark, sf_dir))


@query(f"""{_STATUS_SQL}
select (select sum(case status when 'same' then 0 when 'modified' then 2 else 1 end) from s) = 0 as equal,
  (select sum(case status when 'same' then 0 when 'modified' then 2 else 1 end) from s)::bigint as differing
union all select true, 0""")
def snapshot_equal(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return N.tables_equal(old, new).unionByName(N.tables_equal(old, old))


@query(f"""{_STATUS_SQL}
select status, count(*) as n, status <> 'same' as is_change from s group by 1""")
def index_fresh(spark, sf_dir):
    """Through the saved form: what the freshness gate sees, by status."""
    old, new = _versions(spark, sf_dir)
    path = scratch_path(spark, "state")
    N.save_state(old, path)
    d = N.diff(N.load_state(spark, path), new)
    return d.groupBy("status").agg(F.count("*").alias("n")).withColumn("is_change", F.col("status") != "same")


@query("""
with u as (select vec_id + 100 as vec_id, label + 100 as label, vec_id as o from embeddings where vec_id % 2 = 0
  union all select vec_id, label + 200, vec_id + 1000000000 from embeddings where vec_id % 3 = 0),
l as (select vec_id, label from (select *, row_number() over (partition by vec_id order by o desc) as rn from u) where rn = 1)
select vec_id, label::integer as label from l
union all select vec_id, label from embeddings where vec_id not in (select vec_id from l)
""")
def vector_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    u = e.where("vec_id % 2 = 0").select(
        (F.col("vec_id") + 100).alias("vec_id"), "embedding", (F.col("label") + 100).alias("label"), F.col("vec_id").alias("o")
    )
    v = e.where("vec_id % 3 = 0").select(
        "vec_id", "embedding", (F.col("label") + 200).alias("label"), (F.col("vec_id") + 1_000_000_000).alias("o")
    )
    return K.upsert(e, u.unionByName(v), "vec_id", "o").select("vec_id", "label")


@query("""
with n as (select vec_id + 100 as vec_id from embeddings where vec_id % 2 = 0
  union all select -(vec_id // 2) - 1 from embeddings where vec_id % 3 = 0),
c as (select vec_id, count(*) as k from n group by 1)
select vec_id, 'repeated' as reason from c where k > 1
union all select vec_id, 'exists' from c where vec_id in (select vec_id from embeddings)
""")
def vector_insert_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    new = e.where("vec_id % 2 = 0").select((F.col("vec_id") + 100).alias("vec_id"))
    new = new.unionByName(e.where("vec_id % 3 = 0").select((-F.expr("vec_id div 2") - 1).alias("vec_id")))
    return K.insert_conflicts(e, new, "vec_id")


@query("""
select vec_id, label from embeddings union all select -vec_id - 1, label from embeddings
""")
def vector_insert_checked(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    new = e.withColumn("vec_id", -F.col("vec_id") - 1)
    return K.insert(e, new, "vec_id").select("vec_id", "label")


@query("select vec_id, label, (label % 4)::integer as shard from embeddings")
def shard_merge(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    shards = [e.where(F.col("label") % 4 == i).select("vec_id", "label", F.lit(i).alias("shard")) for i in range(4)]
    return K.merge_shards(shards)


@query("""
with r as (select row_number() over (order by o_orderkey) - 1 as i, o_orderkey from orders), n as (select count(*) as n from orders)
select o_orderkey, i as record_id, (i // ceil(n / 8)::bigint)::integer as worker from r, n
""")
def range_partitions(spark, sf_dir):
    ids = O.dense_ordinals(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "record_id")
    return O.range_slices(ids, "record_id", 8)


@query("""
select event_id, (row_number() over (order by user_id, ts, event_id) - 1)::varchar as record_id from events
""")
def record_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    ids = O.dense_ordinals(e, ["user_id", "ts", "event_id"])
    return ids.select("event_id", F.col("_ordinal").cast("string").alias("record_id"))


@query("""
select count(*) as n_rows, min(i) as first_id, max(i) as last_id, count(distinct i) as n_ids
from (select row_number() over () - 1 as i from lineitem)
""")
def file_record_ids(spark, sf_dir):
    ids = O.file_ordinals(spark, f"{sf_dir}/lineitem.parquet").select("_ordinal")
    return ids.agg(
        F.count("*").alias("n_rows"),
        F.min("_ordinal").alias("first_id"),
        F.max("_ordinal").alias("last_id"),
        F.countDistinct("_ordinal").alias("n_ids"),
    )


@query("select least(count(*), 50000) as n_rows, least(count(*), 50000) - 1 as last_id from lineitem")
def row_cap(spark, sf_dir):
    rows = O.first_rows(spark, f"{sf_dir}/lineitem.parquet", 50_000).select("_ordinal")
    return rows.agg(F.count("*").alias("n_rows"), F.max("_ordinal").alias("last_id"))


@query("""
select o_orderkey,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || case when o_orderkey % 2 = 0 then '' else '.250000' end as at,
  strftime(o_orderdate, '%Y-%m-%d') as day, case when o_orderkey % 3 <> 0 then o_totalprice end as price
from orders
""")
def json_safe_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.expr("interval '0.25' second"))
    price = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return V.json_safe(
        o.select("o_orderkey", at.alias("at"), F.col("o_orderdate").cast("date").alias("day"), price.alias("price"))
    )


# Records with every kind of value, built from the events.
_JSON_SQL = """case (event_id % 5)::integer
  when 0 then '{"id":' || event_id || ',"mix":1,"flag":true,"name":"' || event_type || '","meta":{"k":1,"deep":{"x":"2024-01-01"}},"at":"2024-01-01","gap":null,"Odd Key":[1,2]}'
  when 1 then '{"id":' || event_id || ',"mix":2.5,"flag":null,"name":"' || event_type || '","meta":{"k":1.5e2,"tags":["a","b"]},"at":"2024-01-01T10:00:00Z","list":[{"q":1}]}'
  when 2 then '{"id":' || event_id || ',"mix":3,"flag":false,"when":"' || strftime(ts, '%Y-%m-%d') || '","at":"later","nums":[1,2.5],"none":[]}'
  when 3 then '{"id":' || event_id || ',"odd":"x","props":' || props || ',"big":18446744073709551616,"whole":8.0}'
  else '{"id":' || event_id || ',"odd":{"y":1},"ints":[1,2,null],"both":true}' end"""


def json_texts(spark, sf_dir):
    kind = F.col("event_id") % 5
    i, day = F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")
    text = (
        F.when(kind == 0, F.concat(F.lit('{"id":'), i, F.lit(',"mix":1,"flag":true,"name":"'), "event_type", F.lit('","meta":{"k":1,"deep":{"x":"2024-01-01"}},"at":"2024-01-01","gap":null,"Odd Key":[1,2]}')))
        .when(kind == 1, F.concat(F.lit('{"id":'), i, F.lit(',"mix":2.5,"flag":null,"name":"'), "event_type", F.lit('","meta":{"k":1.5e2,"tags":["a","b"]},"at":"2024-01-01T10:00:00Z","list":[{"q":1}]}')))
        .when(kind == 2, F.concat(F.lit('{"id":'), i, F.lit(',"mix":3,"flag":false,"when":"'), day, F.lit('","at":"later","nums":[1,2.5],"none":[]}')))
        .when(kind == 3, F.concat(F.lit('{"id":'), i, F.lit(',"odd":"x","props":'), "props", F.lit(',"big":18446744073709551616,"whole":8.0}')))
        .otherwise(F.concat(F.lit('{"id":'), i, F.lit(',"odd":{"y":1},"ints":[1,2,null],"both":true}')))
    )
    e = wide(spark, sf_dir, "events", "event_id", "ts", "event_type", "props")
    return e.select("event_id", text.alias("j"))


def json_events(spark, sf_dir):
    return SR.parse_records(json_texts(spark, sf_dir), "j")


# The kind of each value, told from its text.
_MEMBERS_SQL = f"""
r as (select event_id, ({_JSON_SQL})::json as j from events),
m as (select event_id, unnest(json_keys(j)) as key, j from r),
f as (select event_id, key, json_extract(j, '$."' || key || '"') as v from m),
k as (select event_id, key, v, json_type(v) as t, json_extract_string(v, '$') as s from f),
g as (select event_id, key, t, case
    when t = 'NULL' then null
    when t = 'BOOLEAN' then 'boolean'
    when t in ('UBIGINT', 'BIGINT', 'HUGEINT') or (t = 'DOUBLE' and not regexp_matches(v::varchar, '[.eE]')) then 'long'
    when t = 'DOUBLE' and key = 'big' then 'long'
    when t = 'DOUBLE' then 'double'
    when t = 'VARCHAR' then case when regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then 'date' else 'string' end
    when t = 'OBJECT' then 'object'
    when key = 'none' then null when key = 'nums' then 'keyword' when key = 'list' then 'object' else 'long' end as kind
  from k)"""


@query(f"with {_MEMBERS_SQL} select event_id, key, kind from g")
def value_kinds(spark, sf_dir):
    e = json_events(spark, sf_dir)
    members = e.select("event_id", F.explode(F.col("v").try_cast("map<string,variant>")).alias("key", "val"))
    return members.select("event_id", "key", V.kind_name(V.kind_bits("val")).alias("kind"))


def _types(fields):
    """Paths with the type of a search index, as a table."""
    typed = F.when(F.col("nested"), "nested").when(F.col("kind").isin("boolean", "long", "double", "date"), F.col("kind")).otherwise("text")
    return fields.select(F.array_join("path", ".").alias("path"), typed.alias("type"))


@query(f"""
with {_MEMBERS_SQL},
nested as (
  select 'meta.k' as path, 'double' as type union all select 'meta.deep', 'nested' union all select 'meta.deep.x', 'date'
  union all select 'meta.tags', 'text' union all select 'props.k', 'long'),
u as (select key, list_sort(list(distinct kind) filter (where kind is not null)) as ks, bool_or(t = 'OBJECT') as dict from g group by 1)
select key as path, case when len(ks) = 0 then 'text' when ks in (['boolean'], ['long'], ['double'], ['date']) then ks[1]
  when ks = ['double', 'long'] then 'double' when ks = ['date', 'string'] then 'date'
  when ks = ['object'] and dict then 'nested' else 'text' end as type
from u union all select path, type from nested
""")
def infer_search_schema(spark, sf_dir):
    return _types(S.merged_fields(json_texts(spark, sf_dir), "j"))


@query(ORACLES["infer_search_schema"])
def infer_variant_schema(spark, sf_dir):
    """The same from VARIANT records."""
    return _types(S.merged_fields(json_events(spark, sf_dir)))


# Lists and objects many levels deep, keys that need quotes, and keys that are data: as many fields as events.
_DEEP_SQL = r"""case (event_id % 4)::integer
  when 0 then '{"id":' || event_id || ',"lists":[[[[[1]]],[[[2],[]]]],null],"say \"hi\".x":{"at":"2024-01-01"},"by":{"' || event_id || '":{"n":1}}}'
  when 1 then '{"id":' || event_id || ',"lists":[[[[[1],[2.5]]]]],"by":{"' || event_id || '":{"n":2.5}},"d":{"a":{"b":{"c":{"e":{"f":{"g":{"h":[["x"]],"i":true}}}}}}}}'
  when 2 then '{"id":"x","mixed":{"k":1},"days":[["2024-01-01"],[]],"objs":[[{"q":1}],{"q":"]"}],"empty":{},"d":{"a":{"b":7}}}'
  else '{"id":' || event_id || ',"mixed":"text","days":[[[["later"]]]],"odd":[[[1]],["a,[",[]]],"objs":[]}' end"""


def _deep_texts(spark, sf_dir):
    e = wide(spark, sf_dir, "events", "event_id")
    i, kind = F.col("event_id").cast("string"), F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('{"id":'), i, F.lit(r',"lists":[[[[[1]]],[[[2],[]]]],null],"say \"hi\".x":{"at":"2024-01-01"},"by":{"'), i, F.lit('":{"n":1}}}')))
        .when(kind == 1, F.concat(F.lit('{"id":'), i, F.lit(',"lists":[[[[[1],[2.5]]]]],"by":{"'), i, F.lit('":{"n":2.5}},"d":{"a":{"b":{"c":{"e":{"f":{"g":{"h":[["x"]],"i":true}}}}}}}}')))
        .when(kind == 2, F.lit('{"id":"x","mixed":{"k":1},"days":[["2024-01-01"],[]],"objs":[[{"q":1}],{"q":"]"}],"empty":{},"d":{"a":{"b":7}}}'))
        .otherwise(F.concat(F.lit('{"id":'), i, F.lit(',"mixed":"text","days":[[[["later"]]]],"odd":[[[1]],["a,[",[]]],"objs":[]}')))
    )
    return e.select(text.alias("j"))


@query(f"""
with recursive members as (
  select event_id, [key] as path, value as v, type as t from (select event_id, ({_DEEP_SQL})::json as j from events) r, json_each(r.j)
  union all
  select m.event_id, list_append(m.path, e.key), e.value, e.type from members m, json_each(m.v) e where m.t = 'OBJECT'),
items as (
  select event_id, path, v, t from members where t = 'ARRAY'
  union all
  select i.event_id, i.path, e.value, e.type from items i, json_each(i.v) e where i.t = 'ARRAY'),
told as (
  select event_id, path, t, case when t = 'NULL' then null when t = 'BOOLEAN' then 'boolean' when t in ('UBIGINT', 'BIGINT') then 'long'
    when t = 'DOUBLE' then 'double' when t = 'OBJECT' then 'object'
    when regexp_matches(json_extract_string(v, '$'), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then 'date' else 'string' end as kind
  from (select * from members where t <> 'ARRAY' union all select * from items where t <> 'ARRAY')),
lists as (
  select event_id, path, case when count(distinct kind) > 1 then 'keyword' else max(kind) end as kind
  from told where (event_id, path) in (select event_id, path from members where t = 'ARRAY') group by all),
kinds as (
  select path, kind, t = 'OBJECT' as dict from told where (event_id, path) not in (select event_id, path from members where t = 'ARRAY')
  union all select path, kind, false from lists
  union all select path, null, false from members),
fields as (
  select path, coalesce(list_sort(list(distinct kind) filter (where kind is not null)), []) as ks, coalesce(bool_or(dict), false) as dict from kinds group by 1),
typed as (
  select path, case when len(ks) = 0 then 'text' when ks in (['boolean'], ['long'], ['double'], ['date']) then ks[1]
    when ks = ['double', 'long'] then 'double' when ks = ['date', 'string'] then 'date'
    when ks = ['object'] and dict then 'nested' else 'text' end as type from fields)
select array_to_string(path, '.') as path, type from typed t
where not exists (select 1 from typed a where a.type <> 'nested' and len(a.path) < len(t.path) and t.path[1:len(a.path)] = a.path)
""")
def infer_deep_schema(spark, sf_dir):
    """Fields at any depth, one for each event among them."""
    return _types(S.merged_fields(_deep_texts(spark, sf_dir), "j"))


@query("""
with v as (select event_id, unnest([0, 1, 2, 3, 4, 5, 6]) as n from events)
select event_id, n::integer as n, case n when 0 then 'long' when 1 then 'keyword' when 2 then 'object' when 3 then 'date' when 4 then 'string'
  when 6 then 'keyword' end as kind from v
""")
def deep_list_kinds(spark, sf_dir):
    """Kinds of lists in lists, two to ten deep."""
    items = [
        ("1", "null"), ("1", "2.5"), ('{"k":[1]}', '{"k":"]"}'), ('"2024-01-01"', "[]"), (r'"a[,\"["', '"2"'), ("null", "[]"), ("1.5", '["x"]'),
    ]
    depth = (F.col("event_id") % 9 + 1).cast("int")
    deep = lambda x: F.concat(F.repeat(F.lit("["), depth), F.lit(x), F.repeat(F.lit("]"), depth))
    lists = [F.concat(F.lit("["), deep(x), F.lit("," + y + "]")) for x, y in items]
    e = wide(spark, sf_dir, "events", "event_id")
    rows = e.select("event_id", F.posexplode(F.array(*lists)).alias("n", "j")).select("event_id", "n", F.parse_json("j").alias("v"))
    return rows.select("event_id", "n", V.kind_name(V.kind_bits("v")).alias("kind"))


@query(f"""
with {_MEMBERS_SQL},
u as (select key, list_sort(list(distinct kind) filter (where kind is not null and t not in ('OBJECT', 'ARRAY'))) as ks,
  bool_or(t in ('OBJECT', 'ARRAY')) as container from g group by 1)
select key, case when key = 'Odd Key' then 'odd_key' else lower(key) end as name,
  case when container then 'JSONB' when ks = ['boolean'] then 'BOOLEAN' when ks = ['long'] then 'BIGINT'
  when ks in (['double'], ['double', 'long']) then 'DOUBLE PRECISION' when ks in (['date'], ['date', 'string']) then 'TIMESTAMPTZ'
  else 'TEXT' end as sql_type
from u where container or len(ks) > 0
""")
def infer_sql_columns(spark, sf_dir):
    return S.sql_column_types(json_texts(spark, sf_dir), "j")


@query("""
select event_id, event_id as id, case (event_id % 5)::integer when 0 then 1.0 when 1 then 2.5 when 2 then 3.0 end::double as mix,
  case (event_id % 5)::integer when 0 then true when 2 then false end as flag,
  case when event_id % 5 <= 1 then event_type end as name,
  case (event_id % 5)::integer when 0 then 1.0 when 1 then 150.0 end::double as meta_k,
  case when event_id % 5 = 3 then json_extract(props::json, '$.k')::bigint end as props_k
from events
""")
def typed_records(spark, sf_dir):
    e = json_events(spark, sf_dir)
    rows = S.typed_rows(e, S.infer_fields(json_texts(spark, sf_dir), "j"), keep=("event_id",))
    return rows.select(
        "event_id", "id", "mix", "flag", "name", F.col("meta.k").alias("meta_k"), F.col("props.k").alias("props_k")
    )


@query("""
select event_id, event_id as id, case (event_id % 5)::integer when 0 then '[1,2]' end as odd_key,
  case (event_id % 5)::integer when 3 then '"x"' when 4 then '{"y":1}' end as odd,
  case (event_id % 5)::integer when 4 then '[1,2,null]' end as ints,
  case (event_id % 5)::integer when 4 then true end as both
from events
""")
def relational_values(spark, sf_dir):
    e = json_events(spark, sf_dir)
    columns = [c for c in S.infer_columns(json_texts(spark, sf_dir), "j") if c.key in ("id", "Odd Key", "odd", "ints", "both")]
    return S.relational_rows(e, columns, keep=("event_id",)).select("event_id", "id", "odd_key", "odd", "ints", "both")


@query("select count(*) as n, sum(len(embedding) * 4)::bigint as bytes from embeddings")
def vector_storage(spark, sf_dir):
    return W.vector_bytes(table(spark, sf_dir, "embeddings")).select("n", F.col("bytes").cast("bigint").alias("bytes"))


_SIZES = "o_orderkey * (case (o_orderkey % 4)::integer when 0 then 1 when 1 then 64 when 2 then 65536 else 67108864 end)"


@query(f"""
select o_orderkey, case
  when n >= 1073741824 then printf('%.2f GiB', n / 1073741824.0::double) || ' (' || format('{{:,}}', n) || ' bytes)'
  when n >= 1048576 then printf('%.2f MiB', n / 1048576.0::double) || ' (' || format('{{:,}}', n) || ' bytes)'
  when n >= 1024 then printf('%.2f KiB', n / 1024.0::double) || ' (' || format('{{:,}}', n) || ' bytes)'
  else format('{{:,}}', n) || ' bytes' end as size
from (select o_orderkey, {_SIZES} as n from orders)
""")
def format_bytes(spark, sf_dir):
    kind = F.col("o_orderkey") % 4
    factor = F.when(kind == 0, 1).when(kind == 1, 64).when(kind == 2, 65536).otherwise(67108864)
    return table(spark, sf_dir, "orders").select("o_orderkey", bytes_text(F.col("o_orderkey") * factor).alias("size"))


@query("""
select event_type, count(*) as n, round(avg(value), 6) as avg_latency, round(count(*) / sum(value), 6) as qps
from events where value > 0 group by 1
""")
def search_run_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 0")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_latency"),
        F.round(F.count("*") / F.sum("value"), 6).alias("qps"),
    )


_DOCS_SQL = """docs as (select o_orderkey as record_id, row_number() over (order by o_orderdate, o_orderkey) - 1 as ordinal,
  case when o_orderkey % 3 <> 0 then o_totalprice end as price, strftime(o_orderdate, '%Y-%m-%d') as day,
  case when o_orderkey % 50 = 0 then '"soon"' else '"' || strftime(o_orderdate, '%Y-%m-%d') || '"' end as due from orders),
checked as (select *, case when price is null then 'price missing' when due = '"soon"' then 'due is no date' end as error from docs)"""


def _order_docs(spark, sf_dir):
    """Orders as JSON documents in the order of their days; some lack what the store wants."""
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    due = F.when(F.col("o_orderkey") % 50 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("id"), price.alias("price"), due.alias("due")), {"ignoreNullFields": "false"})
    docs = o.select("o_orderdate", F.col("o_orderkey").alias("record_id"), doc.alias("doc"))
    return O.dense_ordinals(docs, ["o_orderdate", "record_id"], "ordinal")


def _wants_price_and_day(ids, docs):
    """The store's own check of its documents."""
    import datetime
    import json

    def wrong(doc):
        if doc["price"] is None:
            return "price missing"
        try:
            datetime.date.fromisoformat(doc["due"])
        except ValueError:
            return "due is no date"

    return [wrong(json.loads(d)) for d in docs]


def _loaded(spark, sf_dir):
    """Report of a load into a folder, and the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "loaded"))
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return WD.write_documents(_order_docs(spark, sf_dir), WD.FolderStore(folder, _wants_price_and_day)), folder


@query(f"""with {_DOCS_SQL}
select count(*) as attempted, count(*) filter (where error is null) as succeeded, count(error) as failed from checked
""")
def load_report(spark, sf_dir):
    return _loaded(spark, sf_dir)[0].drop("errors")


@query(f"""with {_DOCS_SQL}
select ordinal, record_id::varchar as record_id, error from checked where error is not null order by ordinal limit 5
""")
def load_first_errors(spark, sf_dir):
    """The first five errors of a load, by the records' places."""
    return WD.first_errors(_loaded(spark, sf_dir)[0])


@query(f"""with {_DOCS_SQL}
select record_id::varchar as id, price, due[2:-2] as due from checked where error is null
""")
def load_read_back(spark, sf_dir):
    """The documents that a load has left in the store."""
    _, folder = _loaded(spark, sf_dir)
    doc = F.from_json("doc", "id bigint, price double, due string").alias("d")
    return spark.read.schema("id string, doc string").parquet(folder).select("id", doc).select("id", "d.price", "d.due")


@query()
def folder_storage(spark, sf_dir):
    """Files and bytes of the tables' folder, and how the total reads."""
    return W.folder_bytes(spark, sf_dir).select("files", "bytes", bytes_text("bytes").alias("size"))


@query("""
select o_orderkey as record_id, case when o_orderkey % 2 = 0 then 'again' else o_orderstatus end as status from orders
""")
def keyed_sink(spark, sf_dir):
    """Write all, then write some again: the same ids replace."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("status"))
    path = scratch_path(spark, "keyed")
    W.write_keyed(o, path)
    W.write_keyed(o.where("record_id % 2 = 0").withColumn("status", F.lit("again")), path)
    return W.read_keyed(spark, path)


@query("""
select c_custkey, c_name, null::varchar as note from customer union all select c_custkey, null, c_name from customer
""")
def relational_sink(spark, sf_dir):
    """Create once, append twice: loads add up, a missing column is NULL."""
    import uuid

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    name = f"inkfield_rel_{uuid.uuid4().hex}"
    schema = c.withColumn("note", F.lit(None).cast("string")).schema
    path = scratch_path(spark, "relational")
    W.create_table(spark, name, schema, path=path)
    W.append_rows(c, name)
    W.append_rows(c.select("c_custkey", F.col("c_name").alias("note")), name)
    rows = spark.read.schema(schema).parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return rows


@query("select true as exists_first, false as made_again, count(*) as rows_kept, 0::bigint as rows_dropped from customer")
def write_modes(spark, sf_dir):
    """Make a table, keep it with its rows, then recreate it empty."""
    import uuid

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    name = f"inkfield_mode_{uuid.uuid4().hex}"
    first = W.create_table(spark, name, c.schema, path=scratch_path(spark, "mode"))
    W.append_rows(c, name)
    again = W.create_table(spark, name, c.schema)
    kept = spark.table(name).count()
    W.create_table(spark, name, c.schema, drop_existing=True, path=scratch_path(spark, "mode"))
    dropped = spark.table(name).count()
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(
        [(first, again, kept, dropped)], "exists_first boolean, made_again boolean, rows_kept bigint, rows_dropped bigint"
    )
