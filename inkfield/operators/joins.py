"""Join-and-embed, its counters, and parent/child joins over a mixed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield.session import materialize

_SPREAD = 1024


def join_key(df: DataFrame, name: str) -> Column:
    """A join key as text: 10 meets "10"; booleans read True/False; fractional keys are refused."""
    t = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        raise TypeError(f"{name}: fractional numbers are no join keys")
    if isinstance(t, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def last_by_key(lookup: DataFrame, key: str, ordinal: str, as_: str = "__record") -> DataFrame:
    """One record per key, the last in order; combined map-side, so a key held by many rows is cheap.

    The place ``_ordinal`` of a source is not part of its records.
    """
    record = F.struct(*[f"`{c}`" for c in lookup.columns if c != "_ordinal"])
    return (
        lookup.where(F.col(f"`{key}`").isNotNull())
        .groupBy(join_key(lookup, key).alias("__key"))
        .agg(F.max_by(record, F.col(ordinal)).alias(as_))
    )


def join_embed(base: DataFrame, lookup: DataFrame, *, join_on: str, embed_as: str, order_by: str) -> DataFrame:
    """Left join that nests the whole matching lookup record under ``embed_as``.

    Keys are compared as text, the last lookup record of a key wins, null keys match nothing, and a
    column already called ``embed_as`` is replaced on a match only. Base rows without a key get one from
    their content, which spreads them over the shuffle and is barred from matching.

    The lookup, one record per key, is written first. So the planner knows its size and broadcasts it only
    below its threshold; and otherwise both sides are plain shuffles, which is what lets AQE split the base
    rows of a common key (an aggregation right below the join would not).
    """
    records = materialize(last_by_key(lookup, join_on, order_by).withColumnRenamed("__key", "__found"), "lookup")
    key = join_key(base, join_on)
    spread = F.pmod(F.xxhash64(*base.columns), F.lit(_SPREAD)).cast("string")
    b = base.withColumn("__has", key.isNotNull()).withColumn("__key", F.coalesce(key, spread))
    joined = b.join(records, (F.col("__key") == F.col("__found")) & F.col("__has"), "left")
    keep = [f"`{c}`" for c in base.columns if c != embed_as]
    hit = F.col("__record")
    if embed_as in base.columns:
        if base.schema[embed_as].dataType != records.schema["__record"].dataType:
            # The two have different types, so the column holds JSON.
            old, new = F.to_json(F.struct(F.col(embed_as))), F.to_json(hit)
            hit = F.when(hit.isNotNull(), new).otherwise(F.get_json_object(old, f"$['{embed_as}']"))
        else:
            hit = F.coalesce(hit, F.col(embed_as))
    return joined.select(*keep, hit.alias(embed_as))


def join_counters(base: DataFrame, lookup: DataFrame, *, join_on: str) -> DataFrame:
    """One row: base, lookup, embedded, missing_match, missing_key, duplicate_keys, skipped_lookup.

    Both sides are counted per key first, so the join meets each key once and no key is a hot one.
    """
    b = base.groupBy(join_key(base, join_on).alias("k")).agg(F.count("*").alias("nb"))
    l = lookup.groupBy(join_key(lookup, join_on).alias("k")).agg(F.count("*").alias("nl"))
    both = b.join(l, "k", "full")
    # Null keys never meet: they arrive as rows of one side.
    nb, nl = F.coalesce("nb", F.lit(0)), F.coalesce("nl", F.lit(0))
    has_key = F.col("k").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        total(nb).alias("base"),
        total(nl).alias("lookup"),
        total(F.when(has_key & (nl > 0), nb)).alias("embedded"),
        total(F.when(has_key & (nl == 0), nb)).alias("missing_match"),
        total(F.when(~has_key, nb)).alias("missing_key"),
        total(F.when(has_key & (nl > 0), nl - 1)).alias("duplicate_keys"),
        total(F.when(~has_key, nl)).alias("skipped_lookup"),
    )


def split_relation(mixed: DataFrame, relation: str, parent: str, child: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children of a table that holds both row types."""
    return mixed.where(F.col(relation) == parent), mixed.where(F.col(relation) == child)


def has_child(parents: DataFrame, children: DataFrame, id_: str, parent_id: str, negate: bool = False) -> DataFrame:
    """Parents with (or without) a child; children shrink to distinct parent ids before the join."""
    ids = children.select(F.col(parent_id).alias("__id")).distinct()
    return parents.join(ids, parents[id_] == ids["__id"], "left_anti" if negate else "left_semi")


def has_parent(parents: DataFrame, children: DataFrame, id_: str, parent_id: str, negate: bool = False) -> DataFrame:
    """Children whose parent exists (or does not); a parent with many children is split by AQE."""
    ids = parents.select(F.col(id_).alias("__id"))
    return children.join(ids, children[parent_id] == ids["__id"], "left_anti" if negate else "left_semi")


def children_of(parents: DataFrame, children: DataFrame, id_: str, parent_id: str) -> DataFrame:
    """Each parent with each of its children as rows, childless parents once.

    Rows, not one list per parent: a parent may own a large share of all children. An inner join, in which
    the children of one parent can be split, and the childless parents beside it; a left join could not
    split them.
    """
    p = parents.select(*[F.col(c).alias(f"parent_{c}") for c in parents.columns])
    c = children.select(*[F.col(x).alias(f"child_{x}") for x in children.columns])
    pairs = c.join(p, p[f"parent_{id_}"] == c[f"child_{parent_id}"]).select(*p.columns, *c.columns)
    childless = has_child(parents, children, id_, parent_id, negate=True)
    childless = childless.select(*[F.col(x).alias(f"parent_{x}") for x in parents.columns])
    return pairs.unionByName(childless, allowMissingColumns=True)


def child_counts(parents: DataFrame, children: DataFrame, id_: str, parent_id: str) -> DataFrame:
    """Children per parent, counted before the join."""
    n = children.groupBy(F.col(parent_id).alias("__id")).agg(F.count("*").alias("n_children"))
    return parents.join(n, parents[id_] == n["__id"], "left").select(
        *[parents[c] for c in parents.columns], F.coalesce("n_children", F.lit(0)).alias("n_children")
    )
