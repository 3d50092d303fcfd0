"""Schema inference over all values of JSON records, inside the JVM.

Records come as JSON text or as VARIANT. The outcome is a DataFrame with one row per field path, as many as there are; only
what needs a schema object (a mapping, a Spark type) brings a bounded number of them to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield import config
from inkfield.functions import values as V
from inkfield.functions.text import column_name
from inkfield.session import materialize

LEVELS = 4  # levels of objects opened in one pass; deeper ones are carried on with
MAX_FIELDS = 10_000  # of a schema object
PATHS_AT_ONCE = 100_000  # field paths that a task sorts and joins, about; they compress so well that bytes shuffled say little


@dataclass(frozen=True)
class Field:
    """A field path with its merged kind; ``nested`` says that its objects have typed members."""

    path: tuple[str, ...]
    kind: str
    nested: bool
    bits: int


def _parsed(records: DataFrame, value: str) -> DataFrame:
    """The records as VARIANT in ``__v``, those in JSON text parsed.

    NaN and infinities, which JSON has no words for but some writers write, count as doubles; the text changes in no
    other kind.
    """
    from inkfield.sources.records import parse_records

    if not isinstance(records.schema[value].dataType, T.StringType):
        return records.select(F.col(value).alias("__v"))
    text = F.col(value)
    number = F.regexp_replace(text, r"(?<=[:\[,]\s{0,99})-?(?:NaN|Infinity)(?=\s*[,}\]])", "0e0")
    spoken = F.when(F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity")), number).otherwise(text)
    return parse_records(records.where(text.isNotNull()).select(spoken.alias("__j")), "__j", "__v")


def _type(v) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _opened(nodes: DataFrame) -> DataFrame:
    """(path, val, t) one level further: members of objects in their place; other values and empty objects stay."""
    objects = nodes.withColumn("inner", F.when(F.col("t").startswith("OBJECT"), F.col("val")))
    members = objects.lateralJoin(nodes.sparkSession.tvf.variant_explode_outer(F.col("inner").outer()))
    inside = F.col("key").isNotNull()
    return members.select(
        F.when(inside, F.concat("path", F.array("key"))).otherwise(F.col("path")).alias("path"),
        F.when(inside, F.col("value")).otherwise(F.col("val")).alias("val"),
        F.when(inside, _type("value")).otherwise(F.col("t")).alias("t"),
    )


def field_kinds(records: DataFrame, value: str = "v", levels: int | None = None) -> DataFrame:
    """(path, bits), one row per field path: the union of the kinds of all its values, objects opened at any depth.

    ``levels`` opens that many levels only. Kinds are combined before the shuffle, so what moves is #paths rows per task,
    however many records there are and whichever field is the common one. One pass opens LEVELS levels; where objects are left,
    they alone are written and carried on with.
    """
    root = F.array().cast("array<string>")
    nodes = _parsed(records, value).select(root.alias("path"), F.col("__v").alias("val"), F.lit("OBJECT<").alias("t"))
    unopened = F.col("t").startswith("OBJECT") & (F.col("t") != "OBJECT<>")
    found = []
    while True:
        for _ in range(levels or LEVELS):
            nodes = _opened(nodes)
        kinds = nodes.where(F.size("path") > 0).select("path", V.field_bits("val", "t").cast("int").alias("bits"), unopened.alias("open"))
        kinds = materialize(kinds.groupBy("path").agg(F.bit_or("bits").alias("bits"), F.max("open").alias("open")), "kinds")
        found.append(kinds.select("path", "bits"))
        if levels or kinds.where("open").isEmpty():
            break
        left = materialize(nodes.where(unopened).select("path", F.to_json("val").alias("j"), "t"), "members")
        nodes = left.select("path", F.parse_json("j").alias("val"), "t")
    rows = reduce(DataFrame.unionAll, found)
    # A member says that all above it are objects.
    an_object = F.lit(V.BIT["object"] | V.DICT_SEEN | V.CONTAINER_SEEN)
    up_to = lambda n: F.struct(F.slice("path", 1, n).alias("path"), F.when(n == F.size("path"), F.col("bits")).otherwise(an_object).alias("bits"))
    every = rows.select(F.inline(F.transform(F.sequence(F.lit(1), F.size("path")), up_to)))
    return every.groupBy("path").agg(F.bit_or("bits").alias("bits"))


def merged_fields(records: DataFrame, value: str = "v", strict_dates: bool = False) -> DataFrame:
    """(path, kind, nested, bits) of the fields of a search index, any number of them.

    Members count only where everything above them is nested: of a field that holds objects and texts nothing is known inside.
    ``strict_dates`` turns a mix of dates and other strings into strings instead of dates.
    """
    kind = V.merged_kind("bits")
    if strict_dates:
        mixed = F.col("bits").bitwiseAND(F.lit(V.BIT["string"])) != 0
        kind = F.when((kind == "date") & mixed, "keyword").otherwise(kind)
    fields = field_kinds(records, value).select("path", kind.alias("kind"), "bits")
    nested = (F.col("kind") == "object") & (F.col("bits").bitwiseAND(F.lit(V.DICT_SEEN)) != 0)
    fields = materialize(fields.withColumn("nested", nested).select("path", "kind", "nested", "bits"), "fields")
    parts = max(1, -(-fields.count() // PATHS_AT_ONCE))
    by = lambda df, key: df.repartition(parts, key) if parts > 1 else df
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))
    above = fields.where(F.size("path") > 1).select("path", F.explode(prefixes).alias("above"))
    plain = fields.where(~F.col("nested")).select(F.col("path").alias("above"))
    # An object may have most of the paths for members: what is above them is told apart before it is joined.
    closed = materialize(by(above.select("above").distinct(), "above").join(by(plain, "above"), "above", "left_semi"), "closed")
    hidden = above.join(closed, "above").select("path").distinct()
    return by(fields, "path").join(by(hidden, "path"), "path", "left_anti")


def infer_fields(records: DataFrame, value: str = "v", strict_dates: bool = False, most: int = MAX_FIELDS) -> list[Field]:
    """``merged_fields`` as a list, parents before members; more than ``most`` are refused."""
    rows = merged_fields(records, value, strict_dates).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} fields: records with data for keys, which merged_fields takes")
    rows = sorted(rows, key=lambda r: (len(r["path"]), r["path"]))
    return [Field(tuple(r["path"]), r["kind"], r["nested"], r["bits"]) for r in rows]


def search_mapping(fields: list[Field]) -> dict:
    """Nested mapping: typed leaves, ``nested`` objects with properties, text with a keyword sub-field."""
    root: dict = {"properties": {}}
    nodes = {(): root}
    for f in fields:
        if f.nested:
            node = {"type": "nested", "properties": {}}
        elif f.kind in ("boolean", "long", "double", "date"):
            node = {"type": f.kind}
        else:
            node = {"type": "text", "fields": {"keyword": {"type": "keyword", "ignore_above": config.KEYWORD_MAX_CHARS}}}
        nodes[f.path] = node
        nodes[f.path[:-1]]["properties"][f.path[-1]] = node
    return root


_LEAF = {"boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.TimestampType()}


def spark_schema(fields: list[Field]) -> T.StructType:
    """The Spark type of inferred fields; mixed and text fields are strings."""

    def struct(prefix: tuple[str, ...]) -> T.StructType:
        return T.StructType(
            [
                T.StructField(f.path[-1], struct(f.path) if f.nested else _LEAF.get(f.kind, T.StringType()))
                for f in fields
                if f.path[:-1] == prefix
            ]
        )

    return struct(())


def sql_column_types(records: DataFrame, value: str = "v") -> DataFrame:
    """Relational columns of top-level members: (key, name, sql_type), keys sorted, all-null keys left out."""
    merged = field_kinds(records, value, 1).select(F.col("path")[0].alias("key"), "bits")
    b = F.col("bits")
    is_ = lambda *ks: b.bitwiseAND(F.lit(~sum(V.BIT[k] for k in ks))) == 0
    sql_type = (
        F.when(b.bitwiseAND(F.lit(V.CONTAINER_SEEN)) != 0, "JSONB")
        .when(is_("boolean"), "BOOLEAN")
        .when(is_("long"), "BIGINT")
        .when(is_("long", "double"), "DOUBLE PRECISION")
        .when(is_("string", "date") & (b.bitwiseAND(F.lit(V.BIT["date"])) != 0), "TIMESTAMPTZ")
        .otherwise("TEXT")
    )
    return merged.where(b != 0).select(
        "key", column_name("key").alias("name"), sql_type.alias("sql_type")
    ).orderBy("key")


@dataclass(frozen=True)
class SqlColumn:
    key: str
    name: str
    sql_type: str


def infer_columns(records: DataFrame, value: str = "v", most: int = MAX_FIELDS) -> list[SqlColumn]:
    """Relational columns by key; two keys that sanitise to one column name, or more than ``most`` columns, are refused early."""
    columns = [SqlColumn(*r) for r in sql_column_types(records, value).limit(most + 1).collect()]
    if len(columns) > most:
        raise ValueError(f"more than {most} columns")
    if not columns:
        raise ValueError("every value of the records is null or there are none: no table to make")
    if len({c.name for c in columns}) != len(columns):
        raise ValueError("two keys give the same column name")
    return columns


def typed_rows(records: DataFrame, fields: list[Field], value: str = "v", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records as typed columns; a value that does not fit its field becomes null."""
    schema = spark_schema(fields)
    out = [
        F.try_variant_get(F.try_element_at("__m", F.lit(f.name)), "$", f.dataType.simpleString()).alias(f.name)
        for f in schema.fields
    ]
    return records.select(*keep, F.col(value).try_cast("map<string,variant>").alias("__m")).select(*keep, *out)


def relational_rows(
    records: DataFrame, columns: list[SqlColumn], value: str = "v", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Records as relational columns under sanitised names; a missing key is NULL."""
    rows = records.select(*keep, F.col(value).try_cast("map<string,variant>").alias("__m"))
    return rows.select(
        *keep,
        *[V.relational_value(F.try_element_at("__m", F.lit(c.key)), c.sql_type).alias(c.name) for c in columns],
    )
