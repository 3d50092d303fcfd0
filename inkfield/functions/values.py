"""Value kinds of VARIANT values, and value clean-up for JSON and relational targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield.functions.text import col, is_iso_date

# One bit per kind, so that the kinds of a field are an associative bit_or.
KINDS = ("boolean", "long", "double", "date", "string", "object", "keyword")
BIT = {k: 1 << i for i, k in enumerate(KINDS)}
ALL_KINDS = (1 << len(KINDS)) - 1
DICT_SEEN = 1 << 8  # an object value itself, not a list of objects
CONTAINER_SEEN = 1 << 9  # any list or object

# The kind that a field becomes by the kinds of its values; any other mix is a keyword.
MERGED = {
    (): "keyword",
    ("boolean",): "boolean",
    ("long",): "long",
    ("double",): "double",
    ("long", "double"): "double",
    ("date",): "date",
    ("string",): "keyword",
    ("date", "string"): "date",
    ("object",): "object",
}

_SCALAR_BITS = {
    "BOOLEAN": BIT["boolean"],
    "BIGINT": BIT["long"],
    "DECIMAL": BIT["double"],
    "DOUBLE": BIT["double"],
    "FLOAT": BIT["double"],
    "DATE": BIT["date"],
    "TIMESTAMP": BIT["date"],
    "TIMESTAMP_NTZ": BIT["date"],
    "OBJECT": BIT["object"],
    "VOID": 0,
}


def with_value(value: Column, f) -> Column:
    """Bind ``value`` to a lambda variable, so that a large expression is evaluated once."""
    return F.transform(F.array(value), f)[0]


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for entry in table.items() for x in entry]), key)


def _scalar_bits(v: Column, t: Column) -> Column:
    """Kind bit of a value that is no list, by its type name."""
    return (
        F.when(t == "STRING", F.when(is_iso_date(v.try_cast("string")), BIT["date"]).otherwise(BIT["string"]))
        # An integer beyond 64 bits is held as a wide decimal without a fraction.
        .when(t.rlike(r"^DECIMAL\((19|2\d|3\d),0\)"), BIT["long"])
        .otherwise(F.coalesce(_lookup(_SCALAR_BITS, F.regexp_extract(t, "^[A-Z_]+", 0)), F.lit(BIT["keyword"])))
    )


def _nesting(v: Column) -> Column:
    """How deep the brackets of a value's JSON text go; those of objects count too."""
    bare = F.regexp_replace(F.regexp_replace(F.to_json(v), r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    steps = F.transform(F.split(bare, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    one = lambda acc, step: F.struct(
        (acc["now"] + step).alias("now"), F.greatest(acc["most"], acc["now"] + step).alias("most")
    )
    return F.aggregate(steps, start, one, lambda acc: acc["most"])


def _leaves(v: Column, t: Column) -> Column:
    """Items of a list, those of lists in it instead of these, at any depth."""
    items = v.try_cast("array<variant>")
    opened = lambda x: F.when(F.schema_of_variant(x).startswith("ARRAY"), x.try_cast("array<variant>")).otherwise(F.array(x))
    one_less = lambda acc, _: F.flatten(F.transform(acc, opened))
    nested = F.aggregate(F.sequence(F.lit(2), F.greatest(_nesting(v), F.lit(2))), items, one_less)
    return F.when(t.rlike("^ARRAY<(?:ARRAY|VARIANT)"), nested).otherwise(items)


def _list_bits(v: Column, t: Column) -> Column:
    """The one kind that all leaves of a list share, ``keyword`` where they differ, 0 without any.

    Lists in lists need no levels of their own: an inner list is of mixed kind only if its leaves differ.
    """
    element = F.regexp_extract(t, "^(?:ARRAY<)+([A-Z_]+)", 1)
    kinds = F.transform(_leaves(v, t), lambda x: F.coalesce(with_value(F.schema_of_variant(x), lambda y: _scalar_bits(x, y)), F.lit(0)))
    mixed = F.aggregate(kinds, F.lit(0), lambda acc, b: acc.bitwiseOR(b))
    told = with_value(mixed, lambda m: F.when(F.bit_count(m) > 1, BIT["keyword"]).otherwise(m))
    # Types of items that differ merge to VARIANT, DOUBLE or DECIMAL, dates are STRING; these alone are looked at.
    return F.when(element.isin("BOOLEAN", "BIGINT", "OBJECT", "VOID"), _lookup(_SCALAR_BITS, element)).otherwise(told)


def _kind_of(v: Column, t: Column) -> Column:
    return F.when(t.startswith("ARRAY"), _list_bits(v, t)).otherwise(_scalar_bits(v, t))


def kind_bits(v) -> Column:
    """Bit of the value's kind, 0 for null and for empty or all-null lists.

    A list has the one kind its items share, else ``keyword``; lists in lists count by their items, however deep.
    """
    v = col(v)
    return F.coalesce(with_value(F.schema_of_variant(v), lambda t: _kind_of(v, t)), F.lit(0))


def field_bits(v, type_name) -> Column:
    """``kind_bits`` with the marks that tell objects and containers apart; the type name is at hand."""
    t = col(type_name)
    marks = F.when(t.startswith("OBJECT"), DICT_SEEN | CONTAINER_SEEN).when(t.startswith("ARRAY"), CONTAINER_SEEN)
    return F.coalesce(_kind_of(col(v), t).bitwiseOR(marks.otherwise(0)), F.lit(0))


def kind_name(bits) -> Column:
    """Name of a single kind bit; null when there is none."""
    return _lookup({b: k for k, b in BIT.items()}, col(bits))


def merged_kind(bits) -> Column:
    """The one kind that a set of kinds becomes."""
    by_mask = {sum(BIT[k] for k in kinds): kind for kinds, kind in MERGED.items()}
    return F.coalesce(_lookup(by_mask, col(bits).bitwiseAND(F.lit(ALL_KINDS))), F.lit("keyword"))


def json_safe(df: DataFrame) -> DataFrame:
    """NaN to null and dates to ISO strings, column by column from the declared types.

    Seconds carry a fraction only where there is one, as ISO formatting does.
    """

    def iso(c: Column, zone: str) -> Column:
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
        return F.concat(text, F.date_format(c, zone)) if zone else text

    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = iso(c, "")
        elif isinstance(f.dataType, T.TimestampType):
            c = iso(c, "xxx")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def json_document(df: DataFrame, name: str = "doc") -> DataFrame:
    """One JSON object per row, nulls kept as members."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def relational_value(v, sql_type: str) -> Column:
    """A VARIANT field as a relational column; JSONB columns hold any value as JSON, null stays null."""
    v = col(v)
    if sql_type == "JSONB":
        return F.when(F.schema_of_variant(v) != "VOID", F.to_json(v))
    return v.cast(SQL_TO_SPARK[sql_type])


# Relational type names and the Spark types that hold them.
SQL_TO_SPARK = {
    "BOOLEAN": "boolean",
    "BIGINT": "bigint",
    "DOUBLE PRECISION": "double",
    "TIMESTAMPTZ": "timestamp",
    "TEXT": "string",
    "JSONB": "string",
}
