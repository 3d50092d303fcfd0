"""Joins, ids, schemas, snapshots and keyed tables on small hand-made data."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from inkfield.functions import values as V
from inkfield.functions.vectors import format_bytes
from inkfield.operators import joins as J
from inkfield.operators import ordinals as O
from inkfield.operators import records as K
from inkfield.operators import schema as S
from inkfield.operators import snapshots as N
from inkfield.sources import records as SR


def variants(spark, values):
    return SR.parse_records(spark.createDataFrame([(json.dumps(v),) for v in values], "j string"), "j")


def texts(spark, values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], "j string")


def test_join_embed_keys_as_text_and_last_wins(spark):
    base = spark.createDataFrame([(1, "10", "old"), (2, "11", "old"), (3, None, "old")], "id int, k string, customer string")
    lookup = spark.createDataFrame([(10, "first", 0), (10, "last", 1), (None, "x", 2)], "k int, name string, _ordinal int")
    got = {r["id"]: r["customer"] for r in J.join_embed(base, lookup, join_on="k", embed_as="customer", order_by="_ordinal").collect()}
    assert json.loads(got[1]) == {"k": 10, "name": "last"} and got[2] == got[3] == "old"
    c = J.join_counters(base, lookup, join_on="k").first().asDict()
    assert c == {
        "base": 3, "lookup": 3, "embedded": 1, "missing_match": 1, "missing_key": 1, "duplicate_keys": 1, "skipped_lookup": 1,
    }


def test_join_embed_salts_do_not_match(spark):
    """Base rows without a key are spread over numbers that are keys of the lookup."""
    base = spark.range(3000).select("id", F.lit(None).cast("string").alias("k"))
    lookup = spark.range(1024).select(F.col("id").alias("k"), F.col("id").alias("o"))
    j = J.join_embed(base, lookup, join_on="k", embed_as="e", order_by="o")
    assert j.where("e is not null").count() == 0 and j.count() == 3000


def test_join_keys_of_other_types(spark):
    df = spark.createDataFrame([(True, 1.5)], "b boolean, d double")
    assert df.select(J.join_key(df, "b")).first()[0] == "True"
    with pytest.raises(TypeError):
        J.join_key(df, "d")


def test_parents_and_children(spark):
    p = spark.createDataFrame([(1,), (2,)], "id int")
    c = spark.createDataFrame([(10, 1), (11, 1), (12, 9)], "id int, pid int")
    assert [r[0] for r in J.has_child(p, c, "id", "pid").collect()] == [1]
    assert [r[0] for r in J.has_child(p, c, "id", "pid", negate=True).collect()] == [2]
    assert sorted(r[0] for r in J.has_parent(p, c, "id", "pid").collect()) == [10, 11]
    rows = {(r["parent_id"], r["child_id"]) for r in J.children_of(p, c, "id", "pid").collect()}
    assert rows == {(1, 10), (1, 11), (2, None)}


USERS = [
    {"id": 1, "name": "a", "active": True, "score": 9.5, "created_at": "2024-01-01T10:00:00Z", "tags": ["x"], "meta": {"a": 1}},
    {"id": 2, "name": "b", "active": False, "score": 8, "created_at": "2024-01-02"},
]


def test_search_mapping_of_users(spark):
    fields = S.infer_fields(variants(spark, USERS))
    text = {"type": "text", "fields": {"keyword": {"type": "keyword", "ignore_above": 256}}}
    assert S.search_mapping(fields) == {
        "properties": {
            "active": {"type": "boolean"}, "created_at": {"type": "date"}, "id": {"type": "long"},
            "meta": {"type": "nested", "properties": {"a": {"type": "long"}}}, "name": text, "score": {"type": "double"}, "tags": text,
        }
    }


def test_sql_columns_of_users(spark):
    columns = {c.key: c.sql_type for c in S.infer_columns(variants(spark, USERS))}
    assert columns == {
        "active": "BOOLEAN", "created_at": "TIMESTAMPTZ", "id": "BIGINT", "meta": "JSONB", "name": "TEXT",
        "score": "DOUBLE PRECISION", "tags": "JSONB",
    }


@pytest.mark.parametrize(
    "values, kind, sql_type",
    [
        ([None, []], "keyword", "JSONB"),
        ([True, False], "boolean", "BOOLEAN"),
        ([1, 2], "long", "BIGINT"),
        ([1, 2.5], "double", "DOUBLE PRECISION"),
        ([2**70], "long", "BIGINT"),
        (["2024-01-01"], "date", "TIMESTAMPTZ"),
        (["x", "2024-01-01"], "date", "TIMESTAMPTZ"),
        (["x"], "keyword", "TEXT"),
        ([True, 1], "keyword", "TEXT"),
        ([[1, 2.5]], "keyword", "JSONB"),
        ([[[1], [2]]], "long", "JSONB"),
        ([[[1], ["a"]]], "keyword", "JSONB"),
        ([{"a": 1}, "x"], "keyword", "JSONB"),
        ([[{"a": 1}]], "object", "JSONB"),
    ],
)
def test_merge_table(spark, values, kind, sql_type):
    records = [{"f": v} for v in values]
    for df, c in ((variants(spark, records), "v"), (texts(spark, records), "j")):
        (f,) = [f for f in S.infer_fields(df, c) if f.path == ("f",)]
        assert f.kind == kind and not f.nested
        assert [s.sql_type for s in S.infer_columns(df, c)] == [sql_type]


def test_text_and_variant_agree(spark):
    import random

    rnd = random.Random(2)

    def value(depth):
        kind = rnd.randrange(9 if depth else 7)
        if kind == 7:
            return {rnd.choice("abc"): value(depth - 1) for _ in range(rnd.randrange(3))}
        if kind == 8:
            return [value(depth - 1) for _ in range(rnd.randrange(3))]
        return [None, True, 3, 2.5, "x", "2024-01-01", 2**70][kind]

    for _ in range(3):
        records = [{k: value(2) for k in "pqr" if rnd.random() < 0.8} for _ in range(12)]
        both = [S.infer_fields(variants(spark, records)), S.infer_fields(texts(spark, records), "j")]
        assert both[0] == both[1]
        assert S.infer_columns(variants(spark, records)) == S.infer_columns(texts(spark, records), "j")


def test_text_records_follow_the_rules_of_the_format(spark):
    rows = spark.createDataFrame([('[{"a": NaN}, {"a": 1, "a": 2.5}]',), ("[]",)], "j string")
    assert [(f.path, f.kind) for f in S.infer_fields(rows, "j")] == [(("a",), "double")]
    with pytest.raises(Exception, match="JSON root"):
        S.infer_fields(spark.createDataFrame([("3",)], "j string"), "j")


def test_strict_dates(spark):
    (f,) = S.infer_fields(variants(spark, [{"f": "x"}, {"f": "2024-01-01"}]), strict_dates=True)
    assert f.kind == "keyword"


def test_all_null_keys(spark):
    records = variants(spark, [{"f": None, "g": 1}])
    assert [(f.path, f.kind) for f in S.infer_fields(records)] == [(("f",), "keyword"), (("g",), "long")]
    assert [c.key for c in S.infer_columns(records)] == ["g"]
    with pytest.raises(ValueError):
        S.infer_columns(variants(spark, [{"f": None}]))


def test_deep_objects(spark):
    deep = {"x": 1}
    for _ in range(5):
        deep = {"o": deep}
    fields = S.infer_fields(variants(spark, [deep]))
    assert [f.path for f in fields][-1] == ("o",) * 5 + ("x",) and fields[-1].kind == "long"


def test_any_depth_and_keys_as_data(spark):
    value = [[[[[1], [None]]]], [[[[2]]]]]
    deep = {"x": value, "empty": {}}
    for _ in range(11):
        deep = {"o.o": deep, "n": 1}
    records = [deep, {"o.o": {"by": {str(k): k for k in range(300)}}}, {"say \"hi\"": [[[[[{"a": "]"}]]]]]}, {"l": [[[[1]]], [[["x"]]]]}]
    for df, c in ((variants(spark, records), "v"), (texts(spark, records), "j")):
        got = {tuple(r["path"]): (r["kind"], r["nested"]) for r in S.merged_fields(df, c).collect()}
        assert got[("o.o",) * 11 + ("x",)] == ("long", False) and got[("o.o",) * 11 + ("empty",)] == ("object", True)
        assert got[('say "hi"',)] == ("object", False) and got[("l",)] == ("keyword", False)
        assert all(got["o.o", "by", str(k)] == ("long", False) for k in range(300))
        assert len(got) == 11 * 2 + 2 + 1 + 300 + 2
        with pytest.raises(ValueError, match="more than 100 fields"):
            S.infer_fields(df, c, most=100)


def test_members_of_mixed_fields_are_left_out(spark):
    records = [{"f": {"a": {"b": 1}}, "g": {"a": {"b": 1}}}, {"f": "text", "g": {"a": 2}}]
    got = {tuple(r["path"]): r["kind"] for r in S.merged_fields(variants(spark, records)).collect()}
    assert got == {("f",): "keyword", ("g",): "object", ("g", "a"): "keyword"}


def test_clashing_column_names(spark):
    with pytest.raises(ValueError, match="same column"):
        S.infer_columns(variants(spark, [{"a b": 1, "a_b": 2}]))


def test_typed_and_relational_rows(spark):
    records = variants(spark, USERS)
    t = S.typed_rows(records, S.infer_fields(records)).orderBy("id").collect()
    assert t[0]["meta"]["a"] == 1 and t[1]["meta"] is None and t[1]["score"] == 8.0
    r = S.relational_rows(records, S.infer_columns(records)).orderBy("id").collect()
    assert r[0]["tags"] == '["x"]' and r[1]["tags"] is None and r[0]["active"] is True


@pytest.mark.parametrize("text", ["3", '["a"]', '[{"a":1}, 2]', '"x"'])
def test_bad_json_roots(spark, text):
    with pytest.raises(Exception, match="JSON"):
        SR.parse_records(spark.createDataFrame([(text,)], "j string"), "j").collect()


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "b.json").write_text('{"a": 3}')
    (tmp_path / "c.json").write_text("[]")
    rows = SR.read_json(spark, str(tmp_path)).select(F.try_variant_get("v", "$.a", "int").alias("a"), "_pos")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0), (2, 1), (3, 0)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "bad.json").write_text('{"a": 1')
    with pytest.raises(Exception):
        SR.read_json(spark, str(tmp_path / "d")).collect()
    (tmp_path / "d" / "bad.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert SR.read_json(spark, str(tmp_path / "d"), lines=True).count() == 2


def test_json_safe(spark):
    row = (float("nan"), dt.datetime(2024, 1, 1, 10, 0, 0, 250000), dt.date(2024, 1, 2), None, 1)
    df = spark.createDataFrame([row], "x double, at timestamp_ntz, d date, s string, i int")
    (doc,) = V.json_document(df).first()
    assert json.loads(doc) == {"x": None, "at": "2024-01-01T10:00:00.250000", "d": "2024-01-02", "s": None, "i": 1}


def test_dense_ids_with_ties_and_hot_values(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("hot"), "id")
    got = O.dense_ordinals(df, ["hot", "id"], partitions=7).collect()
    want = {r: i for i, r in enumerate(sorted((int(i % 3 == 0), i) for i in range(5000)))}
    assert {(r["hot"], r["id"]): r["_ordinal"] for r in got} == want


def test_first_rows_over_files(spark, tmp_path):
    spark.range(0, 1000, 1, 4).write.parquet(str(tmp_path / "t"))
    rows = O.first_rows(spark, str(tmp_path / "t"), 300).orderBy("_ordinal").collect()
    assert [r["_ordinal"] for r in rows] == list(range(300)) and [r["id"] for r in rows] == list(range(300))


@pytest.mark.parametrize("n, workers", [(10, 8), (16, 8), (3, 8), (1000, 7)])
def test_slices(spark, n, workers):
    size = -(-n // workers)
    got = [r["w"] for r in spark.range(n).orderBy("id").select(O.slice_of("id", n, workers).alias("w")).collect()]
    assert got == [i // size for i in range(n)]


def test_trips(spark, tmp_path):
    spark.createDataFrame([(1, 2.0), (2, None)], "VendorID bigint, trip_distance double").coalesce(1).write.parquet(str(tmp_path / "t"))
    t = SR.read_trips(spark, str(tmp_path / "t"), 1)
    assert len(t.columns) == 20 and t.count() == 1 and dict(t.dtypes)["VendorID"] == "int" and t.first()["Airport_fee"] is None


def test_insert_conflict(spark):
    base = spark.createDataFrame([(1, "a")], "id int, x string")
    assert K.insert(base, spark.createDataFrame([(2, "b")], "id int, x string"), "id").count() == 2
    for rows in ([(1, "b")], [(3, "b"), (3, "c")]):
        with pytest.raises(ValueError, match="key conflict"):
            K.insert(base, spark.createDataFrame(rows, "id int, x string"), "id")


def test_matrix_checks(spark):
    vec = lambda rows: spark.createDataFrame(rows, "id int, embedding array<float>")
    assert K.matrix_shape(vec([(1, [1.0, 2.0])])) == (1, 2)
    for bad in ([], [(1, [1.0]), (2, [1.0, 2.0])], [(1, None)]):
        with pytest.raises(ValueError):
            K.matrix_shape(vec(bad))


def test_snapshots(spark, tmp_path):
    s = lambda rows: spark.createDataFrame(rows, "path string, length bigint, modified timestamp")
    t = dt.datetime(2024, 1, 1)
    a, b = s([("x", 1, t), ("y", 1, t)]), s([("x", 2, t), ("z", 1, t)])
    assert {tuple(r) for r in N.diff(a, b).collect()} == {("x", "modified"), ("y", "removed"), ("z", "added")}
    assert N.changed(None, a) and N.changed(a, b) and not N.changed(a, a)
    assert N.load_state(spark, str(tmp_path / "none")) is None
    N.save_state(a, str(tmp_path / "s"))
    assert not N.changed(N.load_state(spark, str(tmp_path / "s")), a)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    assert N.load_state(spark, str(tmp_path / "bad")) is None
    assert {tuple(r) for r in N.rebuild_plan(a, b, force=True).collect()} == {("x", "build"), ("z", "build"), ("y", "drop")}
    copies = a.unionByName(a)
    assert not N.tables_equal(copies, a).first()["equal"] and N.tables_equal(copies, copies).first()["equal"]


def test_format_bytes(spark):
    sizes = [0, 1023, 1024, 1152, 1536, 1024**2 - 1, 1024**2, 153_600_000, 1024**3, 5 * 1024**4 + 7]

    def plain(n):
        for power, name in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
            if n >= 1024**power:
                return f"{n / 1024**power:.2f} {name} ({n:,} bytes)"
        return f"{n:,} bytes"

    df = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", format_bytes("n").alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == {n: plain(n) for n in sizes}


def test_fields_below_one_object_with_many_members(spark, monkeypatch):
    """What lies above many paths is told apart before it is joined, and paths are dealt out by their number."""
    rows = [{"by": {f"k{i}": {"n": i}}, "d": {"a": i} if i % 2 else "text"} for i in range(400)]
    asked = []
    plain = lambda: {tuple(r["path"]): (r["kind"], r["nested"]) for r in S.merged_fields(texts(spark, rows), "j").collect()}
    want = plain()
    assert len(want) == 802 and ("d", "a") not in want and want[("by", "k7", "n")] == ("long", False)
    monkeypatch.setattr(S, "PATHS_AT_ONCE", 50)
    write = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: asked.append((name, write(df, name))) or asked[-1][1])
    assert plain() == want
    closed = [df for name, df in asked if name == "closed"]
    assert [tuple(r["above"]) for r in closed[0].collect()] == [("d",)]
    assert len(asked) and S.merged_fields(texts(spark, rows), "j").rdd.getNumPartitions() >= 10
