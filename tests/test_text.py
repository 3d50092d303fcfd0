"""Text functions against plain Python on random input, and hand-written cases."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from inkfield.functions import text as X
from inkfield.functions.chunk import split_text
from inkfield.operators import chunks as C


def column(spark, values, *exprs, name="t"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_normalize_known_cases(spark):
    got = column(spark, ["  a  \tb  \r\n  c\r  d  \n\n\n\nx  ", "a\x00b", "", None], X.normalize_text("t"))
    assert [g[0] for g in got] == ["a b\nc\nd\n\nx", "ab", "", ""]


def test_normalize_random(spark):
    rnd = random.Random(5)
    alphabet = "ab \t\n\r\x00\x0b\x0c\x1c\x1f\x85   　ﬁ①Ǻe."
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    got = [g[0] for g in column(spark, texts, X.normalize_text("t"))]
    for before, after in zip(texts, got):
        assert not re.search(r"[\r\t\x00]|  |\n\n\n", after)
        assert "".join(after.split()) == "".join(unicodedata.normalize("NFKC", before).replace("\x00", "").split())


def test_pystrip_random(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("a \t\n\r\x0b\x1c\x1d\x85  ​") for _ in range(8)) for _ in range(500)]
    assert [g[0] for g in column(spark, texts, X.pystrip("t"))] == [t.strip() for t in texts]


def test_iso_dates(spark):
    yes = ["2024-01-01", " 2024-01-01T10:00:00Z\n", "2024-99-99", "2024-01-01 10:00:00.5+0200", "2024-01-01T10:00:00-02:00"]
    no = ["2024-1-01", "2024-01-01T", "2024-01-01T10:00", "x2024-01-01", "2024-01-01T10:00:00z", ""]
    got = column(spark, yes + no, X.is_iso_date("t"))
    assert [g[0] for g in got] == [True] * len(yes) + [False] * len(no)


def test_names(spark):
    paths = ["/a/My File (1).JSON", "/x/.hidden", "2024 data.tar.gz", "/a/__.json", "/a/b/", "a."]
    got = column(spark, paths, X.index_name("t", "null"), X.table_name("t", "null"))
    assert got == [
        ("my_file_1", "my_file_1"), ("hidden", "hidden"), ("2024_data.tar", "t_2024_data_tar"), (None, None), ("b", "b"), ("a", "a"),
    ]
    assert column(spark, ["Odd Key", "1st", "é", "_x_"], X.column_name("t", "null")) == [("odd_key",), ("f_1st",), (None,), ("x",)]


def test_empty_name_is_an_error(spark):
    import pytest

    with pytest.raises(Exception, match="cannot derive index name"):
        column(spark, ["/a/...json"], X.index_name("t"))


def test_plan_steps(spark):
    plans = [
        "1) step one\n###\n2) step two\n###\n3) step three\n###\n",
        "1) a\nmore\n2) b\n3) c\n4) d ###",
        "only one",
        "",
        None,
        "1) alone",
    ]
    got = [g[0] for g in column(spark, plans, X.plan_steps("t"))]
    assert got == [
        ["1) step one", "2) step two", "3) step three"], ["a\nmore", "b", "c"], ["only one"], [], [], ["1) alone"],
    ]


def test_critic(spark):
    said = [
        "PASS", "", None, "REVISE: thin\nREFINED_QUERY:  how to  ", "looks good", "revise : x", "REVISE: x\n  pass ",
        "pass\nREVISE: y", "I would REVISE: it", "REVISE: a\nREFINED_QUERY:\nnext line", "PASSED",
    ]
    got = column(spark, said, X.critic_verdict("t"), X.critic_refined_query("t"))
    assert got == [
        ("PASS", ""), ("PASS", ""), ("PASS", ""), ("REVISE", "how to"), ("PASS", ""), ("REVISE", ""), ("PASS", ""),
        ("PASS", ""), ("REVISE", ""), ("REVISE", "next line"), ("PASS", ""),
    ]


def test_retrieval_query(spark):
    df = spark.createDataFrame([(" r ", "q"), ("", "q"), (None, "q"), (" \n", None)], "r string, q string")
    assert [x[0] for x in df.select(X.retrieval_query("r", "q")).collect()] == ["r", "q", "q", ""]


def test_query_prompt(spark):
    assert column(spark, ["  find   it "], X.with_query_prompt("t", "P: "))[0][0] == "P: find it"


def test_split_hand_made():
    assert split_text("aaaa bbbb cccc", 10, 5) == ["aaaa bbbb", "bbbb cccc"]
    assert split_text("aaaa bbbb cccc", 10, 0) == ["aaaa bbbb", "cccc"]
    assert split_text("one\n\ntwo\n\nthree", 9, 0) == ["one\n\ntwo", "three"]
    assert split_text("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    assert split_text("   \n\n  ", 10, 2) == []
    assert split_text("short", 10, 2) == ["short"]


def test_split_invariants():
    """Chunks are stripped, short enough, in order, overlap by little and lose nothing but white space."""
    rnd = random.Random(7)
    for _ in range(200):
        words = ["".join(f"{n}-{i}_" for i in range(rnd.choice([1, 1, 1, 40]))) for n in range(rnd.randint(0, 150))]
        text = "".join(w + rnd.choice([" ", ". ", "\n", "\n\n", "  "]) for w in words)
        at = 0
        for c in split_text(text, 60, 12):
            assert 0 < len(c) <= 60 and c == c.strip()
            places = [p for p in range(max(0, at - 13), at + 9) if text.startswith(c, p) and p + len(c) > at]
            assert places and not text[at : places[0]].strip()
            at = places[0] + len(c)
        assert not text[at:].strip()


def test_truncation_and_empty_documents(spark):
    docs = spark.createDataFrame([("a", "word " * 500)], "doc_id string, text string")
    got = C.split_documents(docs, max_chars=50).collect()
    assert got and all(len(r["text"]) <= 50 for r in got)
    blank = spark.createDataFrame([("a", "   \n\n  ")], "doc_id string, text string")
    import pytest

    with pytest.raises(ValueError, match="No valid chunks"):
        C.require_chunks(C.split_documents(blank))


def test_chunks_equal_plain_python(spark):
    rnd = random.Random(8)
    texts = [" ".join("w" * rnd.randint(1, 12) + rnd.choice(["", ".", "\n", "\n\n"]) for _ in range(rnd.randint(0, 900))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["doc_id"], r["chunk_index"]): r["text"] for r in C.split_documents(docs).collect()}
    pieces = [(i, j, c) for i, t in enumerate(texts) for j, c in enumerate(split_text(t))]
    normal = [g[0] for g in column(spark, [c for *_, c in pieces], X.normalize_text("t"))]
    assert got == {(i, j): n[:1800] for (i, j, _), n in zip(pieces, normal) if n}


def test_truncated_chunk_by_nfkc(spark):
    """Normalisation can lengthen a chunk beyond the cut."""
    docs = spark.createDataFrame([("a", "ﷺ" * 1000)], "doc_id string, text string")
    assert C.split_documents(docs).select(F.length("text")).first()[0] == 1800
    assert C.chunk_counts(docs).first()["truncated"] == 1


def test_batches_are_worked_on_in_pieces():
    import pyarrow as pa

    from inkfield.functions.batches import PIECE_BYTES, pieces
    from inkfield.functions.text import nfkc

    a = pa.array(["é" * 4000] * 5000 + [None])
    parts = list(nfkc.func(iter([a])))
    assert len(parts) > 5 and max(p.nbytes for p in parts) < 2 * PIECE_BYTES
    assert pa.concat_arrays(parts).equals(a)
    assert list(pieces(a[:0])) == [] and [len(p) for p in pieces(pa.array([None, None]))] == [2]
