"""Document files, sinks, index refresh and streams, on small folders."""

import io
import datetime as dt
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from inkfield.functions.segment import feed
from inkfield.operators.conversation import conversation_prompts
from inkfield.operators.encode import HashEncoder
from inkfield.operators.segments import segment, tokens_of
from inkfield.plans import index as P
from inkfield.plans.file_queries import _docx, line_pages
from inkfield.plans.store import ChunkStore
from inkfield.sinks import documents as WD
from inkfield.sinks import tables as W
from inkfield.sources import documents as D
from inkfield.streaming import runs
from inkfield.streaming.keyed import segment_stream, session_log


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("hello é".encode())
    (tmp_path / "b.TXT").write_bytes("caf\xe9\r\nx\ry".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes(b"\x81\xe9")
    (tmp_path / "d.docx").write_bytes(_docx("one\ntwo & three"))
    (tmp_path / "e.PDF").write_bytes(b"p1\np2\np3")
    (tmp_path / "readme.md").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.txt").write_text("not listed")
    rows = D.read_documents(spark, str(tmp_path), line_pages, max_pages=2).collect()
    assert [(r["source"].rsplit("/", 1)[1], r["type"], r["text"]) for r in rows] == [
        ("a.txt", "txt", "hello é"), ("b.TXT", "txt", "café\nx\ny"), ("c.txt", "txt", "\x81é"),
        ("d.docx", "docx", "one\ntwo & three"), ("e.PDF", "pdf", "p1\np2"),
    ]


def test_a_byte_order_mark_is_kept(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfx")
    assert D.read_documents(spark, str(tmp_path)).first()["text"] == "﻿x"


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        D.read_documents(spark, str(tmp_path / "none"))
    (tmp_path / "readme.md").write_text("x")
    with pytest.raises(ValueError, match="No supported files"):
        D.read_documents(spark, str(tmp_path))


def test_a_failing_file_is_named(spark, tmp_path):
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    with pytest.raises(Exception, match="Failed to load .*bad.docx"):
        D.read_documents(spark, str(tmp_path)).collect()


def test_docx_skips_tables():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = (
        f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:body></w:document>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    assert D.docx_paragraphs(out.getvalue()) == "a\tb\n"


def test_extraction_cache_is_used(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.pdf").write_bytes(b"first")
    cache = str(tmp_path / "cache")
    files = lambda: D.list_files(spark, str(tmp_path / "docs"))
    assert D.cached_pdf_text(files(), cache, line_pages).first()["text"] == "first"

    def broken(raw, limit):
        raise AssertionError("read again")

    assert D.cached_pdf_text(files(), cache, broken).first()["text"] == "first"
    (tmp_path / "docs" / "a.pdf").write_bytes(b"second one")
    assert D.cached_pdf_text(files(), cache, line_pages).first()["text"] == "second one"


def test_state_needs_no_bytes(spark, tmp_path):
    from inkfield.operators.snapshots import collect_state

    (tmp_path / "one.txt").write_text("x")
    (tmp_path / "two.PDF").write_text("yy")
    state = collect_state(D.list_files(spark, str(tmp_path)))
    assert sorted(r["length"] for r in state.collect()) == [1, 2]
    scan = state._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in scan and "content:binary" not in scan


def numbered(spark, n):
    return spark.range(n).select(F.col("id").alias("record_id"), F.concat(F.lit("d"), F.col("id")).alias("doc"), (n - F.col("id")).alias("ordinal"))


def test_document_sink_tells_errors_by_ordinal(spark, tmp_path):
    writer = lambda ids, docs: ["refused" if int(i) % 4 == 0 else None for i in ids]
    store = WD.FolderStore(f"file://{tmp_path}/out", writer)
    report = WD.write_documents(numbered(spark, 20).repartition(3), store, batch_rows=6, most_errors=3)
    assert tuple(report.drop("errors").first()) == (20, 15, 5)
    assert [tuple(r) for r in WD.first_errors(report).collect()] == [(4, "16", "refused"), (8, "12", "refused"), (12, "8", "refused")]
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(tuple(r) for r in kept.collect()) == sorted((str(k), f"d{k}") for k in range(20) if k % 4)
    assert WD.write_documents(numbered(spark, 0), store).drop("errors").first().asDict() == {"attempted": 0, "succeeded": 0, "failed": 0}


def test_a_load_that_fails_leaves_nothing(spark, tmp_path):
    def writer(ids, docs):
        if "7" in ids:
            raise RuntimeError("store is down")
        return [None] * len(ids)

    store = WD.FolderStore(f"file://{tmp_path}/out", writer)
    with pytest.raises(Exception, match="store is down"):
        WD.write_documents(numbered(spark, 20).repartition(4), store, batch_rows=2)
    assert [f for f in tmp_path.rglob("*.parquet") if not f.name.startswith("_")] == []


def test_a_plain_function_is_a_store(spark):
    report = WD.write_documents(numbered(spark, 5), lambda ids, docs: [None] * len(ids), tasks=2)
    assert tuple(report.first()) == (5, 5, 0, [])


def test_keyed_sink(spark, tmp_path):
    path = str(tmp_path / "k")
    rows = lambda v: spark.createDataFrame(v, "record_id int, x string")
    W.write_keyed(rows([(1, "a"), (2, "b")]), path)
    W.write_keyed(rows([(2, "c"), (3, "d")]), path)
    assert sorted(tuple(r) for r in W.read_keyed(spark, path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_create_table_without_columns(spark):
    from pyspark.sql.types import StructType

    with pytest.raises(ValueError, match="no columns"):
        W.create_table(spark, "inkfield_no_columns", StructType([]))


def test_folder_bytes(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"12345")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c").write_bytes(b"123")
    assert tuple(W.folder_bytes(spark, str(tmp_path)).first()) == (2, 8)


def test_index_is_kept_refreshed_and_forced(spark, tmp_path):
    docs, home = tmp_path / "docs", str(tmp_path / "index")
    docs.mkdir()
    for n in range(6):
        (docs / f"{n}.txt").write_text(f"text number {n}")
    files = lambda: D.list_files(spark, str(docs))
    options = {"lists": 2, "pq_m": None}
    run = lambda **o: P.open_or_refresh(spark, files(), home, HashEncoder(16), **options, **o)
    assert not P.is_fresh(spark, files(), home)
    assert run().rebuilt
    assert P.is_fresh(spark, files(), home) and not P.is_fresh(spark, files(), home, force=True)
    assert not run().rebuilt
    time.sleep(0.01)
    (docs / "0.txt").unlink()
    (docs / "1.txt").write_text("other words here")
    (docs / "9.txt").write_text("added")
    again = run()
    texts = sorted(r["text"] for r in again.chunks.collect())
    assert again.rebuilt and texts == ["added", "other words here"] + [f"text number {n}" for n in range(2, 6)]
    built = spark.read.parquet(f"{home}/store/chunks").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in built} == {0: 6, 1: 2}
    assert run(force=True).rebuilt and sorted(r["text"] for r in ChunkStore(spark, f"{home}/store").chunks().collect()) == texts


def test_a_failed_build_is_made_up_for(spark, tmp_path):
    """A path built by a batch that was never named, and gone since, does not come back."""
    docs, home = tmp_path / "docs", str(tmp_path / "index")
    docs.mkdir()
    for n in range(3):
        (docs / f"{n}.txt").write_text(f"text {n}")
    files = lambda: D.list_files(spark, str(docs))
    run = lambda: P.open_or_refresh(spark, files(), home, HashEncoder(16), lists=1, pq_m=None)
    run()
    (docs / "late.txt").write_text("late")
    store = ChunkStore(spark, f"{home}/store")
    late = files().where("path like '%late.txt'")
    runs.refresh_batch(late, store.last_batch() + 1, store, HashEncoder(16))
    (docs / "late.txt").unlink()
    (docs / "3.txt").write_text("text 3")
    assert sorted(r["text"] for r in run().chunks.collect()) == [f"text {n}" for n in range(4)]


def test_document_stream(spark, tmp_path):
    docs, home = tmp_path / "docs", str(tmp_path / "store")
    docs.mkdir()
    (docs / "a.txt").write_text("alpha")
    (docs / "b.md").write_text("no")
    poll = lambda: runs.poll_documents(spark, str(docs), home, HashEncoder(16))
    assert poll() == 1
    (docs / "_c.txt").write_text("gamma")
    (docs / ".d.txt").write_text("delta")
    assert poll() == 2 and poll() == 0
    store = ChunkStore(spark, home)
    assert sorted(r["text"] for r in store.chunks().collect()) == ["alpha", "delta", "gamma"]
    (docs / "a.txt").write_text("alpha, edited")
    (docs / ".d.txt").unlink()
    assert poll() == 2
    assert sorted(r["text"] for r in store.chunks().collect()) == ["alpha, edited", "gamma"]
    batch = store.last_batch() + 1
    for _ in range(2):  # the same batch again changes nothing
        runs.refresh_batch(D.list_files(spark, str(docs)).where("path like '%c.txt'"), batch, store, HashEncoder(16))
        assert store.chunks().count() == 2


def test_documents_are_polled_by_the_clock(spark, tmp_path):
    docs, home = tmp_path / "docs", str(tmp_path / "store")
    docs.mkdir()
    (docs / "_a.txt").write_text("alpha")
    q = runs.document_stream(spark, str(docs), home, HashEncoder(16), interval="1 second")
    try:
        end = time.time() + 60
        while time.time() < end and ChunkStore(spark, home).chunks().count() < 1:
            time.sleep(1)
    finally:
        q.stop()
    assert [r["text"] for r in ChunkStore(spark, home).chunks().collect()] == ["alpha"]


def test_hidden_names_are_files_too(spark, tmp_path):
    for name in ("_a.txt", ".b.txt", "c.txt", "_d.md"):
        (tmp_path / name).write_text(name)
    (tmp_path / "_sub").mkdir()
    (tmp_path / "_sub" / "e.txt").write_text("no")
    files = D.list_files(spark, str(tmp_path))
    assert {(r["path"].rpartition("/")[2], bytes(r["content"]).decode(), r["length"]) for r in files.collect()} == {
        (n, n, len(n)) for n in ("_a.txt", ".b.txt", "c.txt")
    }
    sizes = [f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()]
    assert W.folder_bytes(spark, str(tmp_path)).first()["bytes"] >= sum(sizes)


def test_prompts(spark):
    m = spark.createDataFrame([("s", 0, "user", "u1"), ("s", 1, "assistant", "a1"), ("s", 2, "user", "u2")], "session_id string, turn int, role string, text string")
    got = {r["turn"]: r["prompt"] for r in conversation_prompts(m).collect()}
    assert got == {0: "u1", 2: "User: u1\nAssistant: a1\nUser: u2"}
    last = {r["turn"]: r["prompt"] for r in conversation_prompts(m, max_turns=1).collect()}
    assert last == {0: "u1", 2: "Assistant: a1\nUser: u2"}


def test_prompts_across_blocks(spark):
    n = 600
    m = spark.createDataFrame([("s", i, "user", f"m{i}") for i in range(n)], "session_id string, turn int, role string, text string")
    got = {r["turn"]: r["prompt"] for r in conversation_prompts(m).collect()}
    lines = [f"User: m{i}" for i in range(n)]
    assert all(got[i] == ("m0" if i == 0 else "\n".join(lines[: i + 1])) for i in range(n))


def plain_pieces(tokens, chunk_chars=400, soft_chars=24):
    buffer, at, out = "", 0, []
    for t in tokens:
        pieces, buffer = feed(buffer, t, chunk_chars, soft_chars)
        for p in pieces:
            out.append((at, p))
            at += len(p)
    return out + ([(at, buffer)] if buffer else [])


def test_feed_rules():
    assert feed("", "Hi. Yo! x", 400, 24) == (["Hi. ", "Yo! "], "x")
    assert feed("", "a! b. c", 400, 24) == (["a! b. "], "c")
    assert feed("", "x" * 130, 64, 24) == (["x" * 64, "x" * 64], "xx")
    assert feed("", "short\nline", 400, 24) == ([], "short\nline")
    assert feed("", "a long enough line of text\nrest", 400, 24) == (["a long enough line of text\n"], "rest")
    assert feed("a long enough sentence", " here.", 400, 24) == (["a long enough sentence here."], "")


@pytest.mark.parametrize("block, chunk_chars, soft_chars", [(4, 64, 8), (16, 100, 24), (4096, 400, 24)])
def test_segments_of_long_streams(spark, block, chunk_chars, soft_chars):
    import random

    rnd = random.Random(block)
    streams = {}
    for s in range(12):
        word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9)))
        streams[s] = [
            rnd.choice([" ", "", "  ", "\n", " ", "\x0b"]) + word() + rnd.choice(["", ".", "", "!", "..", ". ", "", "\n", "?\t"])
            for _ in range(rnd.choice([5, 300, 900]))
        ]
    rows = [(s, i, t) for s, tokens in streams.items() for i, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "stream_id int, seq bigint, token string")
    got = segment(df, chunk_chars=chunk_chars, soft_chars=soft_chars, block_tokens=block).collect()
    want = {(s, at, p) for s, tokens in streams.items() for at, p in plain_pieces(tokens, chunk_chars, soft_chars)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_tokens_travel_in_packs(spark):
    """Tokens that follow each other are one row of what is shuffled; places out of order and repeated ones give the same pieces."""
    from inkfield.operators.segments import _packed

    text = "".join(f"word{i % 7}{'. ' if i % 9 == 0 else ' '}é" for i in range(3000))
    tokens = tokens_of(spark.createDataFrame([(s, text) for s in range(4)], "id int, text string").coalesce(1), "id")
    assert _packed(tokens, 1000).count() < tokens.count() / 200
    mixed = tokens.repartition(7, "token").orderBy(F.xxhash64("token", "seq"))
    want = {s: plain_pieces([r["token"] for r in tokens.where(F.col("stream_id") == s).orderBy("seq").collect()], 64, 24) for s in range(4)}
    got = segment(mixed, chunk_chars=64, soft_chars=24).collect()
    assert sorted(map(tuple, got)) == sorted((s, *p) for s, pieces in want.items() for p in pieces)
    twice = [(1, i, t) for i, t in enumerate(["a. ", "b", "c! ", "d"]) for _ in (0, 1)] + [(None, 0, "x. "), (1, None, "n"), (2, 5, None), (2, 6, "")]
    got = segment(spark.createDataFrame(twice, "stream_id int, seq bigint, token string").repartition(5)).collect()
    assert {s: "".join(r["piece"] for r in sorted(got, key=lambda r: r["start"]) if r["stream_id"] == s) for s in (1, None, 2)} == {
        1: "na. a. bbc! c! dd", None: "x. ", 2: "",
    }


def test_tokens_give_the_text_back(spark):
    texts = ["  a b\n\nc  ", "x", " ", "é. ü!\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    joined = tokens_of(df, "id").groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda e: e["token"]), "").alias("t"))
    assert {r["stream_id"]: r["t"] for r in joined.collect()} == dict(enumerate(texts))


def arriving(spark, folder, parts, schema):
    """Each part is a file of its own, read in its own micro-batch."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_session_log_over_batches(spark, tmp_path):
    schema = "session_id string, turn bigint, role string, text string, reset boolean"
    parts = [
        [("a", 2, "assistant", " hi ", None), ("a", 0, "system", "s", None), ("b", 0, "user", "x", None)],
        [("a", 1, "user", "u", None), ("a", 3, "assistant", "  ", None)],
        [("a", 4, "user", "new", True), ("b", 1, "user", "y", False), ("a", 1, "user", "u", None)],
    ]
    stream = arriving(spark, tmp_path / "in", parts, schema)
    log = runs.run_to_table(session_log(stream), "log", str(tmp_path / "log"))
    assert {tuple(r) for r in log.collect()} == {
        ("a", 0, 0, "user", "u", 0), ("a", 0, 1, "assistant", "hi", 0), ("a", 1, 0, "user", "new", 0),
        ("b", 0, 0, "user", "x", 0), ("b", 0, 1, "user", "y", 0),
    }


def test_gaps_are_passed_over_when_patience_ends(spark, tmp_path):
    schema = "session_id string, turn bigint, role string, text string, at timestamp"
    t = lambda minute: dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minute)
    user = lambda s, turn, minute: (s, turn, "user", f"{s}{turn}", t(minute))
    parts = [
        [user("a", 1, 0), user("a", 3, 1), user("b", 0, 1), user("b", 2, 6), user("c", 1, 7)],
        [user("b", 1, 9), user("d", 0, 9), user("c", 2, 9)],  # b's gap closes in time
        [("z", None, None, None, t(14))], [("z", None, None, None, t(14))],  # a's time is over, c's is not
        [user("a", 7, 14), user("a", 0, 14), user("c", 0, 14)],  # a's first turn comes too late, c's does not
        [("z", None, None, None, t(60)), (None, 0, "user", "x", t(60))],
    ]
    stream = arriving(spark, tmp_path / "in", parts, schema)
    log = runs.run_to_table(session_log(stream, event_time="at", patience="10 minutes", late="1 second"), "log", str(tmp_path / "log"))
    assert sorted((r["session_id"], r["seq"], r["text"], r["missing"]) for r in log.collect()) == [
        ("a", 0, "a1", 1), ("a", 1, "a3", 1), ("a", 2, "a7", 3), ("b", 0, "b0", 0), ("b", 1, "b1", 0), ("b", 2, "b2", 0),
        ("c", 0, "c0", 0), ("c", 1, "c1", 0), ("c", 2, "c2", 0), ("d", 0, "d0", 0),
    ]


def test_quiet_keys_are_forgotten(spark, tmp_path):
    schema = "stream_id string, seq bigint, token string, end boolean, at timestamp"
    t = lambda minute: dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minute)
    parts = [
        [("s", 0, "One ", None, t(0)), ("s", 2, "three", None, t(1)), ("r", 0, "rest", None, t(1))],
        [("z", None, None, None, t(100))],
        [("z", None, None, None, t(200))],
        [("s", 0, "Again.", True, t(200)), ("z", None, None, None, t(300))],
    ]
    stream = arriving(spark, tmp_path / "in", parts, schema)
    out = segment_stream(stream, event_time="at", patience="10 minutes", forget="30 minutes", late="1 minute")
    got = runs.run_to_table(out, "pieces", str(tmp_path / "out")).collect()
    assert sorted(tuple(r) for r in got) == [("r", 0, "rest", 0), ("s", 0, "Again.", 0), ("s", 0, "One three", 1)]


def test_segments_over_batches(spark, tmp_path):
    tokens = [w + " " for w in "One two. Three is a longer sentence now. Four, and so on! Five".split()]
    rows = [("s", i, t, False) for i, t in enumerate(tokens)] + [("s", len(tokens), "", True)]
    stream = arriving(spark, tmp_path / "in", [rows[4:], rows[:2], rows[2:4]], "stream_id string, seq bigint, token string, end boolean")
    out = runs.run_to_table(segment_stream(stream), "pieces", str(tmp_path / "out"))
    assert sorted((r["start"], r["piece"]) for r in out.collect()) == plain_pieces(tokens)


def test_stream_and_table_agree(spark, sf):
    from inkfield.plans.registry import QUERIES

    a = {tuple(r) for r in QUERIES["token_segments"](spark, sf).collect()}
    b = {tuple(r) for r in QUERIES["stream_segments"](spark, sf).collect()}
    assert a == b and a


def test_hidden_names_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    names = ["_a.txt", ".b.txt", "c.txt", "d e%20.txt"]
    for name in names:
        (tmp_path / name).write_text(name)

    def refused(*_):
        raise AssertionError("named one by one on the driver")

    monkeypatch.setattr(D, "_hidden", refused)
    rows = D.list_files(spark, str(tmp_path)).withColumn("ms", F.unix_millis("modificationTime")).collect()
    assert sorted((r["path"].rpartition("/")[2], bytes(r["content"]).decode(), r["length"]) for r in rows) == sorted(
        (n, n, len(n)) for n in names
    )
    assert {r["ms"] for r in rows} == {(tmp_path / n).stat().st_mtime_ns // 1_000_000 for n in names}


def test_only_chosen_files_are_read(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(name)
    files = D.list_files(spark, str(tmp_path))
    (tmp_path / "b.txt").unlink()
    assert [r["text"] for r in D.load_documents(files.where("path like '%a.txt'")).collect()] == ["a.txt"]
