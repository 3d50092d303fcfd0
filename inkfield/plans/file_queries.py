"""Named queries over files, JSON texts and streams, all made by Spark from the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from inkfield.functions.batches import pieces
from inkfield.operators.conversation import conversation_prompts
from inkfield.plans import index as P
from inkfield.plans.registry import query, table, wide
from inkfield.plans.store import ChunkStore
from inkfield.plans.text_queries import PROMPT_SQL, message_tokens
from inkfield.plans.vector_queries import ENCODER
from inkfield.session import scratch_path
from inkfield.sources import documents as D
from inkfield.sources import records as SR
from inkfield.streaming import runs
from inkfield.streaming.keyed import segment_stream, session_log

_PATH_SQL = "'file:/docs/' || source || '/' || doc_id || case (doc_id % 4)::integer when 0 then '.txt' when 1 then '.PDF' when 2 then '.docx' else '.md' end"


def line_pages(raw: bytes, limit: int | None) -> list[str]:
    """Page extractor for text bytes: a line is a page."""
    return raw.decode().split("\n")[:limit]


def _docx(text: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


def _with_content(df):
    """Adds the file's bytes: a DOCX archive for that type, UTF-8 text for the others."""
    schema = df.drop("text").schema.add("content", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in pieces(batch)):
            texts = zip(b.column("path").to_pylist(), b.column("text").to_pylist())
            made = [_docx(t) if p.endswith(".docx") else t.encode() for p, t in texts]
            columns = [b.column(c) for c in schema.names[:-1]] + [pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def document_files(spark, sf_dir, suffix: str | None = None):
    """The documents as a file listing: of one suffix, or of four, three of them supported."""
    d = wide(spark, sf_dir, "documents", "doc_id", "source", "text")
    mixed = F.element_at(F.array(*[F.lit(s) for s in (".txt", ".PDF", ".docx", ".md")]), (F.col("doc_id") % 4 + 1).cast("int"))
    ending = F.lit(suffix) if suffix else mixed
    path = F.concat(F.lit("file:/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ending)
    return d.select(
        path.alias("path"), F.timestamp_seconds("doc_id").alias("modificationTime"),
        F.octet_length("text").cast("bigint").alias("length"), "text",
    )


@query(f"""
select {_PATH_SQL} as path, case (doc_id % 4)::integer when 0 then 'txt' when 1 then 'pdf' else 'docx' end as type,
  octet_length(encode(text))::bigint as length
from documents where doc_id % 4 < 3
""")
def document_scan(spark, sf_dir):
    return D.supported(document_files(spark, sf_dir).drop("text")).select("path", "type", "length").orderBy("path")


@query(f"""
select {_PATH_SQL} as source, case (doc_id % 4)::integer when 0 then 'txt' when 1 then 'pdf' else 'docx' end as type,
  md5(text) as text_md5
from documents where doc_id % 4 < 3
""")
def document_load(spark, sf_dir):
    files = D.supported(_with_content(document_files(spark, sf_dir)))
    docs = D.load_documents(files, line_pages, ordered=True)
    return docs.select("source", "type", F.md5("text").alias("text_md5"))


@query("""
select doc_id, md5(case (doc_id % 3)::integer when 2 then text || chr(129) else text end) as text_md5 from documents
""")
def decode_ladder(spark, sf_dir):
    """UTF-8, a one-byte encoding, and bytes that only the last encoding has; with other line ends."""
    d = wide(spark, sf_dir, "documents", "doc_id", "text")
    lines = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    narrow = F.encode(lines, "ISO-8859-1")
    content = (
        F.when(F.col("doc_id") % 3 == 0, F.encode(lines, "UTF-8"))
        .when(F.col("doc_id") % 3 == 1, narrow)
        .otherwise(F.concat(narrow, F.lit(b"\x81")))
    )
    return d.select("doc_id", content.alias("content")).select("doc_id", F.md5(D.decode_text()).alias("text_md5"))


@query("select 'file:/docs/' || source || '/' || doc_id || '.docx' as path, md5(text) as text_md5 from documents")
def docx_text(spark, sf_dir):
    files = _with_content(document_files(spark, sf_dir, ".docx"))
    return D.docx_text(files.select("path", "content")).select("path", F.md5("text").alias("text_md5"))


@query("""
select doc_id, md5(array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10))) as text_md5 from documents
""")
def pdf_text_job(spark, sf_dir):
    """At most three pages of each file."""
    d = wide(spark, sf_dir, "documents", "doc_id", "text")
    files = d.select("doc_id", F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return D.pdf_text(files, line_pages, 3).select("doc_id", F.md5("text").alias("text_md5"))


@query("select 'file:/docs/' || source || '/' || doc_id || '.PDF' as path, md5(text) as text_md5 from documents")
def pdf_text_cached(spark, sf_dir):
    """Some files first, then all of them through the same cache: known ones are not read again."""
    files = _with_content(document_files(spark, sf_dir, ".PDF"))
    cache = scratch_path(spark, "extractions")
    D.cached_pdf_text(files.where("length % 2 = 0"), cache, line_pages)
    return D.cached_pdf_text(files, cache, line_pages).select("path", F.md5("text").alias("text_md5"))


@query(f"""
select {_PATH_SQL} as path, sha256({_PATH_SQL} || '|' || octet_length(encode(text)) || '|' || (doc_id * 1000000000) || '|0|auto') as key
from documents
""")
def extraction_key(spark, sf_dir):
    return document_files(spark, sf_dir).select("path", D.extraction_key(0, "auto").alias("key"))


@query("""
select event_id, 0 as pos, event_id as id, event_type as kind from events
union all select event_id, 1, user_id, null from events where event_id % 2 = 0
""")
def json_records(spark, sf_dir):
    """Roots that are an object, an array of objects, or an empty array."""
    e = table(spark, sf_dir, "events")
    first = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    second = F.to_json(F.struct(F.col("user_id").alias("id")))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[ "), first, F.lit(","), second, F.lit("]"))).otherwise(first)
    empty = e.select("event_id", F.lit("[]").alias("j"))
    records = SR.parse_records(e.select("event_id", text.alias("j")).unionByName(empty), "j")
    return records.select(
        "event_id", F.col("_pos").alias("pos"), F.try_variant_get("v", "$.id", "bigint").alias("id"),
        F.try_variant_get("v", "$.kind", "string").alias("kind"),
    )


@query("""
select l_suppkey::integer as vendor, l_shipdate as pickup, round(l_quantity::float, 3)::double as distance, l_linestatus as flag,
  null::double as fee, count(*) as n
from lineitem group by all
""")
def typed_scan(spark, sf_dir):
    """Line items under the declared trip columns; what a file lacks is null."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("VendorID"), F.col("l_shipdate").alias("tpep_pickup_datetime"),
        F.col("l_quantity").alias("trip_distance"), F.col("l_linestatus").alias("store_and_fwd_flag"),
    )
    t = SR.as_declared(li)
    return t.groupBy(
        F.col("VendorID").alias("vendor"), F.col("tpep_pickup_datetime").cast("timestamp_ntz").alias("pickup"),
        F.round(F.col("trip_distance").cast("double"), 3).alias("distance"), F.col("store_and_fwd_flag").alias("flag"),
        F.col("Airport_fee").cast("double").alias("fee"),
    ).agg(F.count("*").alias("n"))


@query(f"""select {_PATH_SQL} as source from documents where doc_id % 4 < 3 and doc_id % 9 <> 0""")
def index_refresh(spark, sf_dir):
    """Build an index, change the files, refresh it: the sources that end up in its chunks."""
    files = D.supported(_with_content(document_files(spark, sf_dir).withColumn("n", F.octet_length("text"))))
    number = F.regexp_extract("path", r"(\d+)\.[^.]*$", 1).cast("bigint")
    before = files.where(number % 5 != 0).drop("n")
    edited = F.when(number % 7 == 0, F.col("length") + 1).otherwise(F.col("length"))
    after = files.where(number % 9 != 0).withColumn("length", edited).drop("n")
    folder = scratch_path(spark, "document-index")
    options = {"lists": 8, "pq_m": None, "pages": line_pages}
    P.open_or_refresh(spark, before, folder, ENCODER, **options)
    opened = P.open_or_refresh(spark, after, folder, ENCODER, **options)
    return opened.chunks.select("source").distinct()


def _write_files(files, folder):
    """Texts (name, text) as files of a folder."""
    from pyarrow import fs

    def run(batches):
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"]):
                system, place = fs.FileSystem.from_uri(f"{folder}/{name}")
                system.create_dir(place.rpartition("/")[0])
                with system.open_output_stream(place) as f:
                    f.write(text.encode())
            yield pdf[["name"]]

    return files.mapInPandas(run, "name string").count()


_NAME_SQL = "case (doc_id % 4)::integer when 0 then '_' || doc_id || '.txt' when 1 then '.' || doc_id || '.TXT' else doc_id || '.txt' end"


def _named(spark, sf_dir):
    """Documents under file names, half of them hidden from Spark's own readers."""
    i, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    name = F.when(kind == 0, F.concat(F.lit("_"), i, F.lit(".txt"))).when(kind == 1, F.concat(F.lit("."), i, F.lit(".TXT")))
    return wide(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", name.otherwise(F.concat(i, F.lit(".txt"))).alias("name"), "text")


def _folder(spark, name):
    """A scratch folder as a full address."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


_FILE = r"([^/]+)\z"


@query(f"select {_NAME_SQL} as name, 'txt' as type, octet_length(encode(text)) as length, md5(text) as text_md5 from documents")
def document_folder(spark, sf_dir):
    """Files of a folder with names of every kind: listed, sized and read."""
    folder = _folder(spark, "folder")
    _write_files(_named(spark, sf_dir).select("name", "text"), folder)
    files = D.list_files(spark, folder)
    texts = D.load_documents(files).select(F.col("source").alias("path"), F.md5("text").alias("text_md5"))
    return files.select("path", "type", "length").join(texts, "path").select(F.regexp_extract("path", _FILE, 1).alias("name"), "type", "length", "text_md5")


@query(f"""
select {_NAME_SQL} as name, case when doc_id % 5 = 0 or doc_id % 6 = 1 then 1 else 0 end::bigint as built from documents where doc_id % 7 <> 2
""")
def document_folder_refresh(spark, sf_dir):
    """A folder polled, changed and polled again: which poll built each file that is there. Some files were added, edited, removed."""
    from pyarrow import fs

    folder, store = _folder(spark, "folder"), _folder(spark, "folder-store")
    named = _named(spark, sf_dir)
    late, edited, gone = F.col("doc_id") % 5 == 0, F.col("doc_id") % 6 == 1, F.col("doc_id") % 7 == 2
    _write_files(named.where(~late).select("name", "text"), folder)
    runs.poll_documents(spark, folder, store, ENCODER)
    _write_files(named.where(late | edited).select("name", F.concat("text", F.lit(" again")).alias("text")), folder)

    def remove(batches):
        for pdf in batches:
            for name in pdf["name"]:
                system, place = fs.FileSystem.from_uri(f"{folder}/{name}")
                system.delete_file(place)
            yield pdf[["name"]]

    named.where(gone).select("name").mapInPandas(remove, "name string").count()
    runs.poll_documents(spark, folder, store, ENCODER)
    return ChunkStore(spark, store).live().select(F.regexp_extract("path", _FILE, 1).alias("name"), F.col("batch").alias("built"))


def _stream(df, name):
    """A table as a stream of files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxBytesPerTrigger", 1 << 30).parquet(path)


@query(PROMPT_SQL.format(turn=""))
def stream_sessions(spark, sf_dir):
    """Messages as a stream into the session log, prompts from the log."""
    messages = _stream(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id"), "messages")
    log = runs.run_to_table(session_log(messages), "session-log")
    p = conversation_prompts(log, turn="seq")
    return p.select("session_id", F.md5("prompt").alias("prompt_md5"))


@query("""
with m as (select conv_id as session_id, turn * 2 + conv_id % 3 as turn, role, text from conversations),
n as (select *, row_number() over (partition by session_id order by turn) as n from m),
s as (select session_id, turn, n, role, case when role = 'assistant' then trim(text) else text end as text from n
  where role in ('user', 'assistant') and trim(text) <> '')
select session_id, row_number() over w - 1 as seq, role, md5(text) as text_md5,
  (turn - coalesce(lag(turn) over w, -1)) - (n - coalesce(lag(n) over w, 0)) as missing
from s window w as (partition by session_id order by turn)
""")
def stream_sessions_gaps(spark, sf_dir):
    """Messages whose turns have gaps: all are kept in order, and the log says how many turns never came."""
    m = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    turn = F.col("turn") * 2 + F.col("session_id") % 3
    m = m.select("session_id", turn.alias("turn"), "role", "text", F.timestamp_seconds(60 * (turn + 1)).alias("at"))
    # A last row without a turn moves the time past all patience.
    last = m.agg(F.min("session_id").alias("session_id"), (F.max("at") + F.expr("interval 1 day")).alias("at"))
    end = last.select("session_id", *[F.lit(None).cast(m.schema[c].dataType).alias(c) for c in m.columns[1:-1]], "at")
    log = runs.run_to_table(session_log(_stream(m.unionByName(end), "messages-with-gaps"), event_time="at"), "session-log")
    return log.select("session_id", "seq", "role", F.md5("text").alias("text_md5"), "missing")


@query()
def stream_segments(spark, sf_dir):
    """Tokens as a stream into pieces; equal to ``token_segments``."""
    tokens = message_tokens(spark, sf_dir)
    ends = tokens.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq"))
    marked = tokens.withColumn("end", F.lit(False)).unionByName(
        ends.select("stream_id", "seq", F.lit("").alias("token"), F.lit(True).alias("end"))
    )
    return runs.run_to_table(segment_stream(_stream(marked, "tokens")), "segments").drop("missing")


@query(f"""select {_PATH_SQL} as source from documents where doc_id % 4 < 3""")
def stream_refresh(spark, sf_dir):
    """Files arriving as a stream into the chunk store: the sources of its chunks."""
    folder = scratch_path(spark, "stream-store")
    files = D.supported(_with_content(document_files(spark, sf_dir)))
    store = ChunkStore(spark, f"{folder}/store")
    q = (
        _stream(files, "arrived")
        .writeStream.foreachBatch(lambda df, n: runs.refresh_batch(df, n, store, ENCODER, line_pages))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return store.chunks().select("source").distinct()
