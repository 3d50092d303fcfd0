"""Document files: listing, text decoding, DOCX and PDF text jobs, extraction cache."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield import config
from inkfield.functions.batches import PIECE_BYTES, pieces
from inkfield.session import materialize, spread

# Pages of a PDF file as texts: (bytes, page limit or None) -> list.
PageExtractor = Callable[[bytes, int | None], list]

_SUFFIX = r"(?i)\.([A-Za-z0-9]+)\z"


def supported(listing: DataFrame, suffixes: tuple[str, ...] = config.DOCUMENT_SUFFIXES) -> DataFrame:
    """Files with a supported suffix, whatever its case, with their ``type``."""
    typed = listing.withColumn("type", F.lower(F.regexp_extract("path", _SUFFIX, 1)))
    return typed.where(F.col("type").isin(*suffixes))


def _hidden(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose names Spark's readers pass over, those that begin with ``_`` or ``.``, with their bytes.

    The file system picks them by name, so of all files only these, which are few, are named on the driver. Their bytes are
    read in the tasks, by path.
    """
    from pyspark.sql import Row

    path = spark._jvm.org.apache.hadoop.fs.Path
    place = path(folder)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path(place, "{_,.}*"))
    rows = [
        Row(path=s.getPath().toString(), millis=s.getModificationTime(), length=s.getLen()) for s in found or [] if s.isFile()
    ]
    listed = spark.createDataFrame(rows, "path string, millis bigint, length bigint")
    listed = listed.select("path", F.timestamp_millis("millis").alias("modificationTime"), "length")
    return listed.withColumn("content", _bytes_of("path"))


@F.arrow_udf(T.BinaryType())
def _bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    from pyarrow import fs

    systems: dict[str, tuple] = {}  # of folders
    for a in batches:
        out, size = [], 0
        for path in a.to_pylist():
            folder, _, name = path.rpartition("/")
            if folder not in systems:
                systems = {folder: fs.FileSystem.from_uri(folder)}
            system, place = systems[folder]
            with system.open_input_stream(f"{place}/{name}") as f:
                out.append(f.read())
            size += len(out[-1])
            if size > PIECE_BYTES:
                yield pa.array(out, pa.binary())
                out, size = [], 0
        if out:
            yield pa.array(out, pa.binary())


def _arrow_folder(spark: SparkSession, folder: str) -> str | None:
    """The full address of a folder that Arrow's file systems find in the same place, else None."""
    from pyarrow import fs

    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place) or not system.getFileStatus(place).isDirectory():
        return None
    full = system.getFileStatus(place).getPath()
    try:
        found = fs.FileSystem.from_uri(full.toString())[1]
    except (pa.ArrowException, OSError, ImportError):
        return None
    return full.toString().rstrip("/") if found == full.toUri().getPath() else None


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length) of the files of a folder that Arrow can read, written by the task that lists it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            if not b.num_rows:
                continue
            system, place = fs.FileSystem.from_uri(folder)
            found = system.get_file_info(fs.FileSelector(place))
            for at in range(0, len(found), 10_000):
                files = [x for x in found[at : at + 10_000] if x.type == fs.FileType.File]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{folder}/{x.base_name}" for x in files], pa.string()),
                        pa.array([x.mtime_ns // 1_000_000 for x in files], pa.int64()),
                        pa.array([x.size for x in files], pa.int64()),
                    ],
                    names=["path", "millis", "length"],
                )

    listed = spark.range(1, numPartitions=1).mapInArrow(run, "path string, millis bigint, length bigint")
    return materialize(listed.select("path", F.timestamp_millis("millis").alias("modificationTime"), "length"), "files")


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = config.DOCUMENT_SUFFIXES) -> DataFrame:
    """Supported files directly in a folder, whatever their names: path, modificationTime, length, content, type.

    Columns that are not used are not read: a state needs no bytes. A missing folder is an error at once. A folder that
    Arrow's file systems can read is listed by one of them, once, and a file's bytes are read by path where they are used,
    after filters and joins. Other folders are left to Spark's reader.
    """
    full = _arrow_folder(spark, folder)
    if full is None:
        seen = spark.read.format("binaryFile").load(folder)
        return supported(seen.unionByName(_hidden(spark, folder)), suffixes)
    listed = spread(supported(_listing(spark, full), suffixes))
    return listed.select("path", "modificationTime", "length", _bytes_of("path").alias("content"), "type")


def _decode(raw: bytes) -> str:
    for name in config.TEXT_ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


@F.arrow_udf(T.StringType())
def _decode_other(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        for a in pieces(b):
            yield pa.array([None if raw is None else _decode(raw) for raw in a.to_pylist()], pa.string())


def decode_text(content: str = "content") -> Column:
    """Bytes as text: UTF-8 where valid, else the next encoding that fits; line ends become ``\\n``.

    Valid UTF-8 stays in the JVM; only other bytes are handed to Python.
    """
    utf8 = F.col(content).cast("string")
    valid = F.is_valid_utf8(utf8)
    other = _decode_other(F.when(~valid, F.col(content)))
    return F.regexp_replace(F.when(valid, utf8).otherwise(other), r"\r\n?", "\n")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(raw: bytes) -> str:
    """Text of the body's own paragraphs, one per line; tables and headers are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = []
    for p in body.findall(f"{_W}p"):
        text = []
        for run in [n for n in p if n.tag in (f"{_W}r", f"{_W}hyperlink")]:
            for n in run.iter():
                if n.tag == f"{_W}t":
                    text.append(n.text or "")
                elif n.tag == f"{_W}tab":
                    text.append("\t")
                elif n.tag in (f"{_W}br", f"{_W}cr"):
                    text.append("\n")
        lines.append("".join(text))
    return "\n".join(lines)


def _per_file(df: DataFrame, extract: Callable[[bytes], str]) -> DataFrame:
    """Adds ``text``; a file that fails stops the load and names itself."""
    schema = T.StructType([f for f in df.schema.fields if f.name != "content"] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in pieces(batch)):
            texts = []
            for path, raw in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    texts.append(extract(bytes(raw.as_py())))
                except Exception as e:
                    raise RuntimeError(f"Failed to load {path}: {e}") from e
            columns = [b.column(c) for c in schema.names[:-1]] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def docx_text(files: DataFrame) -> DataFrame:
    return _per_file(files, docx_paragraphs)


def _no_pages(raw: bytes, limit: int | None) -> list:
    raise ValueError("PDF files need a page extractor")


def pdf_text(files: DataFrame, pages: PageExtractor, max_pages: int = 0) -> DataFrame:
    """Page texts joined by line ends; ``max_pages`` of zero or less means all."""
    limit = max_pages if max_pages > 0 else None
    return _per_file(files, lambda raw: "\n".join(p or "" for p in list(pages(raw, limit))[:limit]))


def extraction_key(max_pages: int, extractor: str) -> Column:
    """Key of an extraction: a file's place, size and time, and how it is read."""
    nanos = F.unix_micros(F.col("modificationTime")) * 1000
    parts = [F.col("path"), F.col("length"), nanos, F.lit(max_pages), F.lit(extractor)]
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def cached_pdf_text(
    files: DataFrame, cache_path: str, pages: PageExtractor, max_pages: int = 0, extractor: str = "auto"
) -> DataFrame:
    """PDF texts through a cache table keyed by ``extraction_key``; only unknown keys are extracted.

    Fresh texts are appended to the cache first and all texts are then read from it.
    """
    spark = files.sparkSession
    keyed = files.withColumn("key", extraction_key(max_pages, extractor))
    try:
        known = spark.read.schema("key string, text string").parquet(cache_path).select("key")
        missing = keyed.join(known, "key", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = keyed
    fresh = pdf_text(missing.select("path", "key", "content"), pages, max_pages)
    fresh.select("key", "text").write.mode("append").parquet(cache_path)
    # Two loads at once may have stored a key twice, with the same text.
    cache = spark.read.schema("key string, text string").parquet(cache_path).groupBy("key").agg(F.min("text").alias("text"))
    return keyed.drop("content").join(cache, "key").drop("key")


def load_documents(
    files: DataFrame,
    pages: PageExtractor | None = None,
    *,
    max_pages: int = 0,
    extractor: str = "auto",
    cache_path: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Files of all types as documents: (source, type, text); sorted by source when asked, which shuffles.

    ``pages`` reads the pages of PDF files; without it a PDF file stops the load.
    """
    pages = pages or _no_pages
    named = files.select("path", "modificationTime", "length", "content", "type")
    txt = named.where("type = 'txt'").select("path", "type", decode_text().alias("text"))
    docx = docx_text(named.where("type = 'docx'").select("path", "type", "content"))
    pdfs = named.where("type = 'pdf'")
    if cache_path:
        pdf = cached_pdf_text(pdfs, cache_path, pages, max_pages, extractor).select("path", "type", "text")
    else:
        pdf = pdf_text(pdfs.select("path", "type", "content"), pages, max_pages)
    all_ = txt.unionByName(docx).unionByName(pdf)
    docs = all_.select(F.col("path").alias("source"), "type", "text")
    return docs.orderBy("source") if ordered else docs


def read_documents(spark: SparkSession, folder: str, pages: PageExtractor | None = None, **options) -> DataFrame:
    """All supported documents of a folder in order of their paths; none at all is an error."""
    files = list_files(spark, folder)
    if files.select("path").isEmpty():
        known = ", ".join(f".{s}" for s in sorted(config.DOCUMENT_SUFFIXES))
        raise ValueError(f"No supported files ({known}) found in {folder}")
    return load_documents(files, pages, **{"ordered": True, **options})
