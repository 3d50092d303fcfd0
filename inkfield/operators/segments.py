"""Token segmentation over a table of tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield import config
from inkfield.functions.segment import Pieces, limits
from inkfield.session import materialize

# Tokens per block in which a safe cutting point is looked for; shorter streams are not cut.
BLOCK_TOKENS = 65536


def tokens_of(df: DataFrame, stream_id: Column | str, text: str = "text") -> DataFrame:
    """Texts as token rows: words with the white space before them; together they give the text again."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"(?s)\s*\S+|\s+\z"), F.lit(0))
    sid = F.col(stream_id) if isinstance(stream_id, str) else stream_id
    return df.select(sid.alias("stream_id"), F.posexplode(parts).alias("seq", "token")).withColumn(
        "seq", F.col("seq").cast("bigint")
    )


def _runs(tokens: DataFrame, chunk_chars: int, soft_chars: int, block_tokens: int) -> DataFrame:
    """(stream_id, run, seq, start, token): streams cut into runs that can be segmented on their own.

    A run may start behind a token after which the buffer is empty whatever came before. Within a block of
    tokens, the buffer is known to reach back at most to the last separator (``low``), and at least to the
    last token that could have caused a cut (``high``). So it is empty after a token that ends with a
    separator, and after one that closes a sentence that is long enough to be delivered, as long as no
    full piece can have come between. The tokens before a block's first such point belong to the run
    before. ``start`` is the token's character offset in its stream.
    """
    separator = "|".join(re.escape(s) for s in config.SEGMENT_SEPARATORS)
    t = tokens.withColumn("block", F.floor(F.col("seq") / block_tokens))
    by_seq = Window.partitionBy("stream_id", "block").orderBy("seq")
    upto = by_seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = by_seq.rowsBetween(Window.unboundedPreceding, -1)
    token = F.col("token")
    # A separator may begin in the token before.
    before = F.coalesce(F.right(F.lag("token").over(by_seq), F.lit(1)), F.lit(""))
    t = t.withColumn("before", before).withColumn("end", F.sum(F.length("token")).over(upto))
    inside = F.length(F.regexp_extract(F.concat("before", "token"), rf"(?s)\A.*(?:{separator})", 0)) - F.length("before")
    low = F.max(F.when(inside > 0, F.col("end") - F.length("token") + inside - 1))
    high = F.max(F.when(token.rlike(r"[.!?\n]"), F.col("end")))
    # Other white space after a full stop can hold a sentence back.
    odd = F.max(F.when(token.rlike(r"(?U)[\s\x1c-\x1f&&[^ \n\t]]"), F.col("end")))
    t = t.select(
        "stream_id", "block", "seq", "token", "end",
        low.over(earlier).alias("low"), high.over(earlier).alias("high"), odd.over(upto).alias("odd"),
    )
    closes = (
        token.rlike(r"\A[^.!?\n]*[.!?]+\z")
        & (F.col("end") - F.col("high") > soft_chars)
        & (F.col("odd").isNull() | (F.col("odd") <= F.col("low")))
    )
    safe = (token.rlike(rf"(?:{separator})\z") | closes) & (F.col("end") - F.col("low") < chunk_chars)
    blocks = t.groupBy("stream_id", "block").agg(
        F.min(F.when(safe, F.col("seq"))).alias("cut"), F.max("end").alias("chars")
    )
    by_block = Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "stream_id",
        "block",
        "cut",
        F.coalesce(F.sum("chars").over(by_block), F.lit(0)).alias("offset"),
        F.coalesce(F.max(F.when(F.col("cut").isNotNull(), F.col("block"))).over(by_block), F.lit(-1)).alias("run_before"),
    )
    t = t.select("stream_id", "block", "seq", "token", "end").join(blocks, ["stream_id", "block"])
    run = F.when(F.col("seq") > F.col("cut"), F.col("block")).otherwise(F.col("run_before"))
    start = F.col("offset") + F.col("end") - F.length("token")
    return t.select("stream_id", run.alias("run"), "seq", start.alias("start"), "token")


def _packed(rows: DataFrame, block_tokens: int | None = None) -> DataFrame:
    """Rows (stream_id, seq, token, run, start) with the tokens that follow each other as one row.

    ``seq`` and ``start`` are those of the first token, ``text`` is all of them, and ``sizes`` their lengths as int32. What
    is shuffled and handed on is a row for some thousands of tokens and not one for each. Tokens in another order make more, shorter rows.
    Without run and start, runs are blocks of ``block_tokens`` places.
    """
    kinds = [("run", T.LongType()), ("start", T.LongType()), ("text", T.StringType()), ("sizes", T.BinaryType())]
    out = T.StructType([rows.schema["stream_id"], rows.schema["seq"], *(T.StructField(k, t) for k, t in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            no_place = b.column(1).is_null().to_numpy(zero_copy_only=False)
            seq = b.column(1).fill_null(0).to_numpy()
            runs = seq // block_tokens if block_tokens else b.column(3).to_numpy()
            stream = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            if (np.diff(seq)[np.diff(stream) == 0] != 1).any() or (np.diff(stream) < 0).any():
                order = np.lexsort((seq, ~no_place, runs, stream))
                b, no_place, seq, runs, stream = b.take(pa.array(order)), *(x[order] for x in (no_place, seq, runs, stream))
            new = np.r_[True, (np.diff(stream) != 0) | (np.diff(runs) != 0) | (np.diff(seq) != 1) | no_place[1:] | no_place[:-1]]
            first = np.flatnonzero(new)
            token = b.column(2).cast(pa.string())
            sizes = pc.utf8_length(token).to_numpy().astype(np.int32)
            # The bytes of neighbouring tokens lie next to each other.
            _, at, data = token.buffers()
            at = np.frombuffer(at, np.int32)[token.offset :][: n + 1]
            text = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.r_[at[first], at[-1]].astype(np.int32)), data)
            bounds = (4 * np.r_[first, n]).astype(np.int32)
            taken = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(taken), b.column(1).take(taken), pa.array(runs[first], pa.int64(), mask=no_place[first]),
                    b.column(4).take(taken) if not block_tokens else pa.array(np.zeros(len(first), np.int64)),
                    text, pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(sizes)]),
                ],
                names=["stream_id", "seq", "run", "start", "text", "sizes"],
            )

    return rows.mapInArrow(run, out)


def _unpacked(packs: DataFrame) -> DataFrame:
    """(stream_id, seq, token) of packed rows."""
    token = T.StructField("token", T.StringType())
    out = T.StructType([packs.schema["stream_id"], packs.schema["seq"], token])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, sizes = b.column(2)[i].as_py(), np.frombuffer(b.column(3)[i].as_buffer(), np.int32)
                ends = np.cumsum(sizes).tolist()
                tokens = pa.array([text[x:y] for x, y in zip([0, *ends], ends)], pa.string())
                seq = b.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.full(len(sizes), i))),
                        pa.nulls(len(sizes), pa.int64()) if seq is None else pa.array(seq + np.arange(len(sizes))),
                        tokens,
                    ],
                    names=["stream_id", "seq", "token"],
                )

    return packs.select("stream_id", "seq", "text", "sizes").mapInArrow(run, out)


def segment(
    tokens: DataFrame,
    *,
    chunk_chars: int = config.SEGMENT_CHARS,
    soft_chars: int = config.SEGMENT_SOFT_CHARS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of each stream: (stream_id, start, piece), where ``start`` is a character offset.

    The tokens are read once and written with those that follow each other in one row. Each run of them is then read once in
    order with only the buffer and the rows that overlap in memory; long streams are cut into runs where the state of the
    buffer is known.
    """
    chunk_chars, soft_chars = limits(chunk_chars, soft_chars)
    none = F.lit(0).cast("bigint")
    tokens = tokens.select("stream_id", F.col("seq").cast("bigint").alias("seq"), "token").where(F.col("token") != "")
    packs = materialize(_packed(tokens, block_tokens), "tokens")
    # Written, so that the planner knows that they are few.
    long_ids = materialize(packs.where(F.col("run") >= 1).select("stream_id").distinct(), "long-streams")
    short = packs.join(long_ids, "stream_id", "left_anti").select(
        "stream_id", none.alias("run"), "seq", "start", "text", "sizes"
    )
    rows = short
    if not long_ids.isEmpty():
        of_long = _unpacked(packs.join(long_ids, "stream_id", "left_semi"))
        runs = _runs(of_long, chunk_chars, soft_chars, block_tokens)
        rows = short.unionByName(_packed(runs.select("stream_id", "seq", "token", "run", "start")))
    schema = T.StructType(
        [
            rows.schema["stream_id"],
            T.StructField("start", T.LongType()),
            T.StructField("piece", T.StringType()),
        ]
    )
    rows = rows.select("stream_id", "run", "seq", "start", "text", "sizes")
    laid = rows.repartition("stream_id", "run").sortWithinPartitions("stream_id", "run", "seq")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, arrow_id, pieces = None, None, None

        def rows_of(out):
            columns = list(zip(*out)) or [(), (), ()]
            types = [arrow_id, pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["stream_id", "start", "piece"]
            )

        for b in batches:
            arrow_id = b.schema.field(0).type
            out = []
            for sid, run, seq, start, text, sizes in zip(*(c.to_pylist() for c in b.columns)):
                if pieces is None or key != (sid, run):
                    if pieces:
                        out += [(key[0], *p) for p in pieces.last()]
                    key, pieces = (sid, run), Pieces(start, chunk_chars, soft_chars)
                out += [(sid, *p) for p in pieces.take(seq, text, np.frombuffer(sizes, np.int32))]
            yield rows_of(out)
        if pieces:
            yield rows_of([(key[0], *p) for p in pieces.last()])

    return laid.mapInArrow(cut, schema)
