"""Keyed state on streams: session logs and token segmentation, in order of places that may have gaps.

Both number the rows of a key from 0 and take them in any order. What comes early waits in the key's map state, for
``patience`` of event time at most: a timer then lets it go on behind the gap, and the rows tell how many places were passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkfield import config
from inkfield.functions.segment import feed, limits
from inkfield.functions.text import is_blank, pystrip

PATIENCE = "10 minutes"  # of event time that a row waits for those before it
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(spark, interval: str) -> int:
    return int(spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {interval}"))).first()[0])


class InOrder(StatefulProcessor):
    """Rows of a key in order of their place; subclasses say what a row in its turn gives.

    ``numbers`` holds the next place, how many rows wait, the key's only timer, the time of its last row, and what a
    subclass needs; ``waiting`` holds early rows by place and is touched only where rows wait. Rows in order go through
    without it, an Arrow batch at a time.
    """

    OWN: str  # the subclass's columns of ``numbers``
    FRESH: tuple
    OUT: list[str]

    def __init__(self, place: str, columns: dict[str, str], patience: int, forget: int | None):
        self.place, self.columns, self.patience, self.forget = place, columns, patience, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", f"place bigint, waiting bigint, timer bigint, quiet bigint, {self.OWN}")
        self.waiting = handle.getMapState("waiting", "place bigint", "seen bigint, " + ", ".join(f"{k} {v}" for k, v in self.columns.items()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        place, held, timer, quiet, *own = self._numbers()
        early, known = held > 0, {}
        for pdf in rows:
            out: list[tuple] = []
            times = (pdf["event_time"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            for at, seen, *row in zip(pdf[self.place].tolist(), times, *(pdf[c].tolist() for c in self.columns)):
                quiet = max(quiet, seen)
                if at is not None and at >= place:  # null may come as NaN
                    known.setdefault(int(at), (seen, *row))
            while True:
                row = known.pop(place, None)
                if early and self.waiting.containsKey((place,)):
                    row = row or self.waiting.getValue((place,))
                    self.waiting.removeKey((place,))
                    held -= 1
                if row is None:
                    break
                own = self.take(key, own, row[1:], 0, out)
                place += 1
            yield from self._rows(out)
        for at, row in known.items():
            if not (early and self.waiting.containsKey((at,))):
                self.waiting.updateValue((at,), row)
                held += 1
        self._keep(place, held, timer, quiet, own)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        place, held, _, quiet, *own = self._numbers()
        out: list[tuple] = []
        rows = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator()) if held else []
        due = [at for at, row in rows if row[0] + self.patience <= now]
        for at, (_, *row) in rows:
            # Up to the last row whose time is over, and what follows it without a gap.
            if due and (at <= due[-1] or at == place):
                own = self.take(key, own, row, at - place, out)
                place, held = at + 1, held - 1
                self.waiting.removeKey((at,))
        if not held and self.forget is not None and quiet + self.forget <= now:
            self.last(key, own, out)
            self.numbers.clear()
        else:
            self._keep(place, held, 0, quiet, own)
        yield from self._rows(out)

    def _numbers(self) -> tuple:
        return tuple(self.numbers.get() or (0, 0, 0, 0, *self.FRESH))

    def _keep(self, place, held, timer, quiet, own) -> None:
        first = 0
        if held:
            first = min(v[0] for _, v in self.waiting.iterator()) + self.patience
        elif self.forget is not None:
            first = quiet + self.forget
        if timer != first:
            if timer:
                self.handle.deleteTimer(timer)
            if first:
                self.handle.registerTimer(first)
        self.numbers.update((place, held, first, quiet, *own))

    def _rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self.OUT)

    def take(self, key, own, row, missing: int, out: list[tuple]) -> list:
        raise NotImplementedError

    def last(self, key, own, out: list[tuple]) -> None:
        """What is left of a key that is forgotten."""

    def close(self) -> None:
        pass


class _Log(InOrder):
    OWN, FRESH = "epoch bigint, seq bigint, missing bigint", (0, 0, 0)
    OUT = ["session_id", "epoch", "seq", "role", "text", "missing"]

    def take(self, key, own, row, missing, out):
        (epoch, seq, passed), (role, text, again, keep) = own, row
        passed += missing
        if again:
            epoch, seq = epoch + 1, 0
        if keep:
            out.append((key[0], epoch, seq, role, text, passed))
            seq, passed = seq + 1, 0
        return [epoch, seq, passed]


class _Pieces(InOrder):
    OWN, FRESH = "at bigint, buffer string, missing bigint", (0, "", 0)
    OUT = ["stream_id", "start", "piece", "missing"]

    def __init__(self, chunk_chars: int, soft_chars: int, *rest):
        super().__init__(*rest)
        self.sizes = chunk_chars, soft_chars

    def take(self, key, own, row, missing, out):
        (at, buffer, passed), (token, end) = own, row
        passed += missing
        pieces, buffer = feed(buffer, token or "", *self.sizes)
        if end and buffer:
            pieces, buffer = [*pieces, buffer], ""
        for p in pieces:
            out.append((key[0], at, p, passed))
            at, passed = at + len(p), 0
        return [at, buffer, passed]

    def last(self, key, own, out):
        at, buffer, passed = own
        if buffer:
            out.append((key[0], at, buffer, passed))


def _run(rows: DataFrame, key: str, processor: InOrder, out: str) -> DataFrame:
    """State needs the RocksDB store; the setting is the session's and is made here if it has another."""
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL(out).fields])
    return rows.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def _timed(rows: DataFrame, event_time: str | None, late: str) -> DataFrame:
    """Rows with the watermarked column event_time: the caller's, else the time of their micro-batch, which is never late."""
    time = F.col(event_time) if event_time else F.current_timestamp()
    return rows.withColumn("event_time", time.cast("timestamp")).withWatermark("event_time", late if event_time else "0 seconds")


def session_log(
    messages: DataFrame, *, event_time: str | None = None, patience: str = PATIENCE, forget: str | None = None, late: str = PATIENCE
) -> DataFrame:
    """Stream of (session_id, turn, role, text[, reset]) to a log: (session_id, epoch, seq, role, text, missing).

    ``turn`` numbers a session's rows from 0. ``reset`` starts a new epoch, in which the history is empty;
    the message of such a row belongs to it. Assistant texts are stripped; blank messages and unknown
    roles take a turn but are not stored. A turn that never comes is passed over when the rows behind it have waited for
    ``patience`` (of the column ``event_time``, or of the clock); ``missing`` says how many were passed over since the row
    before. Turns that come after that, and repeated ones, are ignored. The state of a session is a few numbers and the
    rows that wait: its history is the log, read with ``conversation_prompts``. With ``forget`` it is dropped after that time
    without a row, and the session's next row is taken for the first of a new one. Rows without a turn only move the time on, rows
    without session_id are ignored, and rows more than ``late`` behind the latest event time are dropped, as streams do.
    """
    text = F.when(F.col("role") == "assistant", pystrip("text")).otherwise(F.col("text"))
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in messages.columns else F.lit(False)
    timed = _timed(messages, event_time, late)
    rows = timed.select("session_id", F.col("turn").cast("bigint").alias("turn"), "event_time", "role", text.alias("text"), reset.alias("reset"))
    rows = rows.withColumn("store", F.coalesce(F.col("role").isin(*config.ROLES) & ~is_blank("text"), F.lit(False)))
    spark = messages.sparkSession
    columns = {"role": "string", "text": "string", "reset": "boolean", "store": "boolean"}
    log = _Log("turn", columns, _millis(spark, patience), forget and _millis(spark, forget))
    return _run(rows, "session_id", log, "epoch bigint, seq bigint, role string, text string, missing bigint")


def segment_stream(
    tokens: DataFrame, *, chunk_chars: int = config.SEGMENT_CHARS, soft_chars: int = config.SEGMENT_SOFT_CHARS,
    event_time: str | None = None, patience: str = PATIENCE, forget: str | None = None, late: str = PATIENCE,
) -> DataFrame:
    """Stream of (stream_id, seq, token, end) to pieces (stream_id, start, piece, missing).

    ``seq`` numbers a stream's rows from 0; the row with ``end`` flushes the buffer, as does ``forget`` without a row. Tokens
    that never come are passed over as turns are in ``session_log``, and ``missing`` counts them. The state of a stream
    is its buffer, shorter than one piece, and the rows that wait.
    """
    spark = tokens.sparkSession
    timed = _timed(tokens, event_time, late)
    rows = timed.select("stream_id", F.col("seq").cast("bigint").alias("seq"), "event_time", "token", F.coalesce("end", F.lit(False)).alias("end"))
    pieces = _Pieces(*limits(chunk_chars, soft_chars), "seq", {"token": "string", "end": "boolean"}, _millis(spark, patience), forget and _millis(spark, forget))
    return _run(rows, "stream_id", pieces, "start bigint, piece string, missing bigint")
