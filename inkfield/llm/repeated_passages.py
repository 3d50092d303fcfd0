"""Passages that occur more than once, removed: windows of words counted exactly in super-k-mer buckets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import Batches, Tables
from inkfield.llm.word_hashes import Runs, hashes, lowest_in_windows, words

RUN_WINDOWS = 4096  # windows of a run at most
REMEMBERED = 50_000  # texts that a task remembers to have packed


@dataclass(frozen=True)
class Sizes:
    """Words of a window and of a minimiser, and bounds on what a task holds at once; results depend on ``window`` alone."""

    window: int = 35
    seed: int = 8
    slice_bytes: int = 2 << 20  # of texts handled at once
    bucket: int = 400_000  # words of a bucket, about
    crowded: int = 200_000  # a minimiser whose wordings have more words is counted window by window


def without_repeats(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, text, n_words, n_removed of every row of ``docs`` (doc_id, text), repeated passages taken out of the text.

    Words lie between ASCII white space and are compared unchanged; ``text`` has the kept ones joined by one space. A window is
    ``sizes.window`` consecutive words of one text. Each word goes that is covered by a window whose words also start anywhere else, in
    the same text or another; windows are judged on the input. Null texts count as empty, texts shorter than a window stay
    whole, repeated rows are copies of each other like any others, doc_id may be null or repeated. Other columns are ignored. An
    empty table gives an empty result.

    Consecutive windows with the same minimiser (the least hash of ``sizes.seed`` words in them) make one run. Only minimisers
    found at two places can hold a repeated window, so these are counted first. One run of each wording that is left travels
    as a packed string to its minimiser's bucket, where windows are sorted and counted word by word; all runs learn the
    outcome by a join on 128 bits of their wording. Minimisers with too many wordings for a bucket (a line common to many
    texts) are counted by 128 bits of each window instead.
    """
    tables = Tables(docs.sparkSession, "repeats")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    found = _repeated(tables, texts, sizes)
    marked = texts.join(found, ["t1", "t2"], "left").select("doc_id", "text", "found")
    return marked.mapInArrow(_taken_out, "doc_id long, text string, n_words long, n_removed long")


def digests(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of ``without_repeats``."""
    kept = F.sha2(F.col("text").cast("binary"), 256)
    return without_repeats(docs, sizes).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def _repeated(tables: Tables, texts: DataFrame, sizes: Sizes) -> DataFrame:
    """t1, t2, found: for each text with repeated windows its runs' first words and the spans of words covered in them."""
    keys = ["t1", "t2"]
    cut = texts.select(*keys, "text").mapInArrow(
        _cut(sizes), "t1 long, t2 long, first int, windows int, m long, p1 long, p2 long, places long, copies long"
    )
    often = tables.keep(cut.groupBy("m").agg(F.sum(F.col("places") * F.col("copies")).alias("n")).where("n > 1").select("m"))
    runs = cut.join(often, "m").groupBy(*keys, "first", "windows", "m", "p1", "p2").agg(F.sum("copies").alias("copies"))
    runs = tables.keep(runs)
    tables.drop(often)
    wordings = tables.keep(
        runs.groupBy("m", "p1", "p2").agg(
            F.sum("copies").alias("copies"), F.max("windows").alias("windows"), F.min(F.struct(*keys, "first")).alias("at")
        )
    )
    size = F.col("windows") + F.lit(sizes.window - 1)
    crowded = tables.keep(wordings.groupBy("m").agg(F.sum(size).alias("n")).where(F.col("n") > sizes.crowded).select("m", F.lit(True).alias("crowded")))
    total = wordings.agg(F.sum(size)).first()[0] or 0
    wanted = wordings.join(crowded, "m", "left").select("at.*", "windows", "m", "p1", "p2", "copies", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    per_text = F.collect_list(F.struct("first", "windows", "m", "p1", "p2", "copies")).alias("runs")
    ask = lambda which: texts.select(*keys, "text").join(tables.keep(wanted.where(which).groupBy(*keys).agg(per_text)), keys)

    packed = ask("not crowded").mapInArrow(_packed(sizes), "m long, p1 long, p2 long, copies long, words string")
    buckets = packed.withColumn("bucket", F.pmod("m", F.lit(1 + total // sizes.bucket))).groupBy("bucket")
    spans = buckets.applyInArrow(_counted(sizes), "p1 long, p2 long, spans array<int>")
    if crowded.count():
        spans = spans.unionAll(_window_by_window(tables, ask("crowded"), sizes))
    spans = tables.keep(spans)
    found = runs.join(spans, ["p1", "p2"]).groupBy(*keys).agg(F.collect_list(F.struct("first", "spans")).alias("found"))
    found = tables.keep(found)
    tables.drop(runs, wordings, crowded, spans)
    return found


def _window_by_window(tables: Tables, asked: DataFrame, sizes: Sizes) -> DataFrame:
    """Spans of the runs of crowded minimisers."""
    windows = tables.keep(asked.mapInArrow(_windows(sizes), "w1 long, w2 long, p1 long, p2 long, place int, copies long"))
    often = tables.keep(windows.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").select("w1", "w2"))
    places = windows.join(often, ["w1", "w2"]).groupBy("p1", "p2").agg(F.array_sort(F.collect_set("place")).alias("places"))

    def merged(batches: Batches) -> Batches:
        for b in batches:
            spans = [_spans(np.array(p), sizes.window) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.int32()))], ["p1", "p2", "spans"])

    return places.mapInArrow(merged, "p1 long, p2 long, spans array<int>")


def _spans(places: np.ndarray, window: int) -> list[int]:
    """First word and the word after it of what windows at ascending ``places`` cover, put together where they touch."""
    cuts = np.flatnonzero(np.diff(places) > window) + 1
    first = places[np.r_[0, cuts]]
    last = places[np.r_[cuts - 1, len(places) - 1].astype(int)] + window
    return np.column_stack([first, last]).ravel().tolist()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text begins, with the end of the last."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def _pieces(data: np.ndarray, offsets: np.ndarray, sizes: Sizes) -> Iterator[tuple]:
    """(texts, first word's number in its text, first bytes, last bytes, words of each text) of slices of bounded size.

    A slice is several whole texts or a part of a long one; parts overlap by one word less than a window.
    """
    at, n = 0, len(offsets) - 1
    while at < n:
        lo = int(offsets[at])
        end = max(at + 1, int(np.searchsorted(offsets, lo + sizes.slice_bytes, "right")) - 1)
        hi = int(offsets[end])
        if hi - lo <= sizes.slice_bytes:
            own = offsets[at : end + 1] - lo
            first, last = words(data[lo:hi], own)
            ends = np.searchsorted(first, own)
            yield np.arange(at, end), np.zeros(end - at, np.int64), first + lo, last + lo, np.diff(ends)
        else:
            number, first, last = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
            while lo < hi:
                stop = _white_space_from(data, min(hi, lo + sizes.slice_bytes), hi)
                f, e = words(data[lo:stop])
                first, last = np.r_[first, f + lo], np.r_[last, e + lo]
                yield np.array([at]), np.array([number]), first, last, np.array([len(first)])
                kept = min(len(first), sizes.window - 1)
                number += len(first) - kept
                first, last, lo = first[len(first) - kept :], last[len(last) - kept :], stop
        at = end


def _white_space_from(data: np.ndarray, at: int, hi: int) -> int:
    """The first white space from ``at`` on, so that no word is cut."""
    while at < hi:
        part = data[at : min(hi, at + 65_536)]
        found = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
        if len(found):
            return at + int(found[0])
        at += len(part)
    return hi


def _cut(sizes: Sizes):
    """Runs of windows with one minimiser; texts that a batch holds several times are cut once and counted."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            keys = np.rec.fromarrays([b.column(0).to_numpy(), b.column(1).to_numpy()], names="t1,t2")
            _, once, copies = np.unique(keys, return_index=True, return_counts=True)
            t1, t2 = keys.t1[once], keys.t2[once]
            data, offsets = _bytes(b.column(2).take(pa.array(once)))
            for texts, number, first, last, counts in _pieces(data, offsets, sizes):
                found = _runs(hashes(data, first, last), counts, sizes)
                if found is None:
                    continue
                start, windows, m, p1, p2, places = found
                which = np.searchsorted(np.cumsum(counts), start, "right")
                text = texts[which]
                word = start - (np.cumsum(counts) - counts)[which] + number[which]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(t1[text]), pa.array(t2[text]), pa.array(word.astype(np.int32)), pa.array(windows.astype(np.int32)),
                        pa.array(m.view(np.int64)), pa.array(p1.view(np.int64)), pa.array(p2.view(np.int64)), pa.array(places),
                        pa.array(copies[text].astype(np.int64)),
                    ],
                    ["t1", "t2", "first", "windows", "m", "p1", "p2", "places", "copies"],
                )

    return run


def _runs(word_hashes: tuple[np.ndarray, np.ndarray], counts: np.ndarray, sizes: Sizes):
    """First word, windows, minimiser, wording's hashes and places of the minimiser of each run in a slice; None without a window."""
    n = len(word_hashes[0])
    ends = np.repeat(np.cumsum(counts), counts)
    valid = np.flatnonzero(np.arange(n) + sizes.window <= ends)
    if not len(valid):
        return None
    hashed = Runs(word_hashes)
    seeds = hashed(np.arange(n - sizes.seed + 1), sizes.seed, 0)
    m = lowest_in_windows(seeds, sizes.window - sizes.seed + 1)[valid]
    cuts = np.flatnonzero((m[1:] != m[:-1]) | (valid[1:] != valid[:-1] + 1)) + 1
    at = np.r_[0, cuts]
    lengths = np.diff(np.r_[at, len(valid)])
    parts = -(-lengths // RUN_WINDOWS)
    at = np.repeat(at, parts) + RUN_WINDOWS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    windows = np.diff(np.r_[at, len(valid)])
    first, size = valid[at], windows + sizes.window - 1
    inside = size - sizes.seed + 1
    starts = np.cumsum(inside) - inside
    same = seeds[np.arange(inside.sum()) + np.repeat(first - starts, inside)] == np.repeat(m[at], inside)
    return first, windows, m[at], hashed(first, size, 0), hashed(first, size, 1), np.add.reduceat(same.astype(np.int64), starts)


def _asked(batches: Batches) -> Iterator[tuple[bytes, list[dict]]]:
    """Each text (once) with the runs that are wanted of it."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        t1, t2, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary())
        for k, key in enumerate(zip(t1, t2)):
            if key in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(key)
            yield texts[k].as_py(), b.column(3)[k].as_py()


def _packed(sizes: Sizes):
    """Wanted runs as strings of their words."""
    names = ["m", "p1", "p2", "copies", "words"]

    def run(batches: Batches) -> Batches:
        rows, held = [], 0
        for text, runs in _asked(batches):
            own = text.split()
            for r in runs:
                packed = b" ".join(own[r["first"] : r["first"] + r["windows"] + sizes.window - 1])
                rows.append((r["m"], r["p1"], r["p2"], r["copies"], packed))
                held += len(packed)
            if held > sizes.slice_bytes:
                yield _record(rows, names)
                rows, held = [], 0
        if rows:
            yield _record(rows, names)

    return run


def _record(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    *numbers, texts = zip(*rows)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(texts, pa.binary()).view(pa.string())], names)


def _windows(sizes: Sizes):
    """Each window of the wanted runs by 128 bits."""

    def run(batches: Batches) -> Batches:
        for text, runs in _asked(batches):
            own = text.split()
            for r in runs:
                packed = np.frombuffer(b" ".join(own[r["first"] : r["first"] + r["windows"] + sizes.window - 1]), np.uint8)
                hashed, at = Runs(hashes(packed, *words(packed))), np.arange(r["windows"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashed(at, sizes.window, 0).view(np.int64)), pa.array(hashed(at, sizes.window, 1).view(np.int64)),
                        *(pa.array(np.full(len(at), r[c])) for c in ("p1", "p2")), pa.array(at.astype(np.int32)),
                        pa.array(np.full(len(at), r["copies"])),
                    ],
                    ["w1", "w2", "p1", "p2", "place", "copies"],
                )

    return run


def _counted(sizes: Sizes):
    """Spans of the runs of a bucket that hold windows found more than once in it."""

    def run(bucket: pa.Table) -> pa.Table:
        keys = np.rec.fromarrays([bucket.column(c).to_numpy() for c in ("p1", "p2")], names="p1,p2")
        _, once = np.unique(keys, return_index=True)  # a wording may have come from several copies of its text
        keys, copies = keys[once], bucket.column("copies").to_numpy()[once]
        texts = bucket.column("words").take(pa.array(once)).combine_chunks()
        lists = pc.split_pattern(texts, " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
        codes = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        run_of = np.repeat(np.arange(len(lengths)), lengths)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - starts[run_of]
        valid = np.flatnonzero(place + sizes.window <= lengths[run_of])
        kind = _ranks(codes, sizes.window, valid)
        often = np.bincount(kind, weights=copies[run_of[valid]])[kind] > 1
        hits = valid[often]
        runs, at = np.unique(run_of[hits], return_index=True)
        spans = [_spans(p, sizes.window) for p in np.split(place[hits], at[1:])] if len(runs) else []
        return pa.table(
            {"p1": pa.array(keys.p1[runs]), "p2": pa.array(keys.p2[runs]), "spans": pa.array(spans, pa.list_(pa.int32()))}
        )

    return run


def _ranks(codes: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """A number for each run of ``width`` codes from ``at``, equal for equal runs alone: runs of doubled length are sorted as pairs."""
    ranks, have = codes, 1
    while 2 * have <= width:
        ranks = np.unique(ranks[:-have] * (int(ranks.max()) + 1) + ranks[have:], return_inverse=True)[1] if len(ranks) > have else ranks
        have *= 2
    pairs = ranks[at] * (int(ranks.max()) + 1) + ranks[at + width - have]
    return np.unique(pairs, return_inverse=True)[1]


def _taken_out(batches: Batches) -> Batches:
    """Texts without the words that the spans cover."""
    for b in batches:
        texts = b.column(1).cast(pa.large_binary()).to_pylist()
        kept, n, gone = [], [], []
        for text, found in zip(texts, b.column(2).to_pylist()):
            own = text.split()
            n.append(len(own))
            if found:
                edges = np.zeros(len(own) + 1, np.int32)
                for r in found:
                    spans = np.array(r["spans"]) + r["first"]
                    np.add.at(edges, spans[::2], 1)
                    np.add.at(edges, spans[1::2], -1)
                own = [own[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
            gone.append(n[-1] - len(own))
            kept.append(b" ".join(own))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(kept, pa.binary()).view(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
            ["doc_id", "text", "n_words", "n_removed"],
        )
