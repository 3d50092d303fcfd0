"""Best-fit packing of documents into token sequences, with the long ones placed by a linear grouping scheme.

The plan is made on the histogram of piece lengths alone, which has at most as many rows as a sequence has tokens,
so its cost does not depend on the corpus. Pieces find their place by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfield.llm.common import Tables, arrow_rows, of_process
from inkfield.llm.tokens import DocumentIds

CAPACITY = 2048
GROUPS = 256
SMALL = 8  # lengths below capacity / SMALL are small
TOKENIZER = "byte_bpe_50k.json"
RANKED_ROWS = 500_000  # aim for the rows of one length that are ranked together


@dataclass(frozen=True)
class Run:
    """``count`` sequences from ``first`` on, filled alike up to ``used`` tokens."""

    first: int
    count: int
    used: int


@dataclass(frozen=True)
class Place:
    """Pieces of ``length`` with ranks ``rank`` and up: ``each`` of them in every sequence from ``first``, at ``offset``."""

    length: int
    rank: int
    count: int
    first: int
    each: int
    offset: int


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text).

    A document is its ids and the end id 0, a null text only the end. Documents longer than ``capacity`` are cut into
    pieces of that length, of which the first is shorter where they do not come out even. No piece is dropped and
    each lies in one sequence; sequences have no gaps. Repeated rows and rows without doc_id are packed like any other.
    Other columns are ignored; an empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "packing")
    pieces = tables.keep(_pieces(docs.select("doc_id", "text"), tokenizer, capacity))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = plan(histogram, capacity)
    ranked = _ranked(tables, pieces, sum(histogram.values()))
    columns = [np.array([getattr(p, k) for p in places], np.int64) for k in ("length", "rank", "first", "each", "offset")]
    order = np.lexsort((columns[1], columns[0]))
    length, rank, first, each, offset = (c[order] for c in columns)
    shift = 40
    key = (length << shift) + rank

    def place(c):
        n, r = (np.asarray(c[k]) for k in ("length", "rank"))
        at = np.searchsorted(key, (n << shift) + r, side="right") - 1
        k = r - rank[at]
        out = {name: c[name] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
        return out | {"sequence_id": first[at] + k // each[at], "offset": offset[at] + k % each[at] * n}

    return arrow_rows(
        ranked, place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def _pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    def cut(c):
        ids, sizes = of_process(DocumentIds, tokenizer)(c["text"].to_pylist())
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        data, at = memoryview(ids.astype("<u4").tobytes()), 0
        for doc, n in zip(c["doc_id"].to_pylist(), sizes.tolist()):
            begin, piece, size = 0, 0, n % capacity or capacity
            while begin < n:
                out["doc_id"].append(doc)
                out["piece"].append(piece)
                out["start"].append(begin)
                out["length"].append(size)
                out["ids_crc32"].append(zlib.crc32(data[4 * (at + begin) : 4 * (at + begin + size)]))
                begin, piece, size = begin + size, piece + 1, capacity
            at += n
        return out

    return arrow_rows(docs, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _ranked(tables: Tables, pieces: DataFrame, n: int) -> DataFrame:
    """Pieces with their rank, from 0, among those of their length; a frequent length is ranked in many parts."""
    parts = max(32, n // RANKED_ROWS)
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tables.keep(sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "part"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Place]:
    """Where the pieces of each length go, in as few sequences as the scheme finds.

    1. Long lengths are sorted and split into groups of equal numbers of pieces; each piece counts as the longest of its group.
    2. The longest group left takes the other groups that fill a sequence best, as often as they last.
    3. The actual pieces take the places of their group, longest first, which leaves some room in each sequence.
    4. Short pieces go, longest first, where the least room that suffices is left, and to new sequences after that.
    """
    small = capacity // SMALL
    rank = dict.fromkeys(histogram, 0)
    places: list[Place] = []
    runs: list[Run] = []
    nxt = 0

    def put(length: int, count: int, first: int, each: int, offset: int) -> None:
        places.append(Place(length, rank[length], count, first, each, offset))
        rank[length] += count

    queues = _grouped({k: n for k, n in histogram.items() if k >= small and n}, groups)
    left = {size: sum(n for _, n in q) for size, q in queues.items()}
    while left:
        pattern = _pattern(left, capacity)
        times = min(left[s] // m for s, m in pattern.items())
        slots = [s for s, m in sorted(pattern.items(), reverse=True) for _ in range(m)]
        # Every slot takes the next pieces of its group; the run is cut wherever a slot's length changes.
        fills = [_take(queues[s], times) for s in slots]
        done = 0
        while done < times:
            n = min(f[0][1] for f in fills)
            used = 0
            for f in fills:
                put(f[0][0], n, nxt + done, 1, used)
                used += f[0][0]
                f[0] = (f[0][0], f[0][1] - n)
                if not f[0][1]:
                    f.pop(0)
            runs.append(Run(nxt + done, n, used))
            done += n
        nxt += times
        for s, m in pattern.items():
            left[s] -= m * times
            if not left[s]:
                del left[s]
    # Runs by the room they have left; the least that suffices comes first.
    room = sorted((capacity - r.used, r.first, r.count) for r in runs if r.used < capacity)
    for length in sorted((k for k, n in histogram.items() if k < small and n), reverse=True):
        n = histogram[length]
        while n:
            at = bisect_left(room, (length,))
            if at == len(room):
                count = -(-n // (capacity // length))
                insort(room, (capacity, nxt, count))
                nxt += count
                continue
            free, first, count = room.pop(at)
            each = free // length
            full = min(count, n // each)
            if full:
                put(length, full * each, first, each, capacity - free)
                n -= full * each
                if free > each * length:
                    insort(room, (free - each * length, first, full))
            if full < count:
                rest = (free, first + full, count - full)
                if 0 < n < each:
                    put(length, n, first + full, n, capacity - free)
                    insort(room, (free - n * length, first + full, 1))
                    n, rest = 0, (free, first + full + 1, count - full - 1)
                if rest[2]:
                    insort(room, rest)
    return places


def _grouped(histogram: dict[int, int], groups: int) -> dict[int, list[tuple[int, int]]]:
    """Longest length of each group to its (length, count) entries, longest first; no length is split between groups."""
    total, out, seen, size = sum(histogram.values()), {}, 0, 0
    for length in sorted(histogram, reverse=True):
        if not out or seen * groups >= total * len(out):
            size = length
            out[size] = []
        out[size].append((length, histogram[length]))
        seen += histogram[length]
    return out


def _take(queue: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The next ``n`` pieces of a group as (length, count) entries, removed from it."""
    out = []
    while n:
        length, have = queue[0]
        use = min(have, n)
        out.append((length, use))
        n -= use
        if use == have:
            queue.pop(0)
        else:
            queue[0] = (length, have - use)
    return out


def _pattern(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest size left and the sizes that fill the rest of a sequence best."""
    sizes = sorted(left, reverse=True)
    pattern = {sizes[0]: 1}
    free = capacity - sizes[0]
    items = [
        s for s in sizes if s <= free for _ in range(min(left[s] - pattern.get(s, 0), free // s))
    ]
    # Bit k of a set: some of the items so far come to k tokens.
    sums, mask = [1], (1 << (free + 1)) - 1
    for s in items:
        sums.append((sums[-1] | sums[-1] << s) & mask)
        if sums[-1] >> free & 1:
            break
    at = sums[-1].bit_length() - 1
    for k in range(len(sums) - 1, 0, -1):
        if not sums[k - 1] >> at & 1:
            s = items[k - 1]
            pattern[s] = pattern.get(s, 0) + 1
            at -= s
    return pattern
