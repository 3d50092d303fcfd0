"""Near-duplicate documents by minhash with tensored banding and exact verification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import Tables, arrow_rows, connected, free_name, of_process, quoted
from inkfield.llm.shingles import WORDS_PER_SHINGLE, Collections, WordHashes, shingle_set, words_of
from inkfield.operators.ordinals import dense_ordinals

GROUPS = 12
ROWS = 3
SIMILARITY = 80  # percent
BROADCAST_ROWS = 500_000  # of some 60 bytes
WORTH = 10  # rounds of leaders end when less than one in so many comparisons finds a link
BLOCK = 1_000_000  # shingles of a crowded bucket that one task compares with as many others
COUNTS = 256  # parts that the shingles of a set are counted in


@dataclass(frozen=True)
class Settings:
    """``groups`` groups of ``rows`` minhashes a side, so groups^2 tables.

    A pair of similarity s shares a table with probability (1 - (1 - s^rows)^groups)^2: 0.9996 at 0.8 as set here.
    """

    words: int = WORDS_PER_SHINGLE
    similarity: int = SIMILARITY
    groups: int = GROUPS
    rows: int = ROWS


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs`` (doc_id, text).

    Two documents are linked when the Jaccard similarity of their sets of word shingles is at least ``similarity``
    percent; sets are compared whole, as 64-bit hashes. Components are those of the links.

    1. Documents with equal sets become one class, so copies cost nothing from here on.
    2. Every class draws two small collections of minhash groups. A group that no other class has cannot
       be part of a shared key.
    3. Each round draws an order; the first class that has a group leads it, and every class is compared with one leader, the
       one it shares most groups with, on both sides. Rounds go on while a tenth of their candidates are links. A group whose
       classes are all connected is done. The others are combined in pairs to table keys; of buckets with the same classes
       one is kept.
    4. Buckets that still have several components are compared whole, in blocks of bounded size, so that
       every pair that shares a table is tested or connected already. No bucket emits its pairs.

    Before whole sets are moved, counts of their shingles by parts of the hash bound the intersection from above; a pair that
    stays below ``similarity`` even so is no link.

    Null or blank texts have no shingles, link with nothing and are kept. Repeated rows are copies of each other
    and share a component; ``kept`` holds for each of them if it holds for one. Rows whose doc_id is null count
    as texts like others, but a component takes its id from the other rows; without any it is null, and such a row is kept
    only then. Other columns of ``docs`` are ignored. Empty tables give empty results.
    """
    tables = Tables(docs.sparkSession, "near-text")
    signed = tables.keep(_signed(docs.select("doc_id", "text"), settings))
    classes = tables.keep(
        signed.where("node is not null").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("groups").alias("groups"))
    )
    members = _shared_groups(tables, classes, settings)
    nodes = tables.keep(members.select("node").distinct())
    partnered = tables.keep(classes.join(_shipped(nodes), "node", "left_semi"))
    tables.drop(nodes)
    sets = _sets(tables, docs, partnered, settings)
    components = _link(tables, members, sets, partnered, settings, block)
    tables.drop(sets, partnered)
    named = tables.keep(
        classes.join(components, "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
        .agg(F.min("doc_id").alias("component_id"))
    )
    of_class = tables.keep(
        classes.select("node").join(components, "node", "left")
        .withColumn("component", F.coalesce("component", "node")).join(named, "component").select("node", "component_id")
    )
    tables.drop(classes, components, named)
    plain = signed.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = signed.where("node is not null").select("doc_id", "n_shingles", "node").join(of_class, "node")
    return out.select("doc_id", "n_shingles", "component_id").unionAll(plain).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each component the document with the least doc_id stays.

    Rows without doc_id cannot be told apart by it and stay; of repeated rows (same doc_id and text) one stays. Different
    texts under one doc_id are documents of their own.
    """
    tables = Tables(docs.sparkSession, "one-of-each")
    wording = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(wording).alias("a"), F.max(wording).alias("b"))
    if several.where("a <> b").isEmpty():
        return _one_of_each(tables, docs, settings)
    # Numbers in the order of doc_id tell the texts under one doc_id apart.
    number, name = free_name(docs.columns, "number"), free_name(docs.columns, "wording")
    named = docs.withColumn(name, wording)
    pairs = named.where("doc_id is not null").select("doc_id", name).distinct()
    numbers = tables.keep(dense_ordinals(pairs, ["doc_id", name], number))
    numbered = tables.keep(named.join(numbers, ["doc_id", name], "left").select(*map(quoted, docs.columns), number))
    kept = _one_of_each(tables, numbered.withColumnRenamed("doc_id", name).withColumnRenamed(number, "doc_id"), settings)
    return kept.drop("doc_id").withColumnRenamed(name, "doc_id").select(*map(quoted, docs.columns))


def _one_of_each(tables: Tables, docs: DataFrame, settings: Settings) -> DataFrame:
    """``one_of_each`` where every doc_id has one text."""
    found = tables.keep(near_duplicates(docs, settings).where("doc_id is not null").select("doc_id", "kept"))
    gone = found.where("not kept").select("doc_id").distinct()
    repeated = tables.keep(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    columns = [*map(quoted, docs.columns)]
    rest = docs.join(_shipped(tables.keep(gone)), "doc_id", "left_anti").select(*columns)
    if repeated.isEmpty():
        return rest
    again = rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(repeated, "doc_id", "left_anti").select(*columns).unionAll(again.select(*columns))


def _signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, node (128-bit hash of the set, null if empty), groups (minhash group values)."""
    width, groups, rows = settings.words, settings.groups, settings.rows
    def signatures(columns):
        hashes, draw = of_process(WordHashes), of_process(Collections, groups, rows)
        n, node, values = [], [], []
        for text in columns["text"]:
            s = shingle_set(words_of(text.as_py()), hashes, width)
            n.append(len(s))
            node.append(xxhash.xxh3_128_digest(s) if len(s) else None)
            values.append(draw(s) if len(s) else None)
        return {"doc_id": columns["doc_id"], "n_shingles": n, "node": node, "groups": values}

    return arrow_rows(docs, signatures, "doc_id long, n_shingles long, node binary, groups array<long>")


def _shared_groups(tables: Tables, classes: DataFrame, settings: Settings) -> DataFrame:
    """place, value, node, n: the groups that another class has too, of the classes that have some on both sides."""
    g = settings.groups
    groups = classes.select("node", "n", F.posexplode("groups").alias("place", "value"))
    shared = tables.keep(
        groups.groupBy("place", "value").agg(F.count("*").alias("members")).where("members > 1").select("place", "value")
    )
    found = tables.keep(groups.join(_shipped(shared), ["place", "value"]))
    both = tables.keep(
        found.groupBy("node").agg(F.min("place").alias("first"), F.max("place").alias("second"))
        .where((F.col("first") < g) & (F.col("second") >= g)).select("node")
    )
    out = tables.keep(found.join(_shipped(both), "node", "left_semi"))
    tables.drop(shared, found, both)
    return out


def _shared_keys(tables: Tables, classes: DataFrame, settings: Settings, members: DataFrame | None = None) -> DataFrame:
    """key, place, node, n: table keys, and the tables they are of, of the classes for which another class has both groups.

    Near copies share dozens of buckets. Of those with the same classes only the first by place is kept: it holds every pair of
    the others, and a pair's first bucket is never one of the others. ``members`` are the groups to combine, all shared ones if
    not given.
    """
    g = settings.groups
    members = _shared_groups(tables, classes, settings) if members is None else members
    own = members.groupBy("node", "n").agg(
        F.collect_list(F.when(F.col("place") < g, F.struct("place", "value"))).alias("first"),
        F.collect_list(F.when(F.col("place") >= g, F.struct("place", "value"))).alias("second"),
    )
    pairs = own.select("node", "n", F.explode("first").alias("x"), "second").select(
        "node", "n", "x", F.explode("second").alias("y")
    )
    place = (F.col("x.place") * g + F.col("y.place") - g).cast("int").alias("place")
    keys = tables.keep(pairs.select(F.xxhash64("x", "y").alias("key"), place, "node", "n"))
    buckets = keys.groupBy("key").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.min("place").alias("place"),
    ).where("members > 1")
    unlike = tables.keep(buckets.groupBy("members", "x", "y").agg(F.min(F.struct("place", "key")).alias("first")).select("first.key"))
    kept = tables.keep(keys.join(_shipped(unlike), "key", "left_semi"))
    tables.drop(keys, unlike)
    return kept


def _sets(tables: Tables, docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """node, shingles, counts: the whole sets of the given classes, read again from one of their documents."""
    width = settings.words

    def collect(columns):
        hashes = of_process(WordHashes)
        node, sets, counts = [], [], []
        for of, text in zip(columns["node"], columns["text"]):
            s = shingle_set(words_of(text.as_py()), hashes, width)
            if xxhash.xxh3_128_digest(s) == of.as_py():  # not another text under the same doc_id
                node.append(of)
                sets.append(s.tobytes())
                counts.append(counted(s))
        return {"node": pa.array(node, pa.binary()), "shingles": sets, "counts": counts}

    wanted = tables.keep(classes.select("node", F.col("doc_id").alias("doc_id_")))
    texts = docs.select("doc_id", "text").join(
        _shipped(wanted), F.col("doc_id").eqNullSafe(F.col("doc_id_"))
    ).select("node", "text")
    sets = tables.keep(arrow_rows(texts, collect, "node binary, shingles binary, counts binary"))
    if sets.count() > wanted.count():  # repeated rows
        repeated, sets = sets, tables.keep(sets.dropDuplicates(["node"]))
        tables.drop(repeated)
    tables.drop(wanted)
    return sets


def counted(shingles: np.ndarray) -> bytes:
    """How many of a set's shingles are in each of COUNTS parts, as bytes or, where a part has more, as 32-bit integers."""
    n = np.bincount((shingles & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS)
    return n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes()


def uncounted(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, np.uint8 if len(counts) == COUNTS else np.uint32)


def _possible(tables: Tables, pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that may be links by the counts of their shingles: sets have no more in common than in each part."""

    def reach(columns):
        x, y = (np.stack([uncounted(v) for v in columns[k].to_pylist()]) if len(columns[k]) else np.empty((0, COUNTS)) for k in "xy")
        most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
        whole = x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64) - most
        use = pa.array(100 * most >= similarity * whole)
        return {k: columns[k].filter(use) for k in "ab"}

    x = sets.select(F.col("node").alias("a"), F.col("counts").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("counts").alias("y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return tables.keep(arrow_rows(met, reach, "a binary, b binary"))


def _link(tables: Tables, members: DataFrame, sets: DataFrame, classes: DataFrame, settings: Settings, block: int) -> DataFrame:
    """(node, component): components after rounds of leaders, and a whole comparison of the buckets that are left."""
    components, left = _rounds(tables, members, sets, settings)
    # A pair of two components has its groups among those left, so none of its buckets is missing.
    keys = _shared_keys(tables, classes, settings, left)
    tables.drop(left)
    rest = _rest(tables, keys, components, sets, classes.select("node", "groups"), settings, block)
    tables.drop(keys)
    return components if rest.isEmpty() else _joined(tables, components, rest)


def _rounds(tables: Tables, members: DataFrame, sets: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(node, component) after rounds of leaders, and the rows of ``members`` whose groups were open before the last.

    A round makes at most one comparison for each class, however many of its groups are crowded.
    """
    components, turn = tables.spark.createDataFrame([], "node binary, component binary"), 0
    while True:
        of = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        leaders = tables.keep(
            of.groupBy("place", "value").agg(
                F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "n", "component")).alias("leader"),
                F.min("component").alias("least"), F.max("component").alias("most"),
            ).where("least <> most").select("place", "value", "leader")
        )
        still = tables.keep(of.join(leaders, ["place", "value"]))
        tables.drop(leaders, members)
        members = tables.keep(still.select("place", "value", "node", "n"))
        size, other = F.col("n"), F.col("leader.n")
        second = F.col("place") >= settings.groups
        shared = still.where(
            (F.col("component") != F.col("leader.component"))
            & (100 * F.least(size, other) >= settings.similarity * F.greatest(size, other))
        ).groupBy(F.col("node").alias("a"), F.col("leader.node").alias("b"))
        shared = shared.agg(F.count("*").alias("shared"), F.min(second).alias("x"), F.max(second).alias("y")).where("not x and y")
        pairs = tables.keep(shared.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", "best.b"))
        likely = _possible(tables, pairs, sets, settings.similarity)
        results = _compared(tables, likely, sets)
        links = tables.keep(results.where(100 * F.col("common") >= settings.similarity * F.col("whole")).select("a", "b"))
        candidates, found = pairs.count(), links.count()
        if found:
            components = _joined(tables, components, links)
        tables.drop(still, pairs, likely, results, links)
        if WORTH * found < candidates or not found:
            return components, members
        turn += 1


def _joined(tables: Tables, components: DataFrame, links: DataFrame) -> DataFrame:
    """The components that are left when those of the ends of ``links`` (a, b) are joined; only these are contracted."""
    of = components.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    to = components.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = links.join(of, "a", "left").join(to, "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")
    )
    merged = tables.keep(connected(tables, between))
    old = components.join(
        merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left"
    ).select("node", F.coalesce("to", "component").alias("component"))
    after = tables.keep(old.unionAll(merged.join(components.select("node"), "node", "left_anti")))
    tables.drop(components, merged)
    return after


def _rest(
    tables: Tables, keys: DataFrame, components: DataFrame, sets: DataFrame, groups: DataFrame, settings: Settings, block: int
) -> DataFrame:
    """(a, b): links enough to connect what the links inside the given buckets connect.

    A bucket is cut into blocks by hash, and each block is compared with itself
    and each other. Of the buckets that two classes share, the first by the places of their groups compares them, so most buckets
    compare few: group values, sizes, components and counts of shingles tell which classes have a partner in a block, and only their
    sets are moved there.
    """
    side, similarity = settings.groups, settings.similarity
    classes = groups.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    wide = tables.keep(keys.join(classes, "node").join(sets.select("node", "counts"), "node"))
    agree = F.array(*[F.min(F.get("groups", F.lit(j))) == F.max(F.get("groups", F.lit(j))) for j in range(2 * side)])
    first, second = F.floor(F.col("place") / side).cast("int"), F.col("place") % side
    # Where all classes of a bucket agree in an earlier group too, another bucket compares all of them.
    open_ = tables.keep(wide.groupBy("key", "place").agg(
        F.sum("n").alias("shingles_of"), agree.alias("agree"),
        F.min("component").alias("least"), F.max("component").alias("most"),
    ).where(
        (F.col("least") != F.col("most"))
        & ~F.exists(F.slice("agree", F.lit(1), first), lambda v: v)
        & ~F.exists(F.slice("agree", F.lit(side + 1), second), lambda v: v)
    ).select("key", F.ceil(F.col("shingles_of") / block).cast("int").alias("blocks")))
    cut = wide.join(_shipped(open_), "key")
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    rows = tables.keep(
        cut.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "blocks")
    )

    def partners(group: pd.DataFrame):
        """For each class of the one block, its place and the places of the classes of the other that it is compared with here."""
        own, x, y = (group[k].to_numpy() for k in ("own", "x", "y"))
        n, root = group["n"].to_numpy(), pd.factorize(group["component"])[0]
        values = np.array(group["groups"].tolist(), np.int64)
        counts = np.stack([uncounted(c) for c in group["counts"]])
        first, second = divmod(int(group["place"].iloc[0]), side)
        earlier = values[:, np.r_[0:first, side : side + second]]  # a pair that agrees here is compared in another bucket
        left, right = np.flatnonzero(own == x[0]), np.flatnonzero(own == y[0])
        for at, i in enumerate(left):
            to = right[at + 1 :] if x[0] == y[0] else right
            to = to[(root[to] != root[i]) & (100 * np.minimum(n[to], n[i]) >= similarity * np.maximum(n[to], n[i]))]
            to = to[~(earlier[to] == earlier[i]).any(axis=1)]
            if len(to):
                most = np.minimum(counts[to], counts[i]).sum(axis=1, dtype=np.int64)
                yield i, to[100 * most >= similarity * (n[i] + n[to] - most)]

    def needed(group: pd.DataFrame) -> pd.DataFrame:
        use = np.zeros(len(group), bool)
        for i, to in partners(group):
            use[to] = True
            use[i] |= len(to) > 0
        return group.loc[use]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        n, node = group["n"].to_numpy(), group["node"].to_numpy()
        root = pd.factorize(group["component"])[0]
        each = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        ids = np.split(np.unique(np.concatenate(each), return_inverse=True)[1], np.cumsum([len(s) for s in each])[:-1])
        here = np.zeros(max(i.max() for i in ids) + 1, bool)
        a, b = [], []
        for i, to in partners(group):
            to = to[root[to] != root[i]]  # not connected by a link found before
            if not len(to):
                continue
            here[ids[i]] = True
            starts = np.cumsum([0, *(len(ids[j]) for j in to[:-1])])
            common = np.add.reduceat(here[np.concatenate([ids[j] for j in to])], starts, dtype=np.int64)
            here[ids[i]] = False
            for j in to[100 * common >= similarity * (n[i] + n[to] - common)]:
                if root[j] != root[i]:
                    a.append(node[i])
                    b.append(node[j])
                    root[root == root[j]] = root[i]
        return pd.DataFrame({"a": a, "b": b}, dtype=object)

    at = ["key", "x", "y"]
    parts = int(tables.spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but costly: not to be coalesced
    used = tables.keep(rows.repartition(parts, *at).groupBy(*at).applyInPandas(needed, rows.schema))
    wanted = tables.keep(used.select("node").distinct())
    moved = sets.select("node", "shingles").join(_shipped(wanted), "node", "left_semi")
    compared = used.join(moved, "node").groupBy(*at).applyInPandas(compare, "a binary, b binary")
    links = tables.keep(compared.distinct())
    tables.drop(wide, open_, rows, used, wanted)
    return links


def _compared(tables: Tables, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with the sizes of the intersection and union of their whole sets."""

    def sizes(columns):
        common, whole = [], []
        for x, y in zip(columns["x"], columns["y"]):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            whole.append(len(np.union1d(s, t)))
            common.append(len(s) + len(t) - whole[-1])
        return {"a": columns["a"], "b": columns["b"], "common": common, "whole": whole}

    # Only sets of compared classes are moved. A leader of many is a common key of an inner join, which can be split.
    led = tables.keep(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(_shipped(pairs), "a"))
    leading = tables.keep(pairs.select("b").distinct())
    of_leaders = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(_shipped(leading), "b", "left_semi")
    met = led.join(of_leaders, "b")
    results = tables.keep(arrow_rows(met.select("a", "b", "x", "y"), sizes, "a binary, b binary, common long, whole long"))
    tables.drop(led, leading)
    return results


def _shipped(rows: DataFrame) -> DataFrame:
    """A written table of short rows, marked for broadcast if it has at most BROADCAST_ROWS; larger ones are shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
