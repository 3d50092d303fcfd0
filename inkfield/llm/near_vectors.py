"""Near-duplicate vectors within a label by sorted projection passes, neighbours in the order compared."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import Tables, arrow_rows, connected
from inkfield.llm.vectors import cosines, matrix, unit, usable
from inkfield.operators.ordinals import dense_ordinals

SIMILARITY = 0.93
SEED = 20_017
BITS = tuple(range(0, 31, 2))  # numbers of signs to choose from
WINDOW = 128  # rows that follow a row in the order and are compared with it
STRETCH = 4096  # rows of the order in one group
BLOCK = 8192  # rows of a crowded run that one task compares with each other
SLICE = 256
ROW_COST = 1024  # what moving a row costs, in comparisons
MISSED = 0.003  # share of pairs right at the threshold that all passes together may miss
MARGIN = 1e-9  # radians, far above rounding


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors`` (vec_id, embedding, label).

    Two vectors of the same label are linked if their cosine, in double precision, is ``similarity`` or more. Vectors that
    are null, zero or hold null or non-finite components, and those without a label, link with nothing.

    1. Equal vectors of a label become one class with a weight.
    2. Each pass hashes the classes of a label by the signs of their projections on random directions and sorts them by all
       of these signs, first sign foremost. Each class is compared with the ``window`` classes after it, and with
       all that share its first signs, of which there are enough that an even label has at most a window for each prefix. A
       pair at the threshold agrees in each sign with a known probability, so the number of passes follows from
       the number of signs and holds for any data. Where rows crowd, runs of one prefix are longer than the window; a label takes
       more signs and passes if that costs less by its run lengths, and long runs are cut into blocks.
       Verified pairs of all passes make the components.
    3. Links are counted within components. Vectors within half the threshold's angle of a centre are all linked with
       each other; sums for whole centres are taken where the angles leave no doubt, and single pairs compared elsewhere.

    Repeated rows are equal vectors. Rows without vec_id take part but give no component its id. Other columns are ignored;
    an empty table gives an empty result.
    """
    tables = Tables(vectors.sparkSession, "near-vectors")
    rows = vectors.select("vec_id", "embedding", "label").withColumn(
        "fit", usable("embedding") & F.col("label").isNotNull()
    )
    classes = tables.keep(
        rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    plan = tables.keep(_plan(classes, similarity, block, window))
    links = tables.keep(_links(tables, classes, plan, similarity, block, window))
    components = tables.keep(connected(tables, links))
    grouped = tables.keep(components.join(classes.select("node", "embedding", "weight", "vec_id"), "node"))
    counts = _counts(tables, grouped, similarity)
    ids = grouped.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    of_class = tables.keep(
        classes.select("node", "weight", F.col("vec_id").alias("own"), "label", "embedding")
        .join(grouped.select("node", "component").join(ids, "component").drop("component"), "node", "left")
        .join(counts, "node", "left")
        .select(
            "label", "embedding", F.coalesce("component_id", "own").alias("component_id"),
            (F.coalesce("n", "weight") - 1).alias("n_links"),
        )
    )
    fit = rows.where("fit").join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fit.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def passes(parts: float, similarity: float) -> int:
    """Passes after which a pair at the threshold has shared a bucket, but for the share MISSED, if a pass makes ``parts`` buckets of log2(parts) signs."""
    near = (1 - math.acos(similarity) / math.pi) ** math.log2(max(1.0, parts))
    return 1 if near >= 1 - MISSED else math.ceil(math.log(MISSED) / math.log1p(-near))


def _signs(x: np.ndarray, seed: list[int], bits: int) -> np.ndarray:
    """Signs of the projections on ``bits`` random directions as one number, the first sign foremost."""
    axes = np.random.default_rng(seed).standard_normal((x.shape[1], bits))
    return ((x @ axes) >= 0) @ (1 << np.arange(bits, dtype=np.int64))[::-1]


def _plan(classes: DataFrame, similarity: float, block: int, window: int) -> DataFrame:
    """(label, bits, turns): for each label the number of signs, enough for its size, that costs least, measured on all of its rows."""
    label = classes.schema["label"].dataType.simpleString()

    def keyed(batches):
        for b in batches:
            key = _signs(matrix(b.column("embedding")), [SEED, 0], BITS[-1])
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(key)], ["label", "key"])

    signs = classes.select("label", "embedding").mapInArrow(keyed, f"label {label}, key long")
    prefixes = F.array(*[
        F.struct(F.lit(k).alias("bits"), F.shiftright("key", BITS[-1] - k).alias("prefix"), F.lit(passes(2**k, similarity)).alias("turns"))
        for k in BITS
    ])
    size, copies = F.col("size").cast("double"), F.ceil(F.col("size") / block)
    return (
        signs.select("label", F.explode(prefixes).alias("p")).groupBy("label", "p.bits", "p.prefix", "p.turns").agg(F.count("*").alias("size"))
        .groupBy("label", "bits", "turns").agg(F.sum(size * (size / 2 + window + ROW_COST * copies)).alias("cost"), F.sum("size").alias("rows"))
        .where((F.col("rows") <= window * F.pow(F.lit(2.0), F.col("bits"))) | (F.col("bits") == BITS[-1]))
        .groupBy("label").agg(F.min_by(F.struct("bits", "turns"), F.struct(F.col("cost") * F.col("turns"), "bits")).alias("best"))
        .select("label", "best.bits", "best.turns")
    )


def _links(tables: Tables, classes: DataFrame, plan: DataFrame, similarity: float, block: int, window: int = WINDOW) -> DataFrame:
    """(a, b): for each stretch and crowded run of each pass, links enough to connect what its verified pairs connect."""
    kind = classes.schema["embedding"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()

    def keyed(batches):
        for b in batches:
            x = matrix(b.column("embedding"))
            bits, turns = b.column("bits").to_numpy(), b.column("turns").to_numpy()
            for turn in range(turns.max(initial=0)):
                at = np.flatnonzero(turns > turn)
                key = _signs(x[at], [SEED, 1 + turn], BITS[-1])
                some = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("label"), pa.array(np.full(len(at), turn, np.int32)), pa.array(key),
                        pa.array(key >> (BITS[-1] - bits[at])), some.column("node"), some.column("embedding"),
                    ],
                    ["label", "pass", "key", "prefix", "node", "embedding"],
                )

    keys = (
        classes.select("label", "node", "embedding").join(plan, "label")
        .mapInArrow(keyed, f"label {label}, pass int, key long, prefix long, node long, embedding {kind}")
    )
    hashed = tables.keep(keys)
    order = dense_ordinals(hashed, ["label", "pass", "key", "node"], "at")
    tables.drop(hashed)
    # A stretch of the order, followed by the window of its last row.
    home, columns = F.floor(F.col("at") / STRETCH), ["at", "label", "pass", "node", "embedding"]
    stretches = order.select(*columns, home.alias("stretch"), F.lit(True).alias("own"))
    for before in range(1, -(-window // STRETCH) + 1):
        after = order.where((F.col("at") % STRETCH < window - (before - 1) * STRETCH) & (home >= before))
        stretches = stretches.unionAll(after.select(*columns, (home - before).alias("stretch"), F.lit(False).alias("own")))

    def verified(vectors, i, j, near):
        """Which of the pairs are linked; those close to the threshold are decided by the plain cosine."""
        true = near >= similarity
        narrow = np.abs(near - similarity) <= 1e-9
        true[narrow] = cosines(vectors[i[narrow]], vectors[j[narrow]]) >= similarity
        return i[true], j[true]

    def neighbours(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", ignore_index=True)
        place, turn, node = (group[k].to_numpy() for k in ("at", "pass", "node"))
        label, last = pd.factorize(group["label"])[0], int(group["own"].sum())
        plain = np.array(group["embedding"].tolist(), np.float64)
        vectors, a, b = unit(plain), [], []
        for start in range(0, last, SLICE):
            end = min(start + SLICE, last)
            near = vectors[start:end] @ vectors[start + 1 : end + window].T
            i, j = np.nonzero(near >= similarity - 1e-9)
            near, i, j = near[i, j], start + i, start + 1 + j
            true = (place[j] > place[i]) & (place[j] <= place[i] + window) & (label[i] == label[j]) & (turn[i] == turn[j])
            i, j = verified(plain, i[true], j[true], near[true])
            some = _forest(np.arange(len(node)), i, j)
            a.append(some["a"].to_numpy())
            b.append(some["b"].to_numpy())
        a, b = (np.concatenate(z) if z else np.zeros(0, int) for z in (a, b))
        return _forest(node, a, b)

    bucket = ["label", "pass", "prefix"]
    sizes = tables.keep(order.groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > window + 1))
    # A run longer than a window is cut into blocks by hash, and each block is compared with itself and each other.
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    both = (
        order.join(sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).drop("size"), bucket)
        .withColumn("own", own).select(*bucket, "node", "embedding", "own", other)
        .select(*bucket, "node", "embedding", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own, x, y = (group[k].to_numpy() for k in ("own", "x", "y"))
        node = group["node"].to_numpy()
        plain = np.array(group["embedding"].tolist(), np.float64)
        vectors = unit(plain)
        left, right = np.flatnonzero(own == x[0]), np.flatnonzero(own == y[0])
        a, b = [], []
        for at in range(0, len(left), SLICE):
            rows = left[at : at + SLICE]
            # A block with itself: only what comes after a row.
            to = right[at + 1 :] if x[0] == y[0] else right
            near = vectors[rows] @ vectors[to].T
            i, j = np.nonzero(near >= similarity - 1e-9)
            near, i, j = near[i, j], rows[i], to[j]
            true = (i < j) if x[0] == y[0] else np.ones(len(i), bool)
            i, j = verified(plain, i[true], j[true], near[true])
            some = _forest(np.arange(len(node)), i, j)
            a.append(some["a"].to_numpy())
            b.append(some["b"].to_numpy())
        a, b = (np.concatenate(z) if z else np.zeros(0, int) for z in (a, b))
        return _forest(node, a, b)

    crowded = both.groupBy(*bucket, "x", "y").applyInPandas(compare, "a long, b long")
    return stretches.groupBy("stretch").applyInPandas(neighbours, "a long, b long").unionAll(crowded).distinct()


def _forest(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links from each member of a connected set of rows to the set's least node."""
    root = node.copy()
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        if (low == root).all():
            break
        root = low
    linked = root != node
    return pd.DataFrame({"a": node[linked], "b": root[linked]})


def _counts(tables: Tables, grouped: DataFrame, similarity: float) -> DataFrame:
    """(node, n): weight of all vectors linked with a class, its own included."""
    angle = math.acos(similarity)
    assigned = _centres(tables, grouped, angle)
    centres = tables.keep(
        assigned.groupBy("component", "centre").agg(F.max("angle").alias("radius"), F.sum("weight").alias("total"))
    )
    own = assigned.join(centres.select("centre", "total"), "centre").select("node", F.col("total").alias("n"))
    several = tables.keep(centres.groupBy("component").count().where("count > 1").select("component"))
    if several.isEmpty():
        return own
    members = tables.keep(assigned.join(several, "component", "left_semi"))
    others = tables.keep(
        centres.join(several, "component", "left_semi")
        .join(grouped.select(F.col("node").alias("centre"), F.col("embedding").alias("of_centre")), "centre")
        .withColumnRenamed("centre", "other")
    )

    def judge(c):
        a = np.arccos(np.clip(cosines(matrix(c["embedding"]), matrix(c["of_centre"])), -1, 1))
        radius, total = c["radius"].to_numpy(), c["total"].to_numpy()
        sure = a + radius <= angle - MARGIN
        return {
            "node": c["node"], "other": c["other"], "n": np.where(sure, total, 0),
            "open": ~sure & (a - radius <= angle + MARGIN),
        }

    judged = tables.keep(
        arrow_rows(
            members.join(others, "component").where("centre <> other")
            .select("node", "embedding", "other", "of_centre", "radius", "total"),
            judge, "node long, other long, n long, open boolean",
        ).where("open or n > 0")
    )

    def linked(c):
        return {"node": c["node"], "n": np.where(cosines(matrix(c["x"]), matrix(c["y"])) >= similarity, c["weight"].to_numpy(), 0)}

    single = (
        judged.where("open").select("node", F.col("other").alias("centre"))
        .join(members.select("node", F.col("embedding").alias("x")), "node")
        .join(members.select("centre", F.col("embedding").alias("y"), "weight"), "centre").select("node", "x", "y", "weight")
    )
    more = arrow_rows(single, linked, "node long, n long").unionAll(judged.where("not open").select("node", "n"))
    return own.unionAll(more).groupBy("node").agg(F.sum("n").alias("n"))


def _centres(tables: Tables, grouped: DataFrame, angle: float) -> DataFrame:
    """``grouped`` with the centre of each class, within half the angle of it, and its angle to the centre.

    Each round draws twice as many centres from what is left of a component, so rounds grow with the logarithm of its size.
    """
    done, left, turn = None, grouped, 0

    def near(c):
        return {"node": c["node"], "centre": c["centre"], "angle": np.arccos(np.clip(cosines(matrix(c["embedding"]), matrix(c["of_centre"])), -1, 1))}

    while not left.isEmpty():
        sizes = left.groupBy("component").agg(F.count("*").alias("size"), F.min(F.xxhash64("node", F.lit(turn))).alias("first"))
        drawn = F.xxhash64("node", F.lit(turn))
        chosen = tables.keep(
            left.join(tables.keep(sizes), "component").where(
                (drawn == F.col("first")) | (F.pmod(drawn, F.lit(1 << 30)) < F.lit((2**turn - 1) * (1 << 30)) / F.col("size"))
            ).select("component", F.col("node").alias("centre"), F.col("embedding").alias("of_centre"))
        )
        pairs = left.join(chosen, "component").select("node", "embedding", "centre", "of_centre")
        best = tables.keep(
            arrow_rows(pairs, near, "node long, centre long, angle double")
            .where((F.col("angle") <= angle / 2 - MARGIN) | (F.col("node") == F.col("centre")))
            .groupBy("node").agg(F.min(F.struct((F.col("node") != F.col("centre")).alias("far"), "angle", "centre")).alias("best"))
            .select("node", "best.centre", "best.angle")
        )
        found = left.join(best, "node")
        done = tables.keep(found if done is None else done.unionByName(found))
        left = tables.keep(left.join(best.select("node"), "node", "left_anti"))
        turn += 1
    return done if done is not None else grouped.withColumn("centre", F.col("node")).withColumn("angle", F.lit(0.0))
