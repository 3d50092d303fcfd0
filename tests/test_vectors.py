"""Vector search against brute force, index guards, recall, retrieval."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfield.functions import vectors as X
from inkfield.operators import ivf, knn
from inkfield.operators import retrieve as R
from inkfield.operators.encode import HashEncoder, embed_documents, embed_queries
from inkfield.sources.records import uniform_vectors


def frame(spark, x, ids=None):
    rows = [(int(i), [float(e) for e in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>")


def brute(c, q, k, metric, exclude_self=False):
    out = []
    for i, v in enumerate(q.astype(np.float64)):
        x = c.astype(np.float64)
        if metric == "cosine":
            n = np.sqrt((x * x).sum(1)) * np.sqrt((v * v).sum())
            key = -np.where(n > 0, x @ v / np.where(n > 0, n, 1), 0.0)
        else:
            key = ((x - v) ** 2).sum(1)
        key = np.round(key, 9) + 0.0
        order = [j for j in np.lexsort((np.arange(len(x)), key)) if not (exclude_self and j == i)][:k]
        out += [(i, int(j), r + 1) for r, j in enumerate(order)]
    return out


def rows_of(df):
    return sorted((r["query_id"], r["id"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def cloud():
    """Clusters, many exact copies, zero vectors and a common direction at other lengths."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[:60] += 5
    x[100:230] = x[99]
    x[240:250] = 0
    x[250:260] = 2 * x[251]
    return x


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn(spark, cloud, metric, limit, exclude_self):
    df = frame(spark, cloud)
    got = knn.knn(df, df, 7, metric, exclude_self=exclude_self, broadcast_bytes=limit)
    assert rows_of(got) == sorted(brute(cloud, cloud, 7, metric, exclude_self))


def test_knn_large_values(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(300, 8)) * 1000).astype(np.float32)
    df = frame(spark, x)
    assert rows_of(knn.knn(df, df, 3, broadcast_bytes=0)) == sorted(brute(x, x, 3, "l2"))


def test_knn_fewer_rows_than_k(spark):
    x = np.eye(3, dtype=np.float32)
    df = frame(spark, x)
    for limit in (1 << 20, 0):
        assert rows_of(knn.knn(df, df, 5, broadcast_bytes=limit)) == sorted(brute(x, x, 5, "l2"))


def test_knn_text_ids(spark, cloud):
    df = frame(spark, cloud).withColumn("id", F.format_string("v%03d", "id"))
    got = knn.knn(df, df, 3, broadcast_bytes=0)
    assert [(int(q[1:]), int(i[1:]), r) for q, i, r in rows_of(got)] == sorted(brute(cloud, cloud, 3, "l2"))


def test_similar_pairs(spark, cloud):
    got = {(r["id_a"], r["id_b"]): (r["n_a"], r["n_b"]) for r in knn.similar_pairs(frame(spark, cloud), 0.8).collect()}
    x = cloud.astype(np.float64)
    first, count = {}, {}
    for i, v in enumerate(map(tuple, cloud)):
        first.setdefault(v, i)
        count[first[v]] = count.get(first[v], 0) + 1
    reps = sorted(first.values())
    want = {}
    for a in reps:
        for b in reps:
            n = np.linalg.norm(x[a]) * np.linalg.norm(x[b])
            if a < b and n > 0 and round(x[a] @ x[b] / n, 9) >= 0.8:
                want[a, b] = (count[a], count[b])
    assert got == want
    with pytest.raises(ValueError):
        knn.similar_pairs(frame(spark, cloud), 0.0)


def test_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(X.l2("a", "b"), X.squared_l2("a", "b"), X.cosine("a", "b"), X.l2_normalize("a"), X.norm("a")).collect()
    assert tuple(r[0]) == (5.0, 25.0, 0.0, [0.6, 0.8], 5.0)
    assert tuple(r[1]) == (1.0, 1.0, 0.0, [0.0, 0.0], 0.0)


def test_single_query(spark, cloud):
    top = knn.nearest(frame(spark, cloud), [float(v) for v in cloud[99]], 3).collect()
    assert [r["id"] for r in top] == [99, 100, 101] and top[0]["value"] == 0
    order = [r["id"] for r in knn.ranked(frame(spark, cloud), [float(v) for v in cloud[5]]).collect()]
    assert len(order) == 400 and order[0] == 5


def test_full_probe_is_exact_and_recall_grows(spark, cloud):
    df = frame(spark, cloud)
    index = ivf.build(df, lists=8, pq_m=None)
    exact = {(q, i) for q, i, _ in brute(cloud, cloud, 5, "l2")}
    assert {(q, i) for q, i, _ in rows_of(ivf.search(index, df, 5, 8))} == exact
    part = {(q, i) for q, i, _ in rows_of(ivf.search(index, df, 5, 3))}
    assert len(part & exact) / len(exact) > 0.6


def test_product_codes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 4
    x = (centres[rng.integers(0, 20, 1200)] + rng.normal(size=(1200, 16)) * 0.3).astype(np.float32)
    df = frame(spark, x)
    index = ivf.build(df, lists=8, pq_m=8, pq_nbits=6)
    near = rows_of(ivf.search(index, df.where("id < 100"), 10, 4))
    exact = {(q, i) for q, i, _ in brute(x, x[:100], 10, "l2")}
    found = {(q, i) for q, i, _ in near}
    assert len(found & exact) / len(exact) > 0.5
    assert len(near) == 1000


def test_saved_index(spark, cloud, tmp_path):
    df = frame(spark, cloud)
    for m in (None, 4):
        path = str(tmp_path / f"i{m}")
        built = ivf.build(df, lists=4, pq_m=m, pq_nbits=4, path=path)
        assert rows_of(ivf.search(ivf.load(spark, path), df, 3, 2)) == rows_of(ivf.search(built, df, 3, 2))


def test_index_guards(spark, caplog):
    with pytest.raises(ValueError, match="no vectors"):
        ivf.build(frame(spark, np.zeros((0, 4))), lists=2, pq_m=2)
    x = np.random.default_rng(1).random((20, 127))
    with pytest.raises(ValueError, match="dim=127 pq_m=64"):
        ivf.build(frame(spark, x), lists=2, pq_m=64)
    with pytest.raises(ValueError, match="at least one vector per list"):
        ivf.build(frame(spark, x), lists=64, pq_m=None)
    with caplog.at_level(logging.WARNING):
        ivf.build(frame(spark, x[:, :8]), lists=2, pq_m=2, pq_nbits=5)
    assert "20 vectors train 32 codewords" in caplog.text


def test_uniform_vectors_do_not_depend_on_layout(spark):
    a = uniform_vectors(spark.range(0, 50, 1, 1), 4).orderBy("id").collect()
    b = uniform_vectors(spark.range(0, 50, 1, 7), 4).orderBy("id").collect()
    assert a == b and all(0 <= e < 1 for r in a for e in r["embedding"])


def test_encoder(spark):
    enc = HashEncoder(32)
    df = spark.createDataFrame([("b  a\n",), ("",)], "text string")
    a, empty = [np.array(r[0]) for r in embed_documents(df, enc).select("embedding").collect()]
    assert abs(np.linalg.norm(a) - 1) < 1e-6 and not empty.any()
    (q,) = embed_queries(df.limit(1), enc, prompt="a ").select("embedding").first()
    assert q != a.tolist()


class Fixed:
    """Texts to points on a line."""

    dim = 1

    def encode(self, texts):
        return np.array([[float(len(t))] for t in texts])


def test_context(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "b", 0.5, 1)], "query_id int, id string, score double, rank int")
    chunks = spark.createDataFrame([("a", "first result"), ("b", "second result")], "chunk_id string, text string")
    got = {r["query_id"]: r["context"] for r in R.assemble_context(R.payloads(hits, chunks)).collect()}
    assert got == {1: "first result\n\nsecond result", 2: "second result"}


def test_review_rounds(spark):
    rows = [(1, "q1", "REVISE: x\nREFINED_QUERY: better", 0), (2, "q2", "REVISE: x", 1), (3, "q3", "REVISE: x", 2), (4, "q4", "PASS", None)]
    df = spark.createDataFrame(rows, "id int, question string, critic string, critic_iters int")
    got = {r["id"]: (r["verdict"], r["retrieval_query"], r["next_iters"]) for r in R.reviewed(df).collect()}
    assert got == {1: ("REVISE", "better", 1), 2: ("REVISE", "q2", 2), 3: ("PASS", None, 2), 4: ("PASS", None, 0)}


def test_pairs_of_blocks_come_a_bounded_number_at_a_time():
    import numpy as np

    from inkfield.operators import blocks as B

    q = B.prepare(np.ones((3000, 4), np.float32), "cosine", "query")
    c = B.prepare(np.ones((2000, 4), np.float32), "cosine", "corpus")
    parts = [(qi, ci, key) for qi, ci, key in B.block_within(q, c, 1.0, "cosine", -0.9)]
    assert max(len(qi) for qi, _, _ in parts) <= 1_000_000
    pairs = np.concatenate([qi * 2000 + ci for qi, ci, _ in parts])
    assert np.array_equal(np.sort(pairs), np.arange(6_000_000))


def test_visits_of_crowded_cells_come_a_bounded_number_at_a_time(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from inkfield.operators.cells import VISITS_AT_ONCE, CellIndex

    spread = {0: (1.0, 3), 1: (1.0, 40)}
    index = CellIndex(None, np.eye(2, dtype=np.float32), "l2", None, spread)
    rows = spark.range(0, 2000, 1, 1).select("id", F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>").alias("v"))
    visits = index._visits(rows, None, None, 5.0)
    assert visits.count() == 2000 * 43 > 4 * VISITS_AT_ONCE
    found = visits.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("cell", "part").alias("d")).select("n", "d").distinct().collect()
    assert [(r["n"], r["d"]) for r in found] == [(43, 43)]


def test_lists_are_trained_on_a_share(spark, monkeypatch):
    """k-means sees as many rows for each list however many there are; every row is in a list."""
    x = np.random.default_rng(2).standard_normal((3000, 8))
    seen = []
    fit = ivf.KMeans.fit
    monkeypatch.setattr(ivf.KMeans, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    index = ivf.build(frame(spark, x), lists=4, pq_m=None)
    assert 4 <= seen[0] <= 2 * 4 * ivf.TRAIN_ROWS_PER_CENTRE
    assert index.blocks.select(F.sum(F.size("ids"))).first()[0] == 3000
    same = frame(spark, x).withColumn("id", F.lit(0).cast("bigint"))  # ids that repeat are all of the share or none
    assert ivf.build(same, lists=4, pq_m=None).blocks.select(F.sum(F.size("ids"))).first()[0] == 3000


def _shuffles_below_product(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("CartesianProduct") :].count("Exchange") if "CartesianProduct" in plan else None


def test_exact_joins_do_not_move_what_each_query_visits(spark, monkeypatch):
    """on vectors that rule no cell out, all tiles meet, but no visit of a query to a cell is a row that is moved."""
    from inkfield.operators import cells

    monkeypatch.setattr(cells.CellIndex, "_visits", _only_nearest(cells.CellIndex._visits))
    monkeypatch.setattr(cells, "TILE_ROWS", 64)
    x = np.random.default_rng(8).normal(size=(700, 24)).astype(np.float32)
    df = frame(spark, x)
    got = knn.knn(df, df, 4, exclude_self=True, broadcast_bytes=0)
    assert rows_of(got) == sorted(brute(x, x, 4, "l2", True))
    pairs = knn.similar_pairs(df, 0.2)
    assert _shuffles_below_product(pairs) == 1  # tiles are dealt out once
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    a, b = np.nonzero(np.triu(np.round(u @ u.T, 9) >= 0.2, 1))
    found = {(r["id_a"], r["id_b"]): r["score"] for r in pairs.collect()}
    assert set(found) == set(zip(a.tolist(), b.tolist())) and len(a) > 20_000
    assert all(abs(s - u[i] @ u[j]) < 1e-8 for (i, j), s in found.items())


def _only_nearest(visits):
    def run(self, queries, probes, theta, radius):
        assert probes == 1, "visits beyond the nearest cell are not to be rows"
        return visits(self, queries, probes, theta, radius)

    return run


def test_counts_stay_with_their_vector(spark):
    """an id that two vectors share gives each pair once, with the number of its own vector's copies."""
    rows = [(1, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, [1.0, 0.1]), (None, [1.0, 0.2])]
    got = knn.similar_pairs(spark.createDataFrame(rows, "id bigint, embedding array<float>"), 0.5).collect()
    assert sorted((r["id_a"], r["id_b"], r["n_a"], r["n_b"]) for r in got) == [(1, 2, 1, 1), (1, 2, 2, 1)]


@pytest.mark.parametrize("far", [0.0, 1e4, 1e18])
def test_single_precision_leaves_nothing_out(far):
    """Neighbours among vectors far from zero, where single precision tells nothing apart, and with ties."""
    from inkfield.operators import blocks as B
    import pyarrow as pa

    rng = np.random.default_rng(9)
    x = (far + rng.integers(0, 6, size=(900, 5)) * max(1.0, far * 1e-6)).astype(np.float32)
    near = B.Nearest(x[:200], np.full(200, np.inf), 6, "l2")
    for at in range(0, 900, 90):
        near.see(np.arange(200), x[at : at + 90], pa.array(np.arange(at, at + 90)))
    qi, ids, key = near.found
    order = np.lexsort((ids, key, qi))
    want = [(q, i) for q, i, _ in brute(x, x[:200], 6, "l2")]
    assert list(zip(qi[order].tolist(), ids[order].tolist())) == want


@pytest.mark.parametrize("far", [0.0, 1e5, 1e17])
def test_nearest_centres_are_those_of_double_precision(far):
    """centres that single precision does not tell apart, and equal ones, of which the first counts."""
    from inkfield.operators import blocks as B

    rng = np.random.default_rng(13)
    x = far + rng.integers(0, 4, size=(3000, 6)).astype(np.float64) * max(1.0, far * 1e-9)
    c = np.r_[x[:300], x[:20]]
    cell, dist = B.nearest_centre(x, c)
    d = B.squared_distances(x, c)
    assert np.allclose(dist, d.min(axis=1), rtol=1e-12, atol=1e-15 * far * far)
    if not far:
        assert (cell == d.argmin(axis=1)).all()
    else:
        assert np.allclose(d[np.arange(len(x)), cell], d.min(axis=1), atol=1e-13 * far * far)


def test_few_queries_are_searched_where_the_lists_lie(spark, monkeypatch):
    """for a few hundred questions the lists are not shuffled, and hits are those of the join of visits and lists."""
    from inkfield.operators import cells

    x = np.random.default_rng(14).normal(size=(900, 12)).astype(np.float32)
    df = frame(spark, x)
    index = ivf.build(df, lists=20, pq_m=None)
    few = df.where("id % 9 = 0")
    plan = index.scan(knn.plain(few, "id", "embedding"), 3, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = rows_of(ivf.search(index, few, 3, 7))
    monkeypatch.setattr(ivf, "HELD_QUERIES", 0)
    monkeypatch.setattr(cells.CellIndex, "scan", None)
    assert got == rows_of(ivf.search(index, few, 3, 7)) and len(got) == 300


def test_blanks_are_tidied_as_before(spark):
    from inkfield.functions.text import normalize_text

    texts = ["a b", " a  b ", "a\t b", "a \tb", "\ta\t\tb\t", "a \n b", "  \n\n\n\n a   ", "a\u00a0 b", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_text("t")).collect()
    assert [r[0] for r in rows] == ["a b", "a b", "a b", "a b", "a b", "a\nb", "a", "a b", ""]
