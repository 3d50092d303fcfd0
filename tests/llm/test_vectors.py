import math

import numpy as np
import plain

from inkfield.llm.common import Tables
from inkfield.llm import near_vectors as near_vectors_module
from inkfield.llm.near_vectors import _links, near_vectors, passes
from inkfield.llm.tree_search import fit_tree, nearest


def rows_of(x, labels):
    return [(int(i), [float(v) for v in r], int(label)) for i, (r, label) in enumerate(zip(x, labels))]


def clusters(seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((300, 8))
    x = np.concatenate([x, x[:60] + 0.1 * rng.standard_normal((60, 8)), np.repeat(x[:5], 20, axis=0), x[7] + 0.25 * rng.standard_normal((150, 8))])
    return x.astype(np.float32), np.concatenate([np.arange(300) % 3, np.arange(60) % 3, np.repeat(np.arange(5) % 3, 20), np.full(150, 1)])


SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None, 1), (9002, [0.0] * 8, 1), (9003, [float("nan")] * 8, 1), (9004, [None] + [1.0] * 7, 1), (9005, [1.0] * 8, None), (9006, [float("inf")] * 8, 1)]


def test_near_vectors_against_all_pairs(spark):
    x, labels = clusters()
    y = x.astype(float)
    y /= np.sqrt((y * y).sum(axis=1))[:, None]
    linked = (y @ y.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    component = plain.components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked))])
    df = spark.createDataFrame(rows_of(x, labels) + ODD, SCHEMA).selectExpr("*", "vec_id as component_id")
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert {i: got[i]["n_links"] for i in range(len(x))} == dict(enumerate(linked.sum(axis=1).tolist()))
    assert {i: got[i]["component_id"] for i in range(len(x))} == component
    assert all(got[i]["kept"] == (component[i] == i) for i in range(len(x)))
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, *_ in ODD)


def test_near_vectors_repeated_rows_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (None, [0.0, 1.0], 1)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("3", 1, 3), ("None", 1, 3)]
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def crowded(n=5000, pairs=50, dim=64, seed=3):
    """Rows of mean cosine 0.8 with planted pairs at 0.932: row k of the first ``pairs`` with row n + k."""
    rng = np.random.default_rng(seed)
    normal = lambda a: a / np.sqrt((a * a).sum(axis=1))[:, None]
    x = normal(np.sqrt(0.8) * np.eye(1, dim) + np.sqrt(0.2) * normal(rng.standard_normal((n, dim))))
    away = rng.standard_normal((pairs, dim))
    away = normal(away - (away * x[:pairs]).sum(axis=1)[:, None] * x[:pairs])
    return np.concatenate([x, 0.932 * x[:pairs] + np.sqrt(1 - 0.932**2) * away])


def all_links(x, similarity=0.93):
    y = x / np.sqrt((x * x).sum(axis=1))[:, None]
    linked = y @ y.T >= similarity
    np.fill_diagonal(linked, False)
    return linked


def test_near_vectors_in_a_crowded_region(spark):
    x = crowded()
    linked = all_links(x)
    assert linked.sum() >= 100
    component = plain.components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked))])
    df = spark.createDataFrame(rows_of(x, np.ones(len(x))), "vec_id long, embedding array<double>, label int")
    for block in (8192, 1500):  # one bucket, and a bucket of several blocks
        got = {r["vec_id"]: r for r in near_vectors(df, block=block).collect()}
        assert {i: got[i]["component_id"] for i in got} == component
        assert {i: got[i]["n_links"] for i in got} == dict(enumerate(linked.sum(axis=1).tolist()))


def test_passes_of_several_signs_keep_their_promise(spark):
    x = crowded()
    linked = [(int(a), int(b)) for a, b in zip(*np.nonzero(all_links(x))) if a < b]
    classes = spark.createDataFrame([(i, v, label) for i, v, label in rows_of(x, np.ones(len(x)))], "node long, embedding array<double>, label int")
    plan = spark.createDataFrame([(1, 4, passes(16, 0.93))], "label int, bits int, turns int")
    links = _links(Tables(spark, "test-links"), classes, plan, 0.93, 1000).collect()
    found = plain.components(range(len(x)), [(r["a"], r["b"]) for r in links])
    assert sum(found[a] == found[b] for a, b in linked) >= 0.97 * len(linked)


def test_windows_reach_over_the_ends_of_stretches(spark, monkeypatch):
    monkeypatch.setattr(near_vectors_module, "STRETCH", 50)
    x, labels = clusters()
    linked = all_links(x.astype(float)) & (labels[:, None] == labels[None, :])
    df = spark.createDataFrame(rows_of(x, labels), SCHEMA)
    for window in (400, 20):  # as wide as a label, and shorter than a stretch with several passes
        got = {r["vec_id"]: r for r in near_vectors(df, window=window).collect()}
        pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(linked))]
        found = sum(got[a]["component_id"] == got[b]["component_id"] for a, b in pairs)
        assert found == len(pairs) if window == 400 else found >= 0.99 * len(pairs)
        assert all(got[i]["n_links"] <= linked[i].sum() for i in got)


def exact(rows, queries, k=5):
    out = {}
    for q, v in queries:
        c = []
        for i, x in rows:
            if i != q:
                c.append((-sum(a * b for a, b in zip(v, x)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in x)), i))
        out[q] = sorted(c)[:k]
    return out


def test_search_recall_ties_and_order(spark):
    x, labels = clusters(2)
    rows = rows_of(x, labels)
    df = spark.createDataFrame(rows + ODD + rows[:3], SCHEMA)
    got = nearest(df, df.where("vec_id % 50 = 0 or vec_id > 9000")).collect()
    want = exact([(i, v) for i, v, _ in rows] + [(9005, [1.0] * 8)], [(i, v) for i, v, _ in rows if i % 50 == 0] + [(9005, [1.0] * 8)])
    found = {q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want}
    assert {r["query_id"] for r in got} == set(want)
    assert all([r for r, _, _ in f] == [1, 2, 3, 4, 5] and [s for _, _, s in f] == sorted((s for _, _, s in f), reverse=True) for f in found.values())
    hits = sum(len({i for _, i in want[q]} & {i for _, i, _ in found[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    # Copies have equal scores and come by vec_id.
    copies = [i for _, i, s in found[0] if s > 1 - 1e-12]
    assert copies == sorted(copies)


def test_search_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 2.0], 1)], SCHEMA)
    got = [(r["rank"], r["vec_id"]) for r in nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    assert nearest(few.limit(0), few.limit(0)).count() == 0
    assert nearest(few, few.limit(0)).count() == 0


def test_tree_holds_every_row_and_visits_every_leaf():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 6))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    tree = fit_tree(x, 30)
    leaves = set(np.flatnonzero(tree.count == 0).tolist())
    assert set(tree.leaf_of(x).tolist()) <= leaves
    order = list(tree.leaves(x[0]))
    assert len(order) == len(set(order)) == len(leaves)
    assert len(fit_tree(np.ones((50, 4)), 10).count) == 1
