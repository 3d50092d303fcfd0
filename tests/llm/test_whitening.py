from fractions import Fraction

import numpy as np
import pytest

from inkfield.llm.bidiagonal import dqds, right_singular
from inkfield.llm.whitening import whiten


def matrices():
    rng = np.random.default_rng(0)
    turn, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    ramp = np.abs(np.arange(21) - 10.0) + 20
    yield "one column", rng.standard_normal((9, 1))
    yield "tall", rng.standard_normal((200, 33))
    yield "wide", rng.standard_normal((5, 20))
    yield "graded", rng.standard_normal((100, 30)) * np.geomspace(1, 1e-8, 30)
    yield "equal values", np.diag([3.0, 3, 3, 1, 1, 0, 0])
    yield "close values", (turn * np.r_[np.ones(15), np.full(15, 2), np.full(10, 1 + 1e-9)]) @ turn.T
    yield "pairs closer than rounding", np.linalg.cholesky(np.diag(ramp) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T
    yield "almost identity", np.eye(8) + 1e-13 * rng.standard_normal((8, 8))
    yield "rank one", np.ones((10, 6))
    yield "all zero", np.zeros((5, 4))


@pytest.mark.parametrize("name, r", list(matrices()))
def test_right_singular(name, r):
    values, v = right_singular(r)
    want = np.zeros(r.shape[1])
    found = np.linalg.svd(r, compute_uv=False)
    want[: len(found)] = found
    size = max(want[0], 1)
    assert np.abs(values - want).max() <= 1e-14 * size * max(r.shape)
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-11
    assert np.abs(r.T @ (r @ v) - v * values**2).max() < 1e-12 * size**2


def test_dqds_small_values_keep_their_digits():
    # B = [[1, 1], [0, t]]: the smaller squared value is t*t / (larger one), far below the rounding of B'B
    t = 1e-12
    low, high = np.sort(dqds(np.array([1.0, t * t]), np.array([1.0])))
    assert abs(high - 2) < 1e-12 and abs(low / (t * t / 2) - 1) < 1e-12


def fixture(seed=3, n=400, d=7):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) * [3, 2, 1.5, 1, 0.5, 0.2, 0]).astype(np.float32)
    return np.concatenate([x, x[:50], x[:3]])


ODD = [(901, None), (902, []), (903, [None] + [1.0] * 6), (904, [float("nan")] * 7), (905, [float("inf")] * 7), (906, [1.0, 2.0]), (907, [3e38] * 7)]


def test_whiten_against_plain(spark):
    x = fixture()
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)] + ODD + [(None, [float(c) for c in x[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as component", "'x' as n").repartition(5)
    got = whiten(df).collect()
    whole = np.floor(64 * x.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(whole, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert {r["component"] for r in got} == set(range(1, 7))  # the last place never varies
    assert len(got) == 6 * (len(x) + 1) and {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(6):
        want = (whole - s / n) @ axes[:, k] / np.sqrt(values[k])
        have = np.array([by[i, k + 1]["whitened"] for i in range(len(x))])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert abs(by[0, k + 1]["explained"] / (values[k] / values.sum()) - 1) < 1e-10
    for i in (0, 17, 449):
        exact = sum((Fraction(int(a)) * n - int(b)) ** 2 for a, b in zip(whole[i], s))
        assert by[i, 1]["deviation"] == exact
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10
    assert by[None, 1]["whitened"] == by[0, 1]["whitened"]


def test_many_factors_are_joined_in_levels(spark):
    x = fixture(n=300)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(70)
    spark.conf.set("spark.sql.shuffle.partitions", 70)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = whiten(df, 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 3 * len(x) and got[0]["identity_error"] < 1e-10


@pytest.mark.parametrize("rows", [[], ODD[:5], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whiten_nothing_to_fit(spark, rows):
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.collect() == [] and out.columns[:3] == ["vec_id", "component", "n"]


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(i) * 2.0**30, 1.0]) for i in range(10)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 and got[0]["deviation"] is None
