import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfield.llm import hard_negatives as module
from inkfield.llm.hard_negatives import Packed, hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 40), st.integers(1, 5), st.integers(0, 28), st.integers(0, 28), st.integers(0, 1000))
def test_packed_scores_are_exact(d, n, m, candidate_bits, anchor_bits, seed):
    rng = np.random.default_rng(seed)
    c = rng.integers(-(2**candidate_bits), 2**candidate_bits + 1, (n, d))
    a = rng.integers(-(2**anchor_bits), 2**anchor_bits + 1, (m, d))
    assert (Packed(c, int(np.abs(a).max())).scores(a) == a @ c.T).all()


def test_small_numbers_share_a_word():
    assert Packed(np.full((10, 64), 100), 100).fields >= 2


def plain(rows, anchor, k=5, lowest=80, highest=100):
    one = {}
    for i, label, x in rows:
        if i is None or label is None or not x or any(c is None or not np.isfinite(c) for c in x):
            continue
        r = (label, [int(np.floor(256 * float(c))) for c in x])
        one[i] = min(one.get(i, r), r)
    out = set()
    for a, (label, x) in one.items():
        if not anchor(a):
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), b, other) for b, (other, y) in one.items() if b != a and len(x) == len(y)]
        for s, p, _ in sorted(t for t in scores if t[2] == label)[:k]:
            hard = sorted(t for t in scores if t[2] != label and lowest * -s <= 100 * -t[0] <= highest * -s)[:k]
            out |= {(a, p, r + 1, b, -s, -t) for r, (t, b, _) in enumerate(hard)}
    return out


def fixture(seed=1, n=900, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, d)) + 0.6
    x = centres[rng.integers(0, 4, n)] + 0.3 * rng.standard_normal((n, d))
    x[2 * n // 3 :] = x[: n - 2 * n // 3]  # copies: equal scores, told apart by vec_id
    labels = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 5, n))
    return [(i, int(k), [float(np.float32(c)) for c in r]) for i, (k, r) in enumerate(zip(labels, x))]


ODD = [
    (2000, None, [1.0] * 6), (2010, 1, None), (2020, 1, []), (2030, 1, [None] + [1.0] * 5), (2040, 1, [float("nan")] * 6),
    (2050, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (2060, 1, [0.0] * 6), (2070, 2, [0.0] * 6), (2080, 1, [1.0, 0.5]),
    (2081, 1, [1.0, 0.5]), (2082, 2, [0.9, 0.5]), (2090, 9, [-1.0] * 6), (20, 3, [0.5] * 6), (2080, 1, [1.0, 0.5]),
]


def test_against_all_pairs(spark, monkeypatch):
    rows = fixture() + ODD
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as rank", "1 as anchor_id", "2 as x").repartition(7)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {r[0] for r in want} >= {20, 2060, 2080}


@pytest.mark.parametrize("few", ["GROUP", "HELD", "ANCHORS", "CANDIDATES"])
def test_blocks_and_groups_do_not_matter(spark, monkeypatch, few):
    monkeypatch.setattr(module, few, 3)
    rows = fixture(2, 200)
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()
    assert {tuple(r) for r in got} == plain(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("rows", [[], ODD[:7], [(10, 1, [1.0])]])
def test_nothing_to_compare(spark, rows):
    out = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert out.collect() == [] and out.columns[0] == "anchor_id"
