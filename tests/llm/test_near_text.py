import itertools
import random
from collections import defaultdict

import numpy as np
import plain
import pytest

from inkfield.llm.near_text import Settings, near_duplicates, one_of_each
from inkfield.llm.near_vectors import passes
from inkfield.llm.shingles import Collections, WordHashes, shingle_set, words_of


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets, component = plain.near_texts(texts, 4)
    got = {r["doc_id"]: r for r in near_duplicates(docs, Settings(words=4)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == component
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (component[i] == i) for i, r in got.items())


def test_odd_documents(odd_documents):
    got = sorted(((r["doc_id"] or 0, r["component_id"], r["n_shingles"] > 0, r["kept"]) for r in near_duplicates(odd_documents).collect()), key=str)
    assert got == sorted(
        [
            (1, 1, True, True), (2, 1, True, False), (3, 1, True, False), (4, 4, False, True), (5, 5, False, True), (6, 6, False, True),
            (7, 7, True, True), (8, 7, True, False), (9, 9, True, True), (10, 9, True, False), (11, 11, True, True), (11, 11, True, True),
            (12, 12, True, True), (12, 12, True, True), (13, 13, True, True), (0, None, True, True),
        ],
        key=str,
    )


def test_one_of_each_keeps_columns(odd_documents):
    out = one_of_each(odd_documents)
    assert out.columns == odd_documents.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 9, 11, 11, 12, 13, None]))


def test_chain_across_many_near_copies(spark):
    """Every text is similar to the next alone, and many share most words."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[: 200 - 6 * k] + [f"x{k}{j}" for j in range(6 * k)])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, component = plain.near_texts(dict(rows), 5)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == component


def template_texts(n=200, twins=20, slots=200, own=18, more=25, seed=6):
    """Texts of one template, similar to each other by some 0.75, and twins of the first at 0.81."""
    rnd = random.Random(seed)

    def changed(words, k, name):
        free = [p for p in range(0, 6 * slots, 6) if words[p].startswith("w")]
        return [f"{name}x{p}" if p in at else w for at in [set(rnd.sample(free, k))] for p, w in enumerate(words)]

    base = [f"w{k}" for k in range(6 * slots)]
    texts = [changed(base, own, f"d{i}") for i in range(n)]
    return {i: " ".join(w) for i, w in enumerate(texts + [changed(texts[i], more, f"t{i}") for i in range(twins)])}


@pytest.mark.parametrize("block", [10_000_000, 60_000])
def test_links_of_crowded_buckets(spark, block):
    """With a single table, all linked pairs of its buckets are found, though few are the leader's."""
    texts = template_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    hashes, draw = WordHashes(), Collections(1, 1)
    sets = {i: shingle_set(words_of(t), hashes) for i, t in texts.items()}
    buckets = defaultdict(list)
    for i, s in sets.items():
        buckets[tuple(draw(s).tolist())].append(i)
    pairs = [(a, b) for m in buckets.values() for a, b in itertools.combinations(m, 2)]
    size = lambda a, b: len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    links = [(a, b) for a, b in pairs if 180 * size(a, b) >= 80 * (len(sets[a]) + len(sets[b]))]
    component = plain.components(texts, links)
    assert len(links) >= 8
    got = near_duplicates(docs, Settings(groups=1, rows=1), block=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == component


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0
    assert one_of_each(docs).count() == 0


def test_more_rows_need_more_passes():
    assert passes(100, 0.93) <= passes(10_000, 0.93) <= passes(10**9, 0.93)


def test_only_sets_of_compared_classes_are_moved(spark):
    """Of the side of the leaders, too, only the sets of those that lead are joined."""
    import numpy as np

    from inkfield.llm import near_text
    from inkfield.llm.common import Tables

    of = lambda *x: np.array(x, np.uint64).tobytes()
    sets = spark.createDataFrame([(b"a", of(1, 2, 3)), (b"b", of(1, 2, 4)), (b"c", of(5))], "node binary, shingles binary")
    pairs = spark.createDataFrame([(b"a", b"b")], "a binary, b binary")
    tables, plans = Tables(spark, "moved"), []
    keep = tables.keep
    tables.keep = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df)
    got = near_text._compared(tables, pairs, sets).collect()
    assert [(bytes(r["a"]), bytes(r["b"]), r["common"], r["whole"]) for r in got] == [(b"a", b"b", 2, 4)]
    assert "LeftSemi" in plans[-1]


def test_one_of_the_buckets_with_the_same_classes_is_kept(spark):
    """Every pair that shares a bucket shares one that is kept, and its first one."""
    from inkfield.llm import near_text
    from inkfield.llm.common import Tables

    rnd = random.Random(9)
    base = [[f"w{rnd.randint(0, 10**6)}" for _ in range(200)] for _ in range(20)]
    texts = [" ".join([*b[: 100 + 7 * k], f"x{k}", *b[100 + 7 * k :]]) for b in base for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings = Settings()
    tables = Tables(spark, "buckets")
    signed = near_text._signed(docs, settings).withColumnsRenamed({"n_shingles": "n"})
    groups = {bytes(r["node"]): r["groups"] for r in signed.collect()}
    got = defaultdict(set)
    for r in near_text._shared_keys(tables, signed, settings).collect():
        got[r["key"], r["place"]].add(bytes(r["node"]))
    members = [frozenset(m) for m in got.values()]
    assert len(members) == len(set(members)) and min(map(len, members)) > 1
    g, pairs = settings.groups, 0
    for a, b in itertools.combinations(groups, 2):
        same = [x == y for x, y in zip(groups[a], groups[b])]
        if any(same[:g]) and any(same[g:]):
            pairs += 1
            first = same.index(True) * g + same.index(True, g) - g
            assert any(place == first and {a, b} <= m for (_, place), m in got.items())
    assert pairs >= 60


def test_counts_of_shingles_bound_what_sets_share(spark):
    """Pairs whose counts show that they are no links are not compared; no link is lost, by long texts neither."""
    from inkfield.llm import near_text
    from inkfield.llm.common import Tables

    rnd = np.random.default_rng(3)
    draw = lambda n: np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
    sets = {}
    for k, n in enumerate([40, 400, 120_000]):
        base = draw(n)
        sets |= {f"{k}a": base, f"{k}b": np.union1d(base[n // 10 :], draw(n // 20)), f"{k}c": draw(n)}
    rows = [(k.encode(), s.tobytes(), near_text.counted(s)) for k, s in sets.items()]
    table = spark.createDataFrame(rows, "node binary, shingles binary, counts binary")
    pairs = [(f"{k}a".encode(), f"{k}{x}".encode()) for k in range(3) for x in "bc"]
    got = near_text._possible(Tables(spark, "counts"), spark.createDataFrame(pairs, "a binary, b binary"), table, 80).collect()
    got = {(bytes(r["a"]).decode(), bytes(r["b"]).decode()) for r in got}
    assert {(f"{k}a", f"{k}b") for k in range(3)} <= got
    assert ("0a", "0c") not in got and ("1a", "1c") not in got


def test_connected_groups_make_no_keys(spark):
    """Near copies that the rounds connect are not combined to table keys, and rows with equal text are read once."""
    from inkfield.llm import near_text

    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(300)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k:]]) for k in range(10, 290, 7)]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    made, shared_keys = [], near_text._shared_keys
    near_text._shared_keys = lambda *x: made.append(shared_keys(*x).count()) or shared_keys(*x)
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    finally:
        near_text._shared_keys = shared_keys
    assert got == dict.fromkeys(range(len(texts)), 0)
    assert made == [0]
