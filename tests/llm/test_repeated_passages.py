import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkfield.llm.repeated_passages import Sizes, _bytes, _pieces, _ranks, _runs, digests, without_repeats
from inkfield.llm.word_hashes import Runs, hashes, lowest_in_windows, words

SCHEMA = "doc_id long, text string, kept_sha256 string, spans int, t1 string"


def plain(texts, window):
    own = [(t or "").encode("utf-8").split() for t in texts]
    found = Counter(tuple(w[k : k + window]) for w in own for k in range(len(w) - window + 1))
    out = []
    for w in own:
        gone = {j for k in range(len(w) - window + 1) if found[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["naïve", "日本語", "x" * 200, "<|end|>", "A", "a"]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    line, passage, long = some(12), some(60), some(6000)
    texts = [" ".join(some(rnd.randint(0, 120))) for _ in range(60)]
    texts += [" ".join(some(20) + line + some(20)) for _ in range(40)]  # a line shorter than a window, in many places
    texts += [" ".join(some(10) + passage + some(30)) for _ in range(5)] + [" ".join(passage[:35]), " ".join(passage[:34])]
    texts += [texts[3]] * 20 + [texts[4] + " more", texts[5].replace(" ", "\n\t ")]
    texts += [" ".join(long), " ".join(long[:3000] + some(1) + long[3000:]), " ".join(some(50) * 3)]
    texts += ["same " * 90, "one two " * 40, "", "  \t\n", None, " ".join(some(80)), "x" * 100_000]
    return texts


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(slice_bytes=700, bucket=300, crowded=150), Sizes(window=10, seed=3, bucket=50, crowded=40)])
def test_against_plain(spark, sizes):
    texts = corpus()
    rows = [(k % 50 if k % 7 else None, t, "clash", k, "u") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], SCHEMA).repartition(6)
    got = Counter(tuple(r) for r in digests(df, sizes).collect())
    want = Counter((i, *p) for (i, *_), p in zip(rows + rows[:2], plain(texts + texts[:2], sizes.window)))
    assert got == want


def test_texts_are_returned(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, "before " + text + "  after\nthe end"), (2, text), (3, None)]
    got = {r["doc_id"]: r["text"] for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "before after the end", 2: "", 3: ""}


def test_empty_table(spark):
    assert digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_words_and_runs_have_equal_hashes():
    data = np.frombuffer(b"ab abc ab  abc\nab \xc3\xa9 " + b"y" * 300 + b" ab abc " + b"y" * 300, np.uint8)
    first, last = words(data)
    assert [bytes(data[a:b]) for a, b in zip(first, last)] == bytes(data).split()
    h = hashes(data, first, last)
    own = bytes(data).split()
    for side in h:
        assert len(set(side.tolist())) == len(set(own)) and dict(zip(own, side.tolist())) == {w: v for w, v in zip(own, side.tolist())}
    assert [s[1] for s in h] == [s[0] for s in hashes(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3]))]  # beside no long word
    runs = Runs(h)
    pair = runs(np.arange(len(own) - 1), 2, 0).tolist()
    assert pair[0] == pair[2] == pair[7] and len(set(pair)) == len({tuple(own[k : k + 2]) for k in range(len(own) - 1)})


def test_lowest_in_windows():
    h = np.random.default_rng(0).integers(0, 1000, 100)
    for width in (1, 2, 7, 28, 100):
        assert lowest_in_windows(h, width).tolist() == [h[k : k + width].min() for k in range(100 - width + 1)]


def test_ranks_tell_runs_apart():
    codes = np.random.default_rng(1).integers(0, 2, 300).astype(np.int64)
    at = np.arange(300 - 11 + 1)
    ranks = _ranks(codes, 11, at).tolist()
    seen = {}
    assert all(seen.setdefault(tuple(codes[k : k + 11]), r) == r for k, r in zip(at, ranks)) and len(set(ranks)) == len(seen)


def test_slices_of_any_size_hold_every_window_once():
    texts = [t or "" for t in corpus()]
    data, offsets = _bytes(pa.array(texts))
    for size in (200, 5000, 1 << 20):
        sizes, seen = Sizes(slice_bytes=size), Counter()
        for which, number, first, last, counts in _pieces(data, offsets, sizes):
            found = _runs(hashes(data, first, last), counts, sizes)
            if found is None:
                continue
            ends = np.cumsum(counts)
            for start, n in zip(found[0], found[1]):
                t = int(np.searchsorted(ends, start, "right"))
                seen.update((int(which[t]), int(start - ends[t] + counts[t] + number[t]) + k) for k in range(n))
        want = {(t, k) for t, x in enumerate(texts) for k in range(len(x.encode().split()) - 34)}
        assert set(seen) == want and max(seen.values()) == 1
