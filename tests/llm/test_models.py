import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import plain
import pytest

from inkfield.llm import attention, language_model, toxicity
from inkfield.llm.html_blocks import blocks_of
from inkfield.llm.html_extract import extract
from inkfield.llm.string_kernel import Landmarks, vectors

BAD = ["grumblet", "snorkwit", "plonkard"]


def labelled(n, seed=1):
    rnd = random.Random(seed)
    plainly = ["".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(plainly) for _ in range(rnd.randint(5, 60))]
        toxic = int(rnd.random() < 0.3)
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_kernel_is_the_cosine_of_subsequence_vectors():
    words = ["moron", "mo-ron", "morron", "x", "", "ö", "moronic", "table"]
    v = vectors(words)
    dot = lambda a, b: sum(x * b.get(c, 0.0) for c, x in a.items())
    k, at = Landmarks(["moron", "table"]).kernel(words)
    full = np.zeros((len(words), 2))
    full[at] = k
    for i, a in enumerate(v):
        for j, b in enumerate(vectors(["moron", "table"])):
            want = dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) if a and b else 0.0
            assert abs(full[i, j] - want) < 1e-5
    assert full[1, 0] == pytest.approx(1.0, abs=1e-5) and full[2, 0] > 0.5 > full[7, 0]


def test_toxicity_on_held_out_texts(spark):
    docs, labels = labelled(600)
    d = spark.createDataFrame(docs + [(1000, None), (1001, ""), (1002, "you g r u m b l e t you"), (1003, "SNORK-WIT!")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, _, y in labels if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003)] == [0, 0, 1, 1]


def test_a_fit_holds_each_word_once(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(2000)]
    texts = [" ".join(rnd.choices(words, k=400) + [BAD[i % 3]] * (i % 2)) for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    tracemalloc.start()
    model = toxicity.fit(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(BAD) <= set(model.landmarks)
    assert most < 4 * sum(map(len, texts))  # each text's words as texts of their own take 11 times as much


def test_toxicity_odd_input(spark, odd_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(odd_documents, none).collect()} == {0}
    out = toxicity.without_toxic(odd_documents, none)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    assert toxicity.toxicity(odd_documents.limit(0), none).count() == 0


PAGE = (
    "<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Home {k}</a></li>"
    "<li><a href=/b>News</a></li></ul></nav><!-- x --><div class='ad'>Buy {b} today.</div><article><h1>Title {a}</h1><p><b>{a} first\n  part"
    "<br>goes on &amp; on.<p>{b} second part, with more.</p></article><footer>&copy; {k} site.</footer></body></html>"
)


def test_blocks():
    got = [(b.path[-1][0], b.text) for b in blocks_of(PAGE.format(a="A", b="B", k=1))]
    assert got == [
        ("li", "Home 1"), ("li", "News"), ("div", "Buy B today."), ("h1", "Title A"), ("p", "A first part goes on & on."),
        ("p", "B second part, with more."), ("footer", "© 1 site."),
    ]
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> </p><script>x") == []
    assert [b.text for b in blocks_of("a < b <p title='>'>c<div")] == ["a < b", "c<div"]


def test_main_text(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = [(i, "u", PAGE.format(a=" ".join(word() for _ in range(20)), b=" ".join(word() for _ in range(30)), k=i)) for i in range(60)]
    df = spark.createDataFrame(rows + [(100, None, None), (101, "u", ""), (5, "u", rows[5][2])], "page_id long, url string, html string")
    got = extract(df).collect()
    assert len(got) == 63
    for r in got:
        if r["page_id"] >= 100:
            assert (r["text"], r["n_chars"]) == ("", 0)
        else:
            want = [b.text for b in blocks_of(rows[r["page_id"]][2]) if b.path[-1][0] in ("h1", "p")]
            assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"])
    assert extract(df.limit(0)).count() == 0


def test_windows_score_each_position_once():
    for n in (1, 7, 32, 33, 100, 333):
        first, text, seen = attention.windows(np.array([n, 5]))
        got = Counter(
            (t, f + p) for f, t, s in zip(first.tolist(), text.tolist(), seen.tolist()) for p in range(s, attention.WINDOW) if f + p < [n, 5][t]
        )
        assert got == Counter({**{(0, k): 1 for k in range(n)}, **{(1, k): 1 for k in range(5)}})


def test_attention_gradients_and_normal_form():
    rng = np.random.default_rng(1)
    w = attention.Weights.drawn(rng)
    for x in w.all():
        x *= 0.5
    rows, kind = rng.integers(0, 50, (2, attention.WINDOW)), rng.integers(0, 40, (2, attention.WINDOW))

    def loss():
        z = attention._forward(w, rows)[-1].astype(float)
        return float(-(np.take_along_axis(z, kind[:, :, None], 2)[:, :, 0] - np.log(np.exp(z).sum(axis=2))).sum())

    state = attention._forward(w, rows)
    p = np.exp(state[-1])
    p /= p.sum(axis=2, keepdims=True)
    np.put_along_axis(p, kind[:, :, None], np.take_along_axis(p, kind[:, :, None], 2) - 1, 2)
    for x, g in zip(w.all(), attention._backward(w, rows, state, p)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        x[at] += 1e-2
        up = loss()
        x[at] -= 2e-2
        down = loss()
        x[at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=0.02)
    # A later id changes nothing before it.
    other = rows.copy()
    other[:, 20:] = 3
    assert np.allclose(attention._forward(w, other)[-1][:, :20], state[-1][:, :20], atol=1e-5)
    v = attention.Vocabulary.of(np.r_[rng.integers(0, 1000, 3000).astype(float)])
    assert np.bincount(v.kind, np.exp(v.within), attention.CLASSES) == pytest.approx(np.ones(attention.CLASSES), abs=1e-3)


def test_language_model_scores(spark, sf, odd_documents, monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 40)
    monkeypatch.setattr(language_model, "HEAD_WORDS", 50)  # so that most words go the way of the rare ones
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text").where("doc_id <> 9 or doc_id is null"))
    rows = docs.collect()
    key = lambda i: "" if i is None else str(i)
    train = [plain.words(r["text"]) + [None] for r in rows if zlib.crc32(key(r["doc_id"]).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        t = plain.words(r["text"]) + [None]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[key(r["doc_id"]), zlib.crc32(key(r["doc_id"]).encode()) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n, round(base, 5)] += 1
    got = language_model.scores(docs, fit_rows=100).collect()
    assert Counter((key(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert language_model.scores(docs.limit(0)).count() == 0


def test_attention_learns_from_rows_beyond_the_sample(spark):
    ids_of = language_model.DocumentIds(language_model.TOKENIZER, language_model.END)
    counts = np.zeros(language_model.IDS)
    text = "red fish blue fish one fish two fish " * 20
    ids, sizes = ids_of([text])
    np.add.at(counts, ids, 1)
    vocabulary = attention.Vocabulary.of(counts)
    start = attention.fit(*ids_of(["blue two one"]), vocabulary, language_model.END, steps=1)
    training = spark.createDataFrame([(text,)] * 400 + [(None,), ("",)], "text string").repartition(3)
    after = language_model.learned(training, start, vocabulary)
    better, worse = (attention.log10_probability(w, vocabulary, ids, sizes, language_model.END)[0] for w in (after, start))
    assert better > worse + 10
    again = language_model.learned(training.limit(0), start, vocabulary)
    assert all(np.array_equal(x, y) for x, y in zip(again.all(), start.all()))
