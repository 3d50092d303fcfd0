import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from inkfield.llm.packing import pack, plan
from inkfield.llm.token_files import read_figures, read_tokens, round_trip, write_tokens
from inkfield.llm.tokens import tokenizer_path


def ids_of(text):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check(docs, got, capacity):
    want = sorted((str(r["doc_id"]), ids_of(r["text"]).tobytes()) for r in docs.collect())
    by_doc, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[str(r["doc_id"])].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
    assert sum(r["length"] for r in got) == sum(len(b) // 4 for _, b in want)
    for doc, data in want:
        for r in by_doc[doc]:
            part = data[4 * r["start"] : 4 * (r["start"] + r["length"])]
            if sum(d == doc for d, _ in want) == 1:
                assert zlib.crc32(part) == r["ids_crc32"]
    return len(seqs)


def test_documents_are_packed_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = pack(docs).collect()
    n = check(docs, got, 2048)
    assert n <= 1.03 * sum(r["length"] for r in got) / 2048 + 1


def test_odd_documents(odd_documents):
    got = pack(odd_documents).collect()
    check(odd_documents, got, 2048)
    long = sorted((r["piece"], r["length"]) for r in got if r["doc_id"] == 9)
    assert all(n == 2048 for p, n in long if p) and 0 < long[0][1] <= 2048
    assert pack(odd_documents.limit(0)).count() == 0


def test_plan_places_every_piece_once():
    rnd = random.Random(1)
    for _ in range(200):
        top = rnd.choice([16, 100, 2048])
        histogram = {rnd.randint(1, top): rnd.choice([1, 2, 50, 100_000]) for _ in range(rnd.randint(0, 40))}
        places = plan(histogram, top)
        ranks, rooms = defaultdict(list), 0
        for p in places:
            ranks[p.length].append((p.rank, p.count))
            rooms = max(rooms, p.first + -(-p.count // p.each))
        for length, n in histogram.items():
            at = 0
            for rank, count in sorted(ranks[length]):
                assert rank == at
                at += count
            assert at == n
        if sum(histogram.values()) < 2000:
            used = defaultdict(list)
            for p in places:
                for k in range(p.count):
                    used[p.first + k // p.each].append((p.offset + k % p.each * p.length, p.length))
            for s in used.values():
                at = 0
                for offset, n in sorted(s):
                    assert offset == at
                    at += n
                assert at <= top


def test_files_round_trip(spark, sf, odd_documents, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, want = 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = ids_of(r["text"])
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in round_trip(docs).orderBy("doc_id").collect()] == want
    path = str(tmp_path / "tokens")
    write_tokens(odd_documents, path)
    assert read_figures(spark, path).count() == odd_documents.count()
    one = read_tokens(spark, path, 1, 1).collect()
    assert [r["ids"] for r in one] == [ids_of(odd_documents.where("doc_id = 1").first()["text"]).tolist()]
    assert "ids" not in read_figures(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert round_trip(odd_documents.limit(0)).count() == 0
