import hashlib
import random

from tokenizers import Tokenizer

from inkfield.llm.bpe import PairEncoder, RankTree, encode_documents, encoded_digests
from inkfield.llm.tokens import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def test_tree_gives_the_leftmost_least():
    rnd = random.Random(2)
    ranks = [rnd.choice([-1, 3, 5, 9]) for _ in range(37)]
    tree = RankTree(ranks)
    for _ in range(300):
        open_ = [(r, i) for i, r in enumerate(ranks) if r >= 0]
        assert tree.least() == (min(open_)[1] if open_ else -1)
        k, r = rnd.randrange(37), rnd.choice([-1, 1, 3, 5])
        ranks[k] = r
        tree.put(k, r)


def test_words_like_the_library():
    rnd = random.Random(3)
    own, library = PairEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", " ", "don't I'LL", "<|endoftext|>a <|startoftext|>", "x" * 500, "ab" * 100, "ΣΑΣ İ Ʀ Ʋ ẞ", "日本語 １２ ½"]
    texts += ["".join(rnd.choice("abc '!é12ßÑ\n日Ω") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        assert own.encode(t) == e.ids
        assert own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
    words = [w for t in texts for w in own.words(t)]
    assert own.encode_words(words) == [own.encode_word(w) for w in words]


def test_documents(odd_documents):
    library = Tokenizer.from_file(PATH)
    want = []
    for r in odd_documents.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((str(r["doc_id"]), len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    got = [(str(r[0]), *r[1:]) for r in encoded_digests(odd_documents).collect()]
    assert sorted(got) == sorted(want)
    assert encode_documents(odd_documents.where("doc_id = 7")).first()["ids"] == library.encode("one two", add_special_tokens=False).ids
    assert encoded_digests(odd_documents.limit(0)).count() == 0
