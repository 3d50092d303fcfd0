"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from inkfield.llm.common import arrow_rows, of_process
from inkfield.llm.tokens import tokenizer_path

TOKENIZER = "word_bpe_49k.json"
KNOWN_WORDS = 400_000
NONE = 1 << 62

LONG = 128  # symbols above which a word gets a tree of its own; shorter ones are merged side by side

# How the tokenizer's file cuts lower-cased text into words (fixed value), for letters up to U+017F.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_OTHER = re.compile("[^\x00-ſ]")


class RankTree:
    """Least pair rank of a word and its leftmost place, under point updates: each costs the tree's height."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        self.shift = self.size.bit_length()
        # A node is rank and place in one number, so the lesser of two is the lower rank and then the left one.
        leaves = [NONE if r < 0 else r << self.shift | i for i, r in enumerate(ranks)]
        self.nodes = [NONE] * self.size + leaves + [NONE] * (self.size - len(leaves))
        nodes = self.nodes
        for i in range(self.size - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b

    def least(self) -> int:
        """Place of the leftmost pair of the lowest rank, -1 if no pair can be merged."""
        root = self.nodes[1]
        return -1 if root == NONE else root & ((1 << self.shift) - 1)

    def put(self, place: int, rank: int) -> None:
        nodes, i = self.nodes, self.size + place
        nodes[i] = NONE if rank < 0 else rank << self.shift | place
        while i > 1:
            a, b = nodes[i], nodes[i ^ 1]
            i >>= 1
            least = a if a < b else b
            if nodes[i] == least:
                break
            nodes[i] = least


class PairEncoder:
    """Encoder and decoder of a tokenizer's file: normal form, words, pair merges, and the texts of its ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.texts = {i: t for t, i in (self.ids | self.special).items()}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        self.letters = _byte_letters()
        self.bytes = {x: b for b, x in enumerate(self.letters)}
        self.path, self._opened = path, None
        # The same as arrays.
        self.inner = np.array([self.ids[x] for x in self.letters])
        self.last = np.array([self.ids[x + self.suffix] for x in self.letters])
        self.width, self.no_rank = max(self.texts) + 1, len(self.merges) + 1
        keys = np.array([a * self.width + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()])[order]
        self.merged = np.zeros(self.no_rank + 1, np.int64)
        for rank, new in self.merges.values():
            self.merged[rank] = new

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word: of all pairs the leftmost of lowest rank is merged, again and again."""
        letters = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        letters[-1] += self.suffix
        ids = [self.ids[x] for x in letters]
        merges, n = self.merges, len(ids)
        if n == 1:
            return ids
        found = [merges.get((ids[i], ids[i + 1])) for i in range(n - 1)]
        tree = RankTree([f[0] if f else -1 for f in found])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.least()) >= 0:
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, -1)
            if k < n:
                before[k] = i
                pair = merges.get((ids[i], ids[k]))
                tree.put(i, pair[0] if pair else -1)
            else:
                tree.put(i, -1)
            h = before[i]
            if h >= 0:
                pair = merges.get((ids[h], ids[i]))
                tree.put(h, pair[0] if pair else -1)
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of many words; those of like length are merged side by side, each with its own tree."""
        out: list = [None] * len(words)
        letters = [w.encode("utf-8", "surrogatepass") for w in words]
        by_size: dict[int, list[int]] = {}
        for k, b in enumerate(letters):
            by_size.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(k)
        for size, places in by_size.items():
            if size > LONG:
                for k in places:
                    out[k] = self.encode_word(words[k])
                continue
            for at in range(0, len(places), 20_000):
                part = places[at : at + 20_000]
                for k, ids in zip(part, self._side_by_side([letters[k] for k in part], size)):
                    out[k] = ids
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, a large number where there is none; id -1 has no pairs."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], self.no_rank)

    def _side_by_side(self, words: list[bytes], size: int) -> list[list[int]]:
        n = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(-1, size)
        col = np.arange(size)
        ids = np.full((len(words), size + 1), -1, np.int64)
        ids[:, :size] = np.where(col < n[:, None] - 1, self.inner[raw], np.where(col == n[:, None] - 1, self.last[raw], -1))
        after = np.minimum(np.arange(1, size + 2), n[:, None])
        after[after == n[:, None]] = size  # column ``size`` holds no symbol
        before = np.tile(np.arange(-1, size), (len(words), 1))
        none = self.no_rank * size
        nodes = np.full((len(words), 2 * size), none, np.int64)
        leaf = self._rank(ids[:, :-1], ids[:, 1:]) * size + col
        nodes[:, size:] = np.minimum(leaf, none)
        for i in range(size - 1, 0, -1):
            nodes[:, i] = np.minimum(nodes[:, 2 * i], nodes[:, 2 * i + 1])
        open_ = np.flatnonzero(nodes[:, 1] < none)
        while len(open_):
            r, root = open_, nodes[open_, 1]
            i, rank = root % size, root // size
            j = after[r, i]
            k = after[r, j]
            new = self.merged[rank]
            ids[r, i], ids[r, j] = new, -1
            after[r, i] = k
            before[r, k] = i
            h = before[r, i]
            nodes[r, size + j] = none
            nodes[r, size + i] = np.minimum(self._rank(new, ids[r, k]) * size + i, none)
            has = np.flatnonzero(h >= 0)
            nodes[r[has], size + h[has]] = np.minimum(self._rank(ids[r[has], h[has]], new[has]) * size + h[has], none)
            up = [(r, size + i), (r, size + j), (r[has], size + h[has])]
            for _ in range(size.bit_length() - 1):
                up = [(x, at >> 1) for x, at in up]
                for x, at in up:
                    nodes[x, at] = np.minimum(nodes[x, 2 * at], nodes[x, 2 * at + 1])
            open_ = open_[nodes[open_, 1] < none]
        flat, ends = ids[ids >= 0].tolist(), np.cumsum((ids >= 0).sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens, in the tokenizer's normal form."""
        if not _OTHER.search(text):
            return _LATIN_WORDS.findall(text.lower())
        # Normal form and classes of other letters depend on the Unicode version; the library's own count.
        library = self._library()
        pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, p)).decode("utf-8") for p, _ in pieces]

    def _library(self):
        if self._opened is None:
            from tokenizers import Tokenizer

            self._opened = Tokenizer.from_file(self.path)
        return self._opened

    def parts(self, text: str):
        """Words of a text, with each special token as its id between them."""
        at = 0
        for m in self.split.finditer(text):
            yield from self.words(text[at : m.start()])
            yield self.special[m.group()]
            at = m.end()
        yield from self.words(text[at:])

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.parts(text or "") for i in ([p] if isinstance(p, int) else self.encode_word(p))]

    def decode(self, ids: list[int]) -> str:
        """Texts of the ids joined by blanks, as a file without a decoder of its own asks for; special tokens stay."""
        return " ".join(self.texts[i] for i in ids if i in self.texts)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, otherwise the next free one from U+0100."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ids of each row of ``docs`` (doc_id, text); a null text has no ids. Other columns are ignored."""
    def run(c):
        coder = of_process(_Coder, tokenizer)
        return {"doc_id": c["doc_id"], "ids": [list(map(int, ids.split())) for _, ids, _ in coder(c["text"].to_pylist())]}

    return arrow_rows(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def encoded_digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text).

    Hashed are the decimal ids joined by one blank, and the text that the ids decode to. Null and empty texts have no
    ids and the hash of the empty text. Repeated rows and rows without doc_id stay; other columns are ignored.
    """
    def run(c):
        coder = of_process(_Coder, tokenizer)
        out = {"doc_id": c["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for n, ids, decoded in coder(c["text"].to_pylist()):
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
        return out

    return arrow_rows(
        docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


class _Coder:
    """Encodes and decodes texts word by word; at most KNOWN_WORDS words are remembered between calls."""

    def __init__(self, tokenizer: str):
        self.tokenizer, self.encoder, self.known = tokenizer, None, {}

    def __call__(self, texts: list[str | None]):
        """For each text the number of ids, the ids, and the text they decode to."""
        if self.encoder is None:
            self.encoder = PairEncoder(tokenizer_path(self.tokenizer))
        for at in range(0, len(texts), 300):
            yield from self._some(texts[at : at + 300])

    def _some(self, texts: list[str | None]):
        encoder, known = self.encoder, self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        parts = [list(encoder.parts(t)) if "<|" in (t := text or "") else encoder.words(t) for text in texts]
        new = set().union(*parts).difference(known)
        words = [w for w in new if not isinstance(w, int)]
        for w, ids in [(w, [w]) for w in new if isinstance(w, int)] + list(zip(words, encoder.encode_words(words))):
            known[w] = len(ids), " ".join(map(str, ids)), encoder.decode(ids)
        for own in parts:
            if own:
                sizes, ids, decoded = zip(*map(known.__getitem__, own))
                yield sum(sizes), " ".join(ids), " ".join(decoded)
            else:
                yield 0, "", ""
