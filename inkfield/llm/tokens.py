"""Token ids of whole documents by a published byte-level tokenizer, with the end id after each document."""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

END = 0
CHARS_AT_ONCE = 1_000_000

# How byte-level tokenizers cut text into words (fixed value: the published pattern).
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_OTHER = re.compile("[^\x00-ɏ]")


def tokenizer_path(name: str) -> str:
    """Where the tokenizer's file is on the machine that asks; the files come with an installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level tokenizer's file: itself where it prints, else one from U+0100 on."""
    prints = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class DocumentIds:
    """Ids of texts as the tokenizers library gives them, without special tokens added.

    The vocabulary and merges of the tokenizer's file are run by a faster encoder, whose ids are the library's wherever
    merges are numbered in their order, as they are checked to be. Texts with a special token's own text, or with letters
    beyond U+024F, whose classes the two may see differently, are given to the library itself, as are all texts of a file
    of another kind.
    """

    def __init__(self, name: str, end: int = END):
        self.name, self.end, self.library, self.encoder = name, end, None, None

    def _open(self):
        import tiktoken
        from tokenizers import Tokenizer

        path = tokenizer_path(self.name)
        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before, model = file["pre_tokenizer"] or {}, file["model"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if plain and not file["normalizer"] and all(a < b for a, b in zip(merged, merged[1:])):
            of = _printable_bytes()
            ranks = {bytes(map(of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.specials}
            self.encoder = tiktoken.Encoding(self.name, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, the end id after each text's, and the number of each text's ids with it."""
        if self.library is None:
            self._open()
        parts, part, chars = [], [], 0
        for t in texts:
            part.append(t or "")
            chars += len(part[-1])
            if chars > CHARS_AT_ONCE:
                parts.append(self._some(part))
                part, chars = [], 0
        parts.append(self._some(part))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._ids(t) for t in texts]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _ids(self, text: str) -> list[int]:
        if self.encoder is None or _OTHER.search(text) or any(s in text for s in self.specials):
            out = self.library.encode(text, add_special_tokens=False).ids
        else:
            out = self.encoder.encode_ordinary(text)
        out.append(self.end)
        return out
