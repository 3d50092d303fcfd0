import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from inkfield.llm.tokens import DocumentIds, tokenizer_path

LETTERS = "abcdefghijklmnopqrstuvwxyzABCXYZ   \n\t\r0123456789.,;:!?'\"-_()[]{}<>|éèüñßøÆªµ²¼\x85\xa0\x1c\x1f\x00\x7f"
WHOLE = ["", " ", "\n\n a", "it's we'll DON'T", "日本語 text", "<|endoftext|>", "a <|endoftext|> b", "👍🏽", "ɏɐ", "x" * 5000, " " * 3000, "7" * 2000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    rnd = random.Random(1)
    texts = WHOLE + ["".join(rnd.choice(LETTERS) for _ in range(rnd.choice((3, 10, 60, 300)))) for _ in range(3000)]
    ids, sizes = DocumentIds(name, end=7)(texts + [None])
    library = Tokenizer.from_file(tokenizer_path(name))
    want = [e.ids + [7] for e in library.encode_batch(texts, add_special_tokens=False)] + [[7]]
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == want


def test_no_texts():
    ids, sizes = DocumentIds("byte_bpe_50k.json")([])
    assert len(ids) == len(sizes) == 0
