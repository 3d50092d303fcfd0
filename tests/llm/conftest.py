import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

WORDS = "the of and river stone light paper green under winter table song seven glass north bread cloud music field open".split()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, a long text, copies, near copies, repeated rows, a clashing extra column."""
    import random

    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 400)) for _ in range(n))
    base, long = text(120), text(30_000)
    near = base.split()
    near[5] = "changed"
    rows = [
        (1, base), (2, base.upper()), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "One  two"),
        (9, long), (10, long + " more"), (11, text(80)), (11, "another text under the same id, not alike at all"), (12, text(60)),
        (13, "naïve ﬁ İ ẞ 日本語 👍🏽 <|endoftext|> it's"), (None, text(50)),
    ]
    rows.append(rows[12])
    return spark.createDataFrame([(i, t, "x", "s", 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
