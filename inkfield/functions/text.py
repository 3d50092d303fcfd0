"""Text functions as column expressions; only Unicode normalisation needs Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield import config
from inkfield.functions.batches import pieces

# Python str.strip() removes U+001C..U+001F too, Java \s does not.
_WS = r"[\s\x1c-\x1f]"
_LINE_WS = r"[\s\x1c-\x1f&&[^\n]]"

# Fixed pattern: calendar date, optional time, optional zone; no range check.
ISO_DATE = r"(?U)\A\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?\z"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c) -> Column:
    """Strip all Unicode whitespace from both ends (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(col(c), rf"(?U)\A{_WS}+|{_WS}+\z", "")


def to_nfkc(s: str | None) -> str | None:
    if s is None or s.isascii():
        return s
    return unicodedata.normalize("NFKC", s)


@F.arrow_udf(T.StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode NFKC over Arrow batches; ASCII rows pass untouched."""
    for b in batches:
        for a in pieces(b):
            yield pa.array([to_nfkc(s) for s in a.to_pylist()], pa.string())


def tidy_whitespace(c) -> Column:
    """Everything of ``normalize_text`` after NFKC, inside the JVM."""
    c = F.translate(col(c), "\x00", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"\t[ \t]*| [ \t]+", " ")  # a single blank is not matched, as nothing changes
    c = F.regexp_replace(c, rf"(?Umd)^{_LINE_WS}+|{_LINE_WS}+$", "")
    c = pystrip(c)
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def normalize_text(c) -> Column:
    """NFKC, NUL removal, newline and blank clean-up; null becomes the empty string."""
    return tidy_whitespace(nfkc(F.coalesce(col(c), F.lit(""))))


def is_iso_date(c) -> Column:
    return pystrip(c).rlike(ISO_DATE)


def is_blank(c) -> Column:
    return F.coalesce(pystrip(c), F.lit("")) == ""


def retrieval_query(refined, question) -> Column:
    """The refined query when it says anything, else the question."""
    return F.coalesce(F.nullif(pystrip(refined), F.lit("")), F.coalesce(col(question), F.lit("")))


def with_query_prompt(c, prompt: str = config.QUERY_PROMPT) -> Column:
    """Queries carry a prompt in front of the normalised text; documents do not."""
    return F.concat(F.lit(prompt), normalize_text(c))


def truncate_context(c, limit: int = config.CONTEXT_MAX_CHARS) -> Column:
    return F.substring(col(c), 1, limit)


def keyword(c, limit: int = config.KEYWORD_MAX_CHARS) -> Column:
    """The exact-match form of a text field: null where the text is too long for one."""
    return F.when(F.length(col(c)) <= limit, col(c))


def file_stem(path) -> Column:
    """Last path component without its last suffix; a leading dot is no suffix."""
    base = F.element_at(F.split(F.regexp_replace(col(path), r"/+\z", ""), "/"), -1)
    return F.regexp_replace(base, r"(?s)\A(.+)\.[^.]+\z", "$1")


def _required(c: Column, source, what: str) -> Column:
    return F.when(c != "", c).otherwise(
        F.raise_error(F.concat(F.lit(f"cannot derive {what} from: "), F.coalesce(col(source), F.lit("null"))))
    )


def index_name(path, on_empty: str = "error") -> Column:
    """File name to index name: lower case, other characters to ``_``, edge ``._-`` removed."""
    c = F.regexp_replace(F.lower(file_stem(path)), r"[^a-z0-9._-]+", "_")
    c = F.regexp_replace(c, r"\A[._-]+|[._-]+\z", "")
    return _required(c, path, "index name") if on_empty == "error" else F.nullif(c, F.lit(""))


def sql_name(c, prefix: str) -> Column:
    c = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9_]+", "_")
    c = F.regexp_replace(c, r"\A_+|_+\z", "")
    return F.when(c.rlike(r"\A[0-9]"), F.concat(F.lit(prefix), c)).otherwise(c)


def table_name(path, on_empty: str = "error") -> Column:
    c = sql_name(file_stem(path), "t_")
    return _required(c, path, "table name") if on_empty == "error" else F.nullif(c, F.lit(""))


def column_name(key, on_empty: str = "error") -> Column:
    c = sql_name(key, "f_")
    return _required(c, key, "column name") if on_empty == "error" else F.nullif(c, F.lit(""))


def plan_steps(raw) -> Column:
    """Steps of a plan text: ``###`` separated, else at most three numbered items."""
    raw = pystrip(F.coalesce(col(raw), F.lit("")))
    said = lambda a: F.filter(F.transform(a, pystrip), lambda s: s != "")
    steps = said(F.split(raw, "###"))
    numbered = said(
        F.regexp_extract_all(
            raw, F.lit(rf"(?msdU)^{_WS}*\d+\){_WS}*(.+?)(?=^{_WS}*\d+\){_WS}*|\z)"), F.lit(1)
        )
    )
    recovered = F.slice(numbered, 1, 3)
    return F.when((F.size(steps) <= 1) & (F.size(numbered) >= 2), recovered).otherwise(steps)


def critic_refined_query(raw) -> Column:
    t = pystrip(F.coalesce(col(raw), F.lit("")))
    return pystrip(F.regexp_extract(t, rf"(?imdU)^REFINED_QUERY:{_WS}*(.+)$", 1))


def critic_verdict(raw) -> Column:
    """PASS or REVISE; a PASS line wins over REVISE, anything else is PASS."""
    t = pystrip(F.coalesce(col(raw), F.lit("")))
    passed = t.rlike(rf"(?imdU)^{_WS}*PASS{_WS}*$") | t.rlike(rf"(?iU)\A{_WS}*PASS{_WS}*(\n|\z)")
    revise = t.rlike(rf"(?imdU)^{_WS}*REVISE{_WS}*:") | F.upper(t).contains("REVISE:")
    return F.when(passed, "PASS").when(revise, "REVISE").otherwise("PASS")
