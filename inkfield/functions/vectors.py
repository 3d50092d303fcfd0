"""Vector expressions in double precision, for row-wise work; bulk search uses the block kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfield.functions.text import col


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))))


def squared_l2(a, b) -> Column:
    return _sum(
        F.zip_with(
            col(a),
            col(b),
            lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
        )
    )


def l2(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def cosine(a, b) -> Column:
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))


def l2_normalize(a) -> Column:
    """Unit length; the zero vector stays zero. The norm is taken once per row, not once per element."""
    n = norm(a)
    unit = F.transform(
        F.array(n), lambda m: F.transform(col(a), lambda x: F.when(m > 0, x.cast("double") / m).otherwise(0.0))
    )
    return unit[0]


def format_bytes(n) -> Column:
    """``1.50 KiB (1,536 bytes)``; plain bytes below one KiB.

    Two decimals rounded half to even in integer arithmetic: Java's formatter would round ties up.
    """
    n = col(n).cast("decimal(30,0)")
    exact = F.concat(F.format_number(n, 0), F.lit(" bytes"))

    def unit(power: int, name: str) -> Column:
        size = 1024**power
        whole = F.floor(n * 100 / size).cast("decimal(30,0)")
        rest2 = (n * 100 - whole * size) * 2
        up = (rest2 > size) | ((rest2 == size) & (whole % 2 == 1))
        cents = (whole + F.when(up, 1).otherwise(0)).cast("bigint")
        text = F.concat(
            F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
        )
        return F.concat(text, F.lit(f" {name} ("), exact, F.lit(")"))

    return (
        F.when(n >= 1024**3, unit(3, "GiB"))
        .when(n >= 1024**2, unit(2, "MiB"))
        .when(n >= 1024, unit(1, "KiB"))
        .otherwise(exact)
    )
