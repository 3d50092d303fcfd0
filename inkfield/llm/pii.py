"""Personal data replaced by format-preserving pseudonyms, in DataFrame functions only.

Equal values get equal pseudonyms under one key, in whatever document they stand: each value is permuted by a
keyed Feistel network within the values of its own format, so a card number stays a valid card number and a date a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import free_name, quoted

# Give a secret of your own; whoever holds the key can undo the permutation.
DEVELOPMENT_KEY = "inkfield"
ROUNDS = 8
BLOCK = 128

# A Gregorian cycle of 400 years, 1700-01-01 to 2099-12-31, has 146097 = 189 * 773 days.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1700-01-01", 189, 773

_START, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
# Places of an account number by country, so that a word behind it is not read as its end; other countries by groups of four.
_PLACES = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_ACCOUNT = "|".join(
    f"(?:{lands})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{(n - 4) // 4}}}" + (f" ?[0-9A-Z]{{{n % 4}}}" if n % 4 else "") + _END
    for n, lands in _PLACES.items()
)
# In this order; the first that fits at a place is taken. Lengths are bounded, possessive or of single characters.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}" + _END,
    "secret": _START + r"(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|token|api_?key) ?[=:] ?\"?[0-9A-Za-z_-]{8,}+(?:\.(?!\.)[0-9A-Za-z_.-]*[0-9A-Za-z_-])?)" + _END,
    "iban": _START + r"(?=[A-Z]{2}[0-9]{2})(?:" + _ACCOUNT + r"|[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _END + ")",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}" + _END,
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}" + r"(?![0-9A-Za-z]|-[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})" + r"(?![0-9A-Za-z]|[./-][0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + r"(?![0-9A-Za-z]|\.[0-9])",
    "card": _START + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})" + _END,
}
CANDIDATE = "|".join(FORMATS.values())
KINDS = tuple(FORMATS)
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pseudonyms(docs: DataFrame, key: str = DEVELOPMENT_KEY) -> DataFrame:
    """``docs`` with personal values in ``text`` replaced and ``pii`` added: how many of each kind, as a map.

    Found are e-mail addresses, assigned secrets and access keys, account numbers whose check digits hold, phone
    numbers, social security numbers, valid dates from 1700 to 2099, IPv4 addresses and card numbers that pass their check
    digit. Values that fail their test stay. Everything else of a text stays as it is, to the character.

    A null text stays null with an empty map; an empty text stays empty. Rows are neither dropped nor merged, and all
    columns are kept; an own column named ``pii`` is replaced.
    """
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    values = F.transform(found, lambda m: F.struct(_kind(m).alias("kind"), m.alias("value")))
    new = _pseudonyms(values, key)
    has = F.col("text").rlike(CANDIDATE)
    gaps = F.split("text", CANDIDATE, -1)
    columns = [c for c in docs.columns if c != "pii"]
    made, rest = (free_name(docs.columns, name) for name in ("made", "rest"))
    staged = docs.select(*map(quoted, columns), F.when(has, new).alias(made), F.when(has, gaps).alias(rest))
    joined = F.concat(
        F.element_at(rest, 1),
        F.array_join(
            F.zip_with(F.slice(rest, F.lit(2), F.size(made)), made, lambda g, v: F.concat(v["value"], g)), ""
        ),
    )
    counts = F.map_from_entries(
        F.filter(
            F.array(*[
                F.struct(F.lit(k), F.size(F.filter(F.transform(made, lambda v: v["kind"]), _equals(k)))) for k in KINDS
            ]),
            lambda e: e["col2"] > 0,
        )
    )
    none = F.create_map().cast("map<string,int>")
    return staged.select(
        *[
            F.when(F.col(made).isNull(), F.col("text")).otherwise(joined).alias(c) if c == "text" else F.col(quoted(c))
            for c in columns
        ],
        F.when(F.col(made).isNull(), none).otherwise(counts).alias("pii"),
    )


def _equals(k: str):
    return lambda v: v == k


def _kind(m: Column) -> Column:
    """Kind of a candidate, null if it fails the test of its format."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    whole = {k: m.rlike("^(?:" + p + ")$") for k, p in FORMATS.items()}
    fits = {
        "iban": _mod97(_rotated(m)) == 1,
        "ssn": ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
        "date": _day(m).isNotNull(),
        "ip": ~F.exists(F.split(m, r"\."), lambda x: x.cast("int") > 255),
        "card": _luhn(digits) % 10 == 0,
    }
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        # A failed test ends here: what looks like one format is not tried as another.
        out = F.when(whole[k], F.when(fits[k], k) if k in fits else F.lit(k)).otherwise(out)
    return out


# Formats whose digits and letters are permuted in their places.
PERMUTED = ("email", "secret", "iban", "phone", "ssn", "card")


def _pseudonyms(values: Column, key: str) -> Column:
    """(kind, value) of each value of a list, pseudonyms in place of values.

    Each step works on what the step before it made, so the permutation's expressions stand once for all formats.
    """

    def cut(v: Column) -> Column:
        kind, m = v["kind"], v["value"]
        digits = F.regexp_replace(m, "[^0-9]", "")
        head = (
            F.when(kind == "phone", F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0))
            .when(kind == "secret", F.regexp_extract(m, r"^(AKIA|(?i:password|passwd|secret|token|api_?key) ?[=:] ?\"?)", 0))
            .when(kind == "iban", F.substring(m, F.lit(1), F.lit(2)))
            .when(kind == "card", F.substring(digits, 1, 1))
            .otherwise("")
        )
        tail = F.when(kind == "email", F.regexp_extract(m, r"\.[A-Za-z]+$", 0)).otherwise("")
        return F.struct(kind.alias("kind"), m.alias("value"), digits.alias("digits"), head.alias("head"), tail.alias("tail"))

    def inner(v: Column) -> Column:
        kind, m, head = v["kind"], v["value"], F.length(v["head"])
        body = (
            F.when(kind == "card", F.substring(v["digits"], F.lit(2), F.length(v["digits"]) - 2))
            .when(kind == "iban", F.substring(m, F.lit(5), F.lit(64)))
            .when(kind.isin(*PERMUTED), F.substring(m, head + 1, F.length(m) - head - F.length(v["tail"])))
        )
        return F.struct(*[v[k].alias(k) for k in ("kind", "value", "head", "tail")], body.alias("body"))

    def permuted(v: Column) -> Column:
        size = F.when(v["kind"] == "secret", F.lit(BLOCK)).otherwise(F.greatest(F.length(v["body"]), F.lit(1)))
        new = F.when(v["body"].isNotNull(), _permuted_blocks(v["body"], key, v["kind"], size))
        return F.struct(*[v[k].alias(k) for k in ("kind", "value", "head", "tail")], new.alias("new"))

    def whole(v: Column) -> Column:
        kind, m, new = v["kind"], v["value"], v["new"]
        made = F.concat(v["head"], new, v["tail"])
        out = (
            F.when(kind == "iban", F.concat(v["head"], _account_check(v["head"], new), new))
            .when(kind == "card", _into(m, F.concat(made, _check_digit(made))))
            .when(kind.isin(*PERMUTED), made)
            .when(kind == "date", _date(m, key))
            .when(kind == "ip", _ip(m, key))
            .otherwise(m)
        )
        return F.struct(kind.alias("kind"), out.alias("value"))

    for step in (cut, inner, permuted, whole):
        values = F.transform(values, step)
    return values


def _round(key: str, tweak: Column, r: Column, *parts: Column) -> Column:
    """Keyed round function: 60 bits of SHA-256."""
    text = F.concat_ws("|", F.lit(key), tweak, r.cast("string"), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _permuted_pair(left: Column, right: Column, size_left: int, size_right: int, key: str, tweak: Column) -> Column:
    """A permutation of the pairs (left, right) below the two sizes."""

    def step(s: Column, r: Column) -> Column:
        a = F.pmod(s["a"] + _round(key, tweak, r, s["b"]), F.lit(size_left))
        b = F.pmod(s["b"] + _round(key, tweak, r, s["a"]), F.lit(size_right))
        even = r % 2 == 0
        return F.struct(F.when(even, a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(b).alias("b"))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _permuted_text(text: Column, key: str, tweak: Column) -> Column:
    """A permutation of the texts with digits and letters of either case in the same places; other characters stay."""
    middle = F.ceil(F.length(text) / 2).cast("int")

    def shifted(half: Column, other: Column, r: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = _round(key, tweak, r, i, other)
            turn = lambda letters: F.substring(
                F.lit(letters), (F.pmod(F.instr(F.lit(letters), c) - 1 + by, F.lit(len(letters))) + 1).cast("int"), F.lit(1)
            )
            return (
                F.when(c.rlike("[0-9]"), turn(_DIGITS)).when(c.rlike("[a-z]"), turn(_LOWER))
                .when(c.rlike("[A-Z]"), turn(_UPPER)).otherwise(c)
            )

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, shifted(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(shifted(s["b"], s["a"], r)).alias("b"),
        )

    start = F.struct(
        F.substring(text, F.lit(1), middle).alias("a"), F.substring(text, middle + 1, F.length(text)).alias("b")
    )
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"])
    )


def _permuted_blocks(text: Column, key: str, tweak: Column, size: Column) -> Column:
    """``_permuted_text`` of each ``size`` characters, so that the work grows with the length and not its square."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), size)
    return F.array_join(F.transform(starts, lambda at: _permuted_text(F.substring(text, at, size), key, tweak)), "")


def _into(shape: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``shape``, separators kept."""
    places = F.filter(F.split(shape, ""), lambda c: c != "")
    state = F.aggregate(
        places, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + c.rlike("[0-9]").cast("int")).alias("at"),
        ),
    )
    return state["out"]


def _luhn(digits: Column) -> Column:
    """Weighted digit sum of a whole number, its check digit included."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (1 + (i - 1) % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add)


def _check_digit(body: Column) -> Column:
    return F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")


def _rotated(iban: Column) -> Column:
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    return F.concat(F.substring(plain, F.lit(5), F.lit(40)), F.substring(plain, F.lit(1), F.lit(4)))


def _mod97(text: Column) -> Column:
    """The number spelled by digits and letters (A = 10 ... Z = 35), modulo 97."""

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _account_check(land: Column, account: Column) -> Column:
    return F.lpad((98 - _mod97(_rotated(F.concat(land, F.lit("00"), account)))).cast("string"), 2, "0")


_SHAPES = {r"^[0-9]{4}-": "yyyy-MM-dd", r"^[0-9]{2}\.[0-9]{2}\.": "dd.MM.yyyy", r"^[0-9]{2}/[0-9]{2}/": "dd/MM/yyyy"}


def _day(m: Column) -> Column:
    """Days since the first day of the range; null for a date that does not exist or lies outside."""
    day = F.coalesce(*[
        F.when(m.rlike(p), F.try_to_timestamp(m, F.lit(f)).cast("date")) for p, f in _SHAPES.items()
    ])
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when((n >= 0) & (n < DAYS_LEFT * DAYS_RIGHT), n)


def _date(m: Column, key: str) -> Column:
    n = _day(m)
    moved = _permuted_pair(F.floor(n / DAYS_RIGHT), n % DAYS_RIGHT, DAYS_LEFT, DAYS_RIGHT, key, F.lit("date"))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (moved["a"] * DAYS_RIGHT + moved["b"]).cast("int"))
    return F.coalesce(*[F.when(m.rlike(p), F.date_format(day, f)) for p, f in _SHAPES.items()])


def _ip(m: Column, key: str) -> Column:
    part = lambda i: F.split(m, r"\.")[i].cast("long")
    moved = _permuted_pair(part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536, key, F.lit("ip"))
    byte = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    return F.concat_ws(".", *byte(moved["a"]), *byte(moved["b"]))
