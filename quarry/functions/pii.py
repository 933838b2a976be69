"""Personal-data patterns, checksums, and redaction in a fixed order of kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds in order of priority: an earlier kind's match is masked before a later kind is looked for.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "IN_PAN": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "CARD": r"\b[0-9]{16}\b",
    "IP": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "PHONE": r"\+[0-9]{1,2} ?\(?[0-9]{3,5}\)?(?:[ -]?[0-9]{3,5}){1,2}\b",
}
#: What stands in every text that holds a match of any kind: one look at most texts instead of one for each kind.
HINT = r"[@+0-9](?:(?<=@)|(?<=\+)[0-9]|(?<=[0-9])(?:[0-9]{3}|\.[0-9]))"
#: The position permutation of the Verhoeff checksum.
VERHOEFF_STEP = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def _dihedral(i: int, j: int) -> int:
    """Product in the symmetries of a pentagon: rotations are 0-4, reflections 5-9."""
    if i < 5:
        return (i + j) % 5 if j < 5 else 5 + (i + j - 5) % 5
    return 5 + (i - 5 - j) % 5 if j < 5 else (i - j) % 5


def verhoeff_tables() -> tuple[list[list[int]], list[list[int]]]:
    """The product table, and the permutations of positions 0 to 7 from powers of one step."""
    product = [[_dihedral(i, j) for j in range(10)] for i in range(10)]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([VERHOEFF_STEP[rows[-1][j]] for j in range(10)])
    return product, rows


def verhoeff_valid(digits: Column) -> Column:
    """Whether a string of digits carries a right Verhoeff check digit: a fold from its end."""
    product, rows = verhoeff_tables()
    d = F.array(*[F.array(*map(F.lit, r)) for r in product])
    p = F.array(*[F.array(*map(F.lit, r)) for r in rows])
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.struct(x.cast("int").alias("v"), (i % 8).alias("i")))
    each = F.filter(each, lambda x: x["v"].isNotNull())
    total = F.aggregate(each, F.lit(0), lambda c, x: d[c][p[x["i"]][x["v"]]])
    return total == 0


def luhn_valid(digits: Column) -> Column:
    each = F.filter(F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.struct(x.cast("int").alias("v"), (i % 2).alias("odd"))), lambda x: x["v"].isNotNull())
    value = lambda x: F.when(x["odd"] == 1, F.when(x["v"] * 2 > 9, x["v"] * 2 - 9).otherwise(x["v"] * 2)).otherwise(x["v"])
    return F.aggregate(each, F.lit(0), lambda s, x: s + value(x)) % 10 == 0


def found(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PATTERNS[kind]})"), F.lit(1))


def redact(text: Column) -> Column:
    """Every match as [REDACTED_KIND]."""
    masked = text
    for kind, pattern in PATTERNS.items():
        masked = F.regexp_replace(masked, pattern, f"[REDACTED_{kind}]")
    return F.when(text.rlike(HINT), masked).otherwise(text)


def kinds(text: Column) -> Column:
    """The kinds found, sorted."""
    present = F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in PATTERNS.items()])
    found = F.array_sort(F.filter(present, lambda x: x.isNotNull()))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


DIRECT_ID = r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[0-9]{9,}"
CAPITALISED = r"^\p{Lu}\p{Ll}+[,.]?$"


def name_places(tokens: Column) -> Column:
    """Places, from 1, where two capitalised words stand side by side: what may be a person's name."""
    pairs = F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))).alias("b"))
    marked = F.transform(pairs, lambda x, i: F.when(x["a"].rlike(CAPITALISED) & F.coalesce(x["b"].rlike(CAPITALISED), F.lit(False)), i + 1))
    return F.filter(marked, lambda x: x.isNotNull())


def id_places(tokens: Column) -> Column:
    """Places, from 1, of words that name a person directly: addresses and long numbers."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike(DIRECT_ID), i + 1)), lambda x: x.isNotNull())


def near(places: Column, others: Column, words: int) -> Column:
    """Places with another within so many words on either side."""
    return F.filter(places, lambda i: F.exists(others, lambda j: F.abs(i - j) <= words))
