"""Text columns: words, keys, shingles, hashes, sentences. All but Unicode composition stay in the JVM.

Words are runs of letters, digits and underscores of any script, spelled out as a class that every regular-expression engine reads alike.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD, BETWEEN = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"
SPACES = r"[\s\u00a0\u200b\u200c\u200d\ufeff]+"
#: Words too common to search by.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize_whitespace(text: Column) -> Column:
    """Composed text with every run of spaces, no-break and zero-width spaces as one space."""
    return F.trim(F.regexp_replace(nfc(text), SPACES, " "))


def line_key(line: Column) -> Column:
    """What running lines of numbered pages have in common: lower case, numbers masked."""
    return F.regexp_replace(F.lower(F.trim(line)), r"[0-9]+", "#")


def dedupe_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def tokens(text: Column) -> Column:
    """Search tokens: words without stopwords and single characters."""
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def token_count(text: Column) -> Column:
    """Words times 1.3, rounded down: a model's tokens, roughly."""
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("long")


def shingles(ws: Column, n: int = 3) -> Column:
    """Runs of n words; fewer words are one shingle. Shifted copies of the words are zipped, so words are found once a copy."""
    shifted = [F.slice(ws, k + 1, F.greatest(F.size(ws), F.lit(1))).alias(f"w{k}") for k in range(n)]
    full = F.filter(F.arrays_zip(*shifted), lambda x: x[f"w{n - 1}"].isNotNull())
    runs = F.transform(full, lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(n)]))
    return F.when(F.size(ws) >= n, runs).otherwise(F.array(F.array_join(ws, " ")))


# Affixes of Indonesian words, tried in this order.
SUFFIXES_ID = ("nya", "lah", "kah", "kan", "an")
PREFIXES_ID = ("meng", "meny", "mem", "men", "me", "peng", "peny", "pem", "pen", "pe", "ber", "ter", "di", "ke", "se")


def stem_id(word: Column) -> Column:
    """A light Indonesian stem: a word of six letters or more loses a suffix, then, if six are left, a prefix; under three letters it stays whole."""
    bare = F.regexp_replace(word, f"({'|'.join(SUFFIXES_ID)})$", "")
    cut = F.when(F.length(bare) >= 6, F.regexp_replace(bare, f"^({'|'.join(PREFIXES_ID)})", "")).otherwise(bare)
    return F.when((F.length(word) >= 6) & (F.length(cut) >= 3), cut).otherwise(word)


def content_hash(*parts: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of parts joined by newlines."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)


def first_sentences(text: Column, n: int, most: int) -> Column:
    """The first n sentences, cut at a length."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.substring(F.array_join(F.slice(F.split(marked, "\u0001"), 1, n), " "), 1, most)


def clauses(text: Column) -> Column:
    """Pieces that speech can begin with: cut after , . ? ! and at line ends, empty ones dropped."""
    marked = F.regexp_replace(text, r"([,.?!।])\s*|\n+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), F.trim), lambda x: x != "")


def occurrences(text: Column, part: str | Column) -> Column:
    """How often a string stands in a text, without overlaps."""
    part = F.lit(part) if isinstance(part, str) else part
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def indian_grouping(digits: Column) -> Column:
    """Digits with commas as in 1,23,450."""
    tail = F.right(digits, F.lit(3))
    head = F.when(F.length(digits) > 3, F.substring(digits, F.lit(1), F.length(digits) - 3)).otherwise("")
    return F.when(F.length(digits) <= 3, digits).otherwise(F.concat(F.regexp_replace(head, r"(\d)(?=(\d{2})+$)", "$1,"), F.lit(","), tail))
