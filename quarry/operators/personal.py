"""Personal data as spans with scores: checked, freed of overlaps, and names kept only near a direct identifier.

Every kind's matches are candidates with a score; a check digit that is right raises it, one that is wrong drops the candidate or leaves the low score
of its form. Overlaps go to the higher score, then the longer span, then the earlier one. Names are noisy: one stays if an address or number
that names a person lies within WINDOW characters, or where the text is about people.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pii import verhoeff_tables

LEAST_SCORE, WINDOW, QUARANTINED = 0.4, 100, 3
PRODUCT, PERMUTED = verhoeff_tables()


def digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isdigit()]


def verhoeff(text: str) -> bool:
    check = 0
    for i, d in enumerate(reversed(digits(text))):
        check = PRODUCT[check][PERMUTED[i % 8][d]]
    return check == 0


def luhn(text: str) -> bool:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits(text)))) % 10 == 0


class Kind(NamedTuple):
    """A form of personal data; check, where there is one, decides: right gives a score of 1, wrong drops the match."""

    name: str
    pattern: re.Pattern
    score: float
    check: Callable[[str], bool] | None = None


# The forms of each kind, their scores, and the labels they are shown by.
KINDS = (
    Kind("EMAIL_ADDRESS", re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"), 1.0),
    Kind("CREDIT_CARD", re.compile(r"(?<![\w+])[13-6]\d{3}[ -]?\d{3,4}[ -]?\d{3,4}[ -]?\d{3,5}\b"), 0.3, luhn),
    Kind("IN_AADHAAR", re.compile(r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b"), 0.5, verhoeff),
    Kind("IN_PAN", re.compile(r"\b[A-Z]{3}[PCHFATBLJG][A-Z]\d{4}[A-Z]\b"), 0.85),
    Kind("IN_PHONE", re.compile(r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"), 0.7),
    Kind("PH_PHONE", re.compile(r"(?<!\d)(?:\+63[\s-]?|0)9\d{2}[\s-]?\d{3}[\s-]?\d{4}(?!\d)"), 0.7),
    Kind("ID_PHONE", re.compile(r"(?<!\d)(?:\+62[\s-]?|0)8\d{2}[\s-]?\d{3,4}[\s-]?\d{3,4}(?!\d)"), 0.7),
    Kind("PHONE_NUMBER", re.compile(r"\+\d{1,2} ?\(?\d{3,5}\)?(?:[ -]?\d{3,5}){1,2}\b"), 0.4),
    Kind("PH_TIN", re.compile(r"\b\d{3}-\d{3}-\d{3}(?:-\d{3})?\b"), 0.4),
    Kind("ID_NIK", re.compile(r"\b\d{16}\b"), 0.4),
    Kind("ID_NPWP", re.compile(r"\b\d{2}\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}\b"), 0.8),
    Kind("PERSON", re.compile(r"(?<=[—–-] )[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}(?=,)"), 0.6),
    Kind("PERSON", re.compile(r"(?<=Name: )[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}"), 0.7),
)
PHONES, LABELS = "PHONE", {"EMAIL_ADDRESS": "EMAIL"}


def label(kind: str) -> str:
    """What a kind is shown as: all phones alike."""
    return PHONES if PHONES in kind else LABELS.get(kind, kind)


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def candidates(text: str, allowed: tuple[str, ...] = ()) -> Iterator[Span]:
    """Matches of all kinds that score enough; what is allowed, or part of it or around it, isn't personal."""
    for kind in KINDS:
        for m in kind.pattern.finditer(text):
            said = m[0].lower()
            if any(a in said or said in a for a in allowed):
                continue
            right = kind.check and kind.check(m[0])
            if right or kind.check is None and kind.score >= LEAST_SCORE:
                yield Span(m.start(), m.end(), kind.name, 1.0 if right else kind.score)


def without_overlaps(found: list[Span]) -> list[Span]:
    """The best spans, none of which overlaps another, in order."""
    starts: list[int] = []
    kept: list[Span] = []
    for s in sorted(found, key=lambda s: (-s.score, s.start - s.end, s.start, s.kind)):
        at = bisect_left(starts, s.start)
        if (at == 0 or kept[at - 1].end <= s.start) and (at == len(kept) or s.end <= kept[at].start):
            starts.insert(at, s.start)
            kept.insert(at, s)
    return kept


def spans(text: str, about_people: bool = False, allowed: tuple[str, ...] = ()) -> list[Span]:
    found = without_overlaps(list(candidates(text, allowed)))
    direct = [s for s in found if s.kind != "PERSON"]
    starts, ends = [s.start for s in direct], [s.end for s in direct]

    def near(s: Span) -> bool:
        after = bisect_left(starts, s.end)
        before = bisect_left(ends, s.start + 1)
        return after < len(starts) and starts[after] - s.end <= WINDOW or before > 0 and s.start - ends[before - 1] <= WINDOW

    return [s for s in found if s.kind != "PERSON" or about_people or near(s)]


SPANS = "array<struct<start: int, end: int, kind: string, label: string, score: double>>"


def with_spans(rows: DataFrame, text: str = "text", about_people: Column | None = None, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Adds spans of a text column: where each begins and ends, in characters, its kind, label and score. Null texts have none."""
    low = tuple(a.lower() for a in allowed)

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series, people: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s.start, "end": s.end, "kind": s.kind, "label": label(s.kind), "score": s.score} for s in spans(t or "", bool(p), low)] for t, p in zip(texts, people, strict=True)])

    return rows.withColumn("spans", found(F.col(text), about_people if about_people is not None else F.lit(False)))


def redacted(text: Column, spans: Column) -> Column:
    """A text with each span shown as [REDACTED_LABEL]; spans are in order and don't overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("[REDACTED_"), s["label"], F.lit("]")).alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def labels(spans: Column) -> Column:
    """The labels of spans, sorted, each once."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))


def is_customer_record(spans: Column, least: int = QUARANTINED) -> Column:
    """Whether so many kinds stand in a text that it is somebody's record, and not knowledge."""
    return F.size(F.array_distinct(F.transform(spans, lambda s: s["kind"]))) >= least
