"""Short answers to what an agent asked, as columns: normal form, polarity by scored cues, options, and what the awaited field becomes.

Words come from tables (Cues) that the caller may replace. A text that says more than its cues and fillers allow answers nothing, so
that what is left over goes to a model.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spoken import number_in


@dataclass(frozen=True)
class Cues:
    """Words that speakers of a market use: what says yes and no, what leaves open, what adds nothing, what makes an amount a month's.

    The defaults are few; a market's own lists come from its rule file.
    """

    yes: tuple[str, ...] = ("yes", "yeah", "yep", "yup", "sure", "of course", "correct", "right", "haan", "oo", "iya")
    no: tuple[str, ...] = ("no", "nope", "nah", "not", "none", "never", "dont", "nothing", "nahi", "tidak")
    unsure: tuple[str, ...] = ("maybe", "perhaps", "probably", "not sure", "i think", "i guess")
    courtesy: tuple[str, ...] = ("please", "thanks", "sir", "madam", "ji", "um", "uh")
    fillers: tuple[str, ...] = ("we", "us", "of", "do", "have")
    beside_numbers: tuple[str, ...] = ("i", "am", "just", "years", "old", "about", "rupees", "per", "a", "year")
    monthly: tuple[str, ...] = ("month", "monthly")
    leads: tuple[str, ...] = ("my name is", "its", "im based in", "yeah")


ENGLISH = Cues()


#: A number, its digits in groups or not, maybe in thousands; or a word, which apostrophes and hyphens may hold together.
SAID = r"(\d+(?:,\d{2,3})*(?:\.\d+)?(?:\s*k(?![\p{L}\p{M}\p{N}_]))?|[\p{L}\p{M}\p{N}_]+(?:['’-][\p{L}\p{M}\p{N}_]+)*)"


def normal(text: Column, cues: Cues = ENGLISH) -> Column:
    """The words and numbers of a text, lower-cased: 1,200 as 1200, 15k as 15 thousand, words without apostrophes and hyphens, courtesy gone."""

    def plain(token: Column) -> Column:
        number = F.concat(F.regexp_replace(token, r"[,k\s]", ""), F.when(token.endswith("k"), " thousand").otherwise(""))
        return F.when(token.rlike(r"^\d[\d,.\s]*k?$"), number).otherwise(F.regexp_replace(token, "['’-]", ""))

    tokens = F.transform(F.regexp_extract_all(F.lower(text), F.lit(SAID), F.lit(1)), plain)
    return F.array_join(F.filter(tokens, lambda w: ~w.isin(*cues.courtesy)), " ")


def _phrase(words: tuple[str, ...]) -> str:
    return rf"(?:^|\s)(?:{'|'.join(words)})(?=\s|$)"


def polarity(said: Column, cues: Cues = ENGLISH, allowed: tuple[str, ...] = ()) -> Column:
    """Whether a normal text says yes or no: every word scores 1, -1 or 0; null where one has no score, both signs stand, or it hedges."""
    for cue in (*cues.yes, *cues.no, *allowed):
        if " " in cue:
            said = F.regexp_replace(said, rf"\b{cue}\b", cue.replace(" ", "_"))
    one = lambda ws: [w.replace(" ", "_") for w in ws]
    score = lambda w: F.when(w.isin(*one(cues.yes)), 1).when(w.isin(*one(cues.no)), -1).when(w.isin(*cues.fillers, *one(allowed)), 0)
    scores = F.transform(F.split(said, " "), score)
    left_over = F.exists(scores, lambda s: s.isNull()) | said.rlike(_phrase(cues.unsure)) | said.rlike(r"\d")
    return F.when(~left_over & (F.array_contains(scores, 1) != F.array_contains(scores, -1)), F.array_contains(scores, 1))


def said_number(said: Column, cues: Cues = ENGLISH, allowed: tuple[str, ...] = ()) -> Column:
    skip = {*cues.beside_numbers, *cues.monthly, *allowed}
    return number_in(F.filter(F.split(said, " "), lambda w: ~w.isin(*skip)))


#: Words that name an option by its place or size. Fixed values of English.
PLACES = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "middle": 2, "third": 3, "3rd": 3}
SIZES = {"cheapest": "least", "lowest": "least", "smallest": "least", "minimum": "least", "biggest": "most", "highest": "most", "largest": "most", "maximum": "most"}
HEDGES = ("or", "maybe", "not", "between")


def pick(said: Column, options: Column) -> Column:
    """The place, from 1, of the option (of an array of numbers) that a normal text names by place, size or amount; null if it names none, or two."""
    words = F.split(said, " ")
    table = F.create_map(*[x for w, i in PLACES.items() for x in (F.lit(w), F.lit(i))])
    places = F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda i: i <= F.size(options)))
    sized = lambda kind: F.exists(words, lambda w: w.isin(*[s for s, k in SIZES.items() if k == kind]))
    amount = said_number(said, allowed=("the", "option", "plan"))
    by_place = F.when(F.size(places) == 1, F.element_at(places, 1))
    by_size = F.when(sized("least"), F.array_position(options, F.array_min(options))).when(sized("most"), F.array_position(options, F.array_max(options)))
    by_amount = F.nullif(F.array_position(options.cast("array<double>"), amount), F.lit(0).cast("long"))
    return F.when(~F.exists(words, lambda w: w.isin(*HEDGES)), F.coalesce(by_place.cast("long"), by_size, by_amount))


def answer(kind: str, text: Column, cues: Cues = ENGLISH, allowed: tuple[str, ...] = (), known: tuple[str, ...] = (), rejected: tuple[str, ...] = ()) -> Column:
    """The value of an awaited field, as text: kinds number, amount (a year's), yesno, city (of those known), name. A question answers nothing."""
    said = normal(text, cues)
    bare = said
    for _ in range(2):  # "yeah its ravi": a lead may follow another
        bare = F.regexp_replace(bare, rf"^(?:{'|'.join(sorted(cues.leads, key=len, reverse=True))})\s+", "")
    number = said_number(said, cues, allowed)
    number = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))
    yearly = said_number(said, cues, allowed) * F.when(said.rlike(_phrase(cues.monthly)), 12).otherwise(1)
    taken = F.array(*map(F.lit, (*cues.yes, *cues.no, *rejected)))
    name = F.when(bare.rlike(r"^\p{L}+( \p{L}+)?$") & ~F.arrays_overlap(F.split(bare, " "), taken), F.initcap(bare))
    value = {
        "yesno": polarity(said, cues, allowed).cast("string"),
        "number": number,
        "amount": yearly.cast("long").cast("string"),
        "city": F.when(bare.isin(*known), bare) if known else F.lit(None).cast("string"),
        "name": name,
    }[kind]
    return F.when(~F.contains(text, F.lit("?")), value)


def resolve(rows: DataFrame, kind: str, **rules) -> DataFrame:
    """Adds value to rows with text: what a short answer makes of the awaited kind of field."""
    return rows.withColumn("value", answer(kind, F.col("text"), **rules))


def _likeness(a: str, b: str) -> float:
    return 100 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def partial_ratio(part: pd.Series, whole: pd.Series) -> pd.Series:
    """How well the best window of a text fits a part, 0 to 100."""

    def one(a, b):
        if not a or not b:
            return 0.0
        if a in b:
            return 100.0
        blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        starts = {max(0, j - i) for i, j, _ in blocks}
        return max((_likeness(a, b[s : s + len(a)]) for s in starts), default=0.0)

    return pd.Series([one(a, b) for a, b in zip(part, whole, strict=True)])


@F.pandas_udf(T.DoubleType())
def token_set_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Likeness of two texts as sets of words, 0 to 100: the best of what they share against each with its own rest, and of both rests."""

    def one(a, b):
        a, b = set((a or "").split()), set((b or "").split())
        if not a or not b:
            return 0.0
        shared = " ".join(sorted(a & b))
        first, second = (" ".join([shared] * bool(shared) + sorted(x)) for x in (a - b, b - a))
        if shared and not (a - b and b - a):
            return 100.0
        return max(_likeness(shared, first) if shared else 0.0, _likeness(shared, second) if shared else 0.0, _likeness(first, second))

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


@F.pandas_udf(T.LongType())
def word_edits(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Edit distance in words."""

    def one(a, b):
        a, b = (a or "").split(), (b or "").split()
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    return pd.Series([one(a, b) for a, b in zip(ref, hyp, strict=True)])
