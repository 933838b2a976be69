"""Numbers, dates and times as they are said: phrases read as numbers by a small grammar, numbers written as words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
ENGLISH = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
ENGLISH_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
INDONESIAN = "nol satu dua tiga empat lima enam tujuh delapan sembilan sepuluh sebelas".split()
HINDI = """शून्य एक दो तीन चार पाँच छह सात आठ नौ
दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस
बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस
तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस
चालीस इकतालीस बयालीस तैंतालीस चौवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास
पचास इक्यावन बावन तिरपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ
साठ इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर
सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उनासी
अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी
नब्बे इक्यानवे बानवे तिरानवे चौरानवे पचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे""".split()
ENGLISH_MONTHS = "January February March April May June July August September October November December".split()
INDONESIAN_MONTHS = "Januari Februari Maret April Mei Juni Juli Agustus September Oktober November Desember".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
#: The groups of digits that each language counts in: from which power of ten, and its name; a hundred stands within a group.
GROUPS = {
    "en": ((9, "billion"), (6, "million"), (3, "thousand"), (2, "hundred")),
    "en_IN": ((7, "crore"), (5, "lakh"), (3, "thousand"), (2, "hundred")),
    "hi": ((7, "करोड़"), (5, "लाख"), (3, "हज़ार"), (2, "सौ")),
    "id": ((9, "miliar"), (6, "juta"), (3, "ribu"), (2, "ratus")),
}
#: One of these is said in one word.
ONE_OF = {"ratus": "seratus", "ribu": "seribu"}

#: What the words of a phrase are to the grammar: u a unit, e ten to nineteen, t a ten, h hundred, s a larger size, a "and", d digits.
_KINDS = {w: ("u" if i < 10 else "e", float(i)) for i, w in enumerate(ENGLISH)} | {w: ("t", 20.0 + 10 * i) for i, w in enumerate(ENGLISH_TENS)}
_KINDS |= {"hundred": ("h", 100.0), "and": ("a", 0.0)} | {w: ("s", v) for w, v in (("thousand", 1e3), ("lakh", 1e5), ("lakhs", 1e5), ("million", 1e6), ("crore", 1e7), ("crores", 1e7))}
_TENS = "(?:tu|t|e|u|d)"
_PART = f"(?:{_TENS}h(?:tu|t|e|u)?|{_TENS})"
#: Parts before sizes, "and" only behind a size and before more, and a last part.
GRAMMAR = f"^(?=.)(?:{_PART}?s(?:a(?=[^a]))?)*{_PART}?$"


def number_in(words: Column) -> Column:
    """The number that an array of words says; null where they say none, two, or leave it open.

    The kinds of the words must fit the grammar, so a fold over them needs no cases: sizes close a part, hundred raises it.
    """
    known = F.create_map(*[x for w, (k, v) in _KINDS.items() for x in (F.lit(w), F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")))])
    digits = lambda w: F.when(w.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.struct(F.lit("d").alias("k"), w.try_cast("double").alias("v")))
    other = F.struct(F.lit("x").alias("k"), F.lit(0.0).alias("v"))
    each = F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), digits(w), other))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("part"))

    def step(s, x):
        closed = s["total"] + F.when(s["part"] == 0, 1.0).otherwise(s["part"]) * x["v"]
        part = F.when(x["k"] == "h", s["part"] * 100).otherwise(s["part"] + x["v"])
        return F.struct(F.when(x["k"] == "s", closed).otherwise(s["total"]).alias("total"), F.when(x["k"] == "s", 0.0).otherwise(part).alias("part"))

    return F.when(F.array_join(F.transform(each, lambda x: x["k"]), "").rlike(GRAMMAR), F.aggregate(each, start, step, lambda s: s["total"] + s["part"]))


def spoken_number(text: Column) -> Column:
    """The whole number in a phrase of number words and digits, null if there is none."""
    n = number_in(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+|[0-9]+(?:\.[0-9]+)?)"), F.lit(1)))
    return F.when(n == F.floor(n), n.cast("long"))


def below_hundred(language: str) -> list[str]:
    """The names of 0 to 99."""
    if language == "hi":
        return HINDI
    if language == "id":
        teens = [*INDONESIAN, *(f"{u} belas" for u in INDONESIAN[2:10])]
        return [teens[i] if i < 20 else f"{INDONESIAN[i // 10]} puluh" + f" {INDONESIAN[i % 10]}" * (i % 10 > 0) for i in range(100)]
    return [ENGLISH[i] if i < 20 else ENGLISH_TENS[i // 10 - 2] + f" {ENGLISH[i % 10]}" * (i % 10 > 0) for i in range(100)]


def _words(n: Column, language: str, digits: int) -> Column:
    """Numbers under 10 ** digits in words, null for zero: each group is a column of its own, and empty ones fall away."""
    if digits <= 2:
        return F.when(n > 0, F.get(F.array(*map(F.lit, below_hundred(language))), n.cast("int")))
    parts, above = [], digits
    for power, name in GROUPS[language]:
        if power >= above:
            continue
        count = F.floor(n / F.lit(10**power)) % 10 ** (above - power)
        said = F.concat(_words(count, language, above - power), F.lit(f" {name}"))
        parts.append(F.when(count == 1, ONE_OF[name]).otherwise(said) if name in ONE_OF else said)
        above = power
    return F.nullif(F.concat_ws(" ", *parts, _words(n % 100, language, 2)), F.lit(""))


def in_words(n: Column, language: str = "en_IN") -> Column:
    """Whole numbers of up to fifteen digits in words; negative ones with minus, longer ones null."""
    size = F.abs(n.cast("long"))
    said = F.when(size == 0, below_hundred(language)[0]).when(size < 10**5, _words(size, language, 5)).otherwise(_words(size, language, 15))
    return F.when(size < 10**15, F.concat(F.when(n < 0, "minus ").otherwise(""), said))


def amount_in_words(amount: Column, currency: str) -> Column:
    """An amount as it is said in its market: rupees to the nearest hundred (INR, HINR in Hindi), pesos and rupiah to the nearest one."""
    hundreds, ones = F.bround(amount / 100, 0) * 100, F.bround(amount, 0)
    said = {"INR": (hundreds, "en_IN", "rupees"), "HINR": (hundreds, "hi", "रुपये"), "PHP": (ones, "en", "pesos"), "IDR": (ones, "id", "rupiah")}
    n, language, name = said[currency]
    return F.concat(in_words(n, language), F.lit(" " + name))


def lakhs_in_words(lakhs: Column) -> Column:
    return F.concat(in_words(lakhs, "en_IN"), F.lit(" lakh"))


def date_spoken(day: Column, market: str = "in") -> Column:
    """A date without its year: 5 March, in ph March 5, in id tanggal 5 Maret."""
    months = F.array(*map(F.lit, INDONESIAN_MONTHS if market == "id" else ENGLISH_MONTHS))
    month, number = F.element_at(months, F.month(day)), F.dayofmonth(day).cast("string")
    return {"in": F.concat_ws(" ", number, month), "ph": F.concat_ws(" ", month, number), "id": F.concat_ws(" ", F.lit("tanggal"), number, month)}[market]


#: Days that need no "on", and parts of a day.
NEAR_DAYS, PARTS = ("today", "tomorrow", "tonight"), ("morning", "afternoon", "evening")
CLOCK = r"^\d{1,2}(:\d\d)?"


def when_spoken(text: Column) -> Column:
    """A time as it was typed, made to follow "will call you": sunday 3pm becomes on Sunday at 3 PM.

    Words are read one by one: hours get their half of the day, weekdays a capital, and the words that come first say what stands before them.
    """
    apart = F.split(F.regexp_replace(F.trim(text), r"(\d)(?=[aApP]\.?[mM]\b)", "$1 "), " +")
    bare = F.transform(apart, lambda w: F.regexp_replace(F.lower(w), "[,.]", ""))
    at = lambda i: F.coalesce(F.get(bare, F.lit(i) if isinstance(i, int) else i), F.lit(""))
    half = lambda w, i: at(i).isin("am", "pm") & at(i - 1).rlike(CLOCK + "$")
    shown = F.transform(apart, lambda w, i: F.when(half(w, i), F.upper(F.regexp_replace(w, r"\.", ""))).when(at(i).isin(*WEEKDAYS), F.initcap(w)).otherwise(w))
    rest = lambda k: F.array_join(F.slice(shown, F.lit(k + 1), F.greatest(F.size(shown) - k, F.lit(0))), " ")
    first, then_hour = F.regexp_replace(shown[0], ",$", ""), at(1).rlike(CLOCK)
    day = F.when(then_hour, F.concat(first, F.lit(" at "), rest(1))).otherwise(rest(0))
    skip = F.when(at(0) == "weekend", 1).when(at(0).isin("this", "the") & (at(1) == "weekend"), 2)
    later = F.array_join(F.filter(shown, lambda w, i: i >= skip), " ")
    part = F.when((F.size(shown) == skip + 1) & F.lower(later).isin(*PARTS), F.concat(F.lit(", in the "), later)).when(later != "", F.concat(F.lit(" "), later)).otherwise("")
    return (
        F.when(at(0).isin(*WEEKDAYS), F.concat(F.lit("on "), day))
        .when(at(0).isin(*NEAR_DAYS), day)
        .when(skip.isNotNull(), F.concat(F.lit("on the weekend"), part))
        .when(at(0).rlike(r"^\d"), F.concat(F.lit("at "), rest(0)))
        .otherwise(rest(0))
    )
