"""Eligibility, pricing and account rules as column expressions over small rule tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_band(rows: DataFrame, value: str, bands: DataFrame) -> DataFrame:
    """Rows with the first band (name, lo, hi), by lo and hi, that holds a value, null if none does.

    Bands are a rule table, of any length that a driver holds: its bounds cut the numbers into pieces, each with its band, and a value's
    piece is found by bisection.
    """
    found = sorted((float(b["lo"]), float(b["hi"]), b["name"]) for b in bands.collect())
    cuts = np.unique([x for lo, hi, _ in found for x in (lo, np.nextafter(hi, np.inf))])
    names: list[str | None] = [None] * (len(cuts) + 1)
    for lo, hi, name in reversed(found):
        for i in range(int(np.searchsorted(cuts, lo, "right")), int(np.searchsorted(cuts, hi, "right")) + 1):
            names[i] = name
    pieces = np.array(names, object)

    @F.pandas_udf("string")
    def band(values: pd.Series) -> pd.Series:
        out = pd.Series(pieces[np.searchsorted(cuts, values.to_numpy(float, na_value=np.nan), "right")] if len(cuts) else [None] * len(values))
        return out.where(values.notna().to_numpy(), None)

    return rows.withColumn("band", band(F.col(value).cast("double")))


def zone(place: Column, zones: dict[str, list[str]], default: str = "C") -> Column:
    """The first zone with a name that a place contains."""
    out = F.lit(default)
    for name, parts in reversed(zones.items()):
        out = F.when(F.lower(place).rlike("|".join(parts)), name).otherwise(out)
    return out


def smallest_at_least(options: list[int], wanted: Column) -> Column:
    """The smallest option that reaches what is wanted, else the largest."""
    out = F.lit(max(options))
    for x in sorted(options, reverse=True):
        out = F.when(wanted <= x, x).otherwise(out)
    return out


def spread(rows: DataFrame, key: str, n: str, i: str) -> DataFrame:
    """Of n options numbered from 1, all if they are three at most, else the first, the middle and the last."""
    return rows.where((F.col(n) <= 3) | F.col(i).isin(1) | (F.col(i) == F.floor(F.col(n) / 2) + 1) | (F.col(i) == F.col(n)))


def eligibility(age: Column, cover: Column, children: Column, treatment: Column, eldest_parent: Column) -> Column:
    """Decision and product, the first rule that fits: struct<decision, product, members>."""
    out = lambda decision, product=None, members=None: F.struct(F.lit(decision).alias("decision"), F.lit(product).cast("string").alias("product"), F.lit(members).cast("string").alias("members"))
    family = F.when(cover.isin("self_spouse", "family"), True).otherwise(False)
    return (
        F.when(treatment, out("refer"))
        .when(age.isNull() & ~cover.eqNullSafe(F.lit("parents")), out("incomplete"))
        .when(cover.eqNullSafe(F.lit("parents")) & eldest_parent.isNull(), out("incomplete"))
        .when(cover.eqNullSafe(F.lit("parents")) & (eldest_parent > 75), out("not_eligible"))
        .when(cover.eqNullSafe(F.lit("parents")), out("eligible", "Silver", "1 adult"))
        .when(age > 75, out("not_eligible"))
        .when(age > 65, out("eligible", "Silver", "1 adult"))
        .when(family & (F.coalesce(children, F.lit(0)) > 3), out("not_eligible"))
        .when(family & ((cover == "self_spouse") | (F.coalesce(children, F.lit(0)) == 0)), out("eligible", "Family", "2 adults"))
        .when(family & (children == 1), out("eligible", "Family", "2 adults + 1 child"))
        .when(family, out("eligible", "Family", "2 adults + 2 children"))
        .otherwise(out("eligible", "Secure", "1 adult"))
    )


def grade(premium: Column, budget: Column, timeline: Column, tolerance: float = 1.15) -> Column:
    """hot, warm or cold by timeline and by whether a budget bears the premium."""
    return F.when(timeline.isin("not_interested", "later"), "cold").when((premium <= budget * tolerance) & (timeline.isNull() | (timeline == "immediate")), "hot").otherwise("warm")


def premium(base: Column, factor: Column) -> Column:
    """A zone's premium, rounded half to even."""
    return F.bround(base * factor, 0).cast("long")


def account(due: Column, today: Column, installment: Column, grace_days: int, late_percent: float) -> Column:
    """struct<days_to_due, grace_end, late_fee, stage> of an installment."""
    days = F.datediff(due, today)
    return F.struct(
        days.cast("long").alias("days_to_due"),
        F.date_format(F.date_add(due, grace_days), "yyyy-MM-dd").alias("grace_end"),
        F.round(installment * late_percent / 100, 4).alias("late_fee"),
        F.when(days >= 0, "due").when(days >= -grace_days, "grace").otherwise("late").alias("stage"),
    )


def required_missing(required: dict[str, Column], values: dict[str, Column]) -> Column:
    """Names of fields that are required and null, in order."""
    return F.filter(F.array(*[F.when(need & values[name].isNull(), F.lit(name)) for name, need in required.items()]), lambda x: x.isNotNull())
