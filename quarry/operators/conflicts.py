"""Errors within a source and contradictions between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import middle_median


def outliers(rows: DataFrame, series: list[str], order: list[str], value: str, times: float = 3.0) -> DataFrame:
    """Adds neighbours' median and flagged: a value over `times` the median of up to two values before and two after it in its series.

    Missing values are dropped first, so a gap doesn't part its neighbours. A value without neighbours isn't flagged.
    """
    w = Window.partitionBy(*series).orderBy(*order)
    near = F.array(*[F.lag(value, k).over(w) for k in (2, 1)], *[F.lead(value, k).over(w) for k in (1, 2)])
    near = F.array_sort(F.filter(near, lambda x: x.isNotNull()))
    out = rows.where(F.col(value).isNotNull()).withColumn("_near", near)
    median = middle_median(F.col("_near"))
    return out.withColumn("median", median).withColumn("flagged", F.coalesce(F.col(value) > times * median, F.lit(False))).drop("_near")


def contradictions(facts: DataFrame) -> DataFrame:
    """Facts (market, fact, value, authority, effective_date, record_id) with two or more values, each with the winner's.

    The winner has the highest authority, then the latest date (undated last), then the smallest record_id. Both sides are aggregates
    by fact, so nothing is sorted.
    """
    best = F.max_by(F.struct("value", "record_id"), F.struct("authority", F.coalesce("effective_date", F.lit("")).alias("d"), (-F.col("record_id")).alias("r")))
    winners = facts.groupBy("market", "fact").agg(best.alias("w"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("value").alias("n_values")).where("low <> high")
    joined = facts.join(winners, ["market", "fact"])
    return joined.select("market", "fact", "record_id", "value", F.col("w.value").alias("authoritative_value"), F.col("w.record_id").alias("authoritative_record"), "n_values", (F.col("value") != F.col("w.value")).alias("needs_review"))


def superseded(docs: DataFrame, group: str, date: str, id_column: str) -> DataFrame:
    """Adds status: of dated documents of a group the latest stays active (the first by id among equal dates); undated ones stay active too."""
    latest = docs.where(F.col(date).isNotNull()).groupBy(group).agg(F.max_by(id_column, F.struct(F.col(date).alias("d"), (-F.col(id_column)).alias("i"))).alias("_last"))
    status = F.when(F.col(date).isNull() | (F.col(id_column) == F.col("_last")), "active").otherwise("superseded")
    return docs.join(latest, group, "left").withColumn("status", status).drop("_last")


def first_matching(text: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern that matches: one projection, no join."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def years_to_months(value: Column, unit: Column) -> Column:
    """Durations in months."""
    return F.when(unit.startswith("year"), value * 12).otherwise(value)
