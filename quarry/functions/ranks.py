"""Running totals and percentiles of groups of any size: rows are ranged, so that no group comes together in one task."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpoint


def running_totals(rows: DataFrame, group: list[str], order: list[str], count: str | None = None, name: str = "upto") -> DataFrame:
    """Adds the total of count (of rows, without one) from a group's first row up to and with each row, in an order without ties.

    Rows are ranged by group and order, summed within a range, and moved on by what stands in the ranges before.
    """
    n = F.col(count) if count else F.lit(1)
    ranged = checkpoint(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*group, "_part").agg(F.sum(n).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("_part").alias("_of"), before.alias("_before"), *[F.col(g).alias(f"_{g}") for g in group])
    local = F.sum(n).over(Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_local", local)
    joined = placed.join(parts, (F.col("_part") == F.col("_of")) & same_group(group))
    return joined.select(*rows.columns, (F.col("_local") + F.col("_before")).alias(name))


def same_group(group: list[str]) -> Column:
    """Whether a row's group is that of the columns whose names begin with a line; null groups are groups."""
    return functools.reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])


def nearest(p: float):
    """The place min(n - 1, int(p (n - 1) + 0.5)), from 0."""
    return lambda n: F.least(n - 1, F.floor(p * (n - 1) + 0.5))


def floored(p: float):
    """The place int(p (n - 1))."""
    return lambda n: F.floor(p * (n - 1))


def at_places(rows: DataFrame, group: list[str], value: str, places: dict) -> DataFrame:
    """A row for each group: n, least, most, and for each name the value at a place, from 0, of the sorted values. places: name -> function of n.

    Equal values are counted before anything is sorted; nulls are left out.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    counted = counted.withColumnRenamed(value, "_v")
    totals = counted.groupBy(*group).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")).withColumnsRenamed({g: f"_{g}" for g in group})
    joined = running_totals(counted, group, ["_v"], "_c", "_upto").join(totals, same_group(group))
    picks = [F.min(F.when(F.col("_upto") > place(F.col("_n")), F.col("_v"))).alias(name) for name, place in places.items()]
    return joined.groupBy(*group, F.col("_n").alias("n"), F.col("_least").alias("least"), F.col("_most").alias("most")).agg(*picks)
