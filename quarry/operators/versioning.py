"""Versions of a record set: what was added, changed or removed, and the version numbers that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, key: str = "stable_key") -> DataFrame:
    """Rows (key, change, old_hash, new_hash) of two manifests (key, content_hash): added, updated, unchanged or removed."""
    old, new = before.select(key, F.col("content_hash").alias("old_hash")), after.select(key, F.col("content_hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    return old.join(new, key, "full_outer").select(key, change.alias("change"), "old_hash", "new_hash")


def bump_minor(version: Column) -> Column:
    """The next record version: 1.3 becomes 1.4."""
    parts = F.split(version, r"\.")
    return F.concat(parts[0], F.lit("."), (parts[1].cast("int") + 1).cast("string"))


def bump_release(version: Column, added: Column, updated: Column, removed: Column) -> Column:
    """The next release: additions or removals raise the minor number, updates alone the patch number, nothing keeps it."""
    p = F.split(version, r"\.")
    minor = F.concat(p[0], F.lit("."), (p[1].cast("int") + 1).cast("string"), F.lit(".0"))
    patch = F.concat(p[0], F.lit("."), p[1], F.lit("."), (p[2].cast("int") + 1).cast("string"))
    return F.when((added > 0) | (removed > 0), minor).when(updated > 0, patch).otherwise(version)


def record_id(market: Column, kind: Column, n: Column) -> Column:
    return F.format_string("kb_%s_%s_%03d", market, kind, n)
