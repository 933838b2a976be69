"""Connected components of a table of links, by large and small stars.

A large star joins each node's larger neighbours to the smallest node around; a small star joins its smaller ones and itself. The two
take turns until nothing changes; then each node hangs on the smallest node of its component. Each round is cut off by a checkpoint.
Joins carry at most one row for each link and turn; a node with very many links is a skewed key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    met = down.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node with a link (a, b); the component is its smallest node. No links give no rows."""
    links = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(links)
    while mark[0]:
        links = checkpoint(_small(_large(links)))
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b"), F.col("b")).distinct())
