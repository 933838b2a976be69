"""Cleaning of sources: boilerplate and running lines by document frequency, quarantine of forms full of personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def boilerplate(rows: DataFrame, share: float = 0.5, least: int = 3, most_chars: int = 200) -> DataFrame:
    """Texts of rows (source, doc_id, text) that are short and stand in enough documents of a source: (source, key, n_docs).

    A source of under `least` documents has none. Copies of a text in a document count once; counts are summed before the join.
    """
    docs = rows.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"))
    key = F.lower(F.trim("text"))
    seen = rows.where(F.length("text") < most_chars).select("source", key.alias("key"), "doc_id").where("key <> ''").distinct().groupBy("source", "key").agg(F.count("*").alias("n_docs"))
    enough = F.col("n_docs") >= F.greatest(F.lit(least), F.ceil(F.col("docs") * share))
    return seen.join(docs, "source").where((F.col("docs") >= least) & enough).select("source", "key", "n_docs")


def drop_boilerplate(rows: DataFrame, **how) -> DataFrame:
    """Rows whose text isn't boilerplate of its source."""
    found = boilerplate(rows, **how).select("source", "key")
    return rows.withColumn("key", F.lower(F.trim("text"))).join(found, ["source", "key"], "left_anti").drop("key")


def drop_running_lines(lines: DataFrame, share: float = 0.6, least: int = 2) -> DataFrame:
    """Rows (doc_id, page, pos, line) without lines that run through a document's pages, page marks, and headers with bars among the first two lines."""
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    keyed = lines.withColumn("key", text.line_key(F.col("line")))
    counts = keyed.select("doc_id", "key", "page").distinct().groupBy("doc_id", "key").agg(F.count("*").alias("on_pages"))
    running = counts.join(pages, "doc_id").where(F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))).select("doc_id", "key")
    mark = F.col("key").rlike(r"^(page )?#( of #)?$|\| page #")
    header = (F.col("pos") <= 2) & (text.occurrences(F.col("line"), " | ") >= 2)
    return keyed.where(~mark & ~header).join(running, ["doc_id", "key"], "left_anti").drop("key")


def quarantined(found: DataFrame, least_kinds: int = 3) -> DataFrame:
    """Keys (doc_id) of rows (doc_id, kind) with enough different kinds of personal data."""
    return found.groupBy("doc_id").agg(F.countDistinct("kind").alias("n_kinds")).where(F.col("n_kinds") >= least_kinds)
