"""Markdown as rows of blocks: lines classed, then joined by gaps and islands. No Python, no document in one piece."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str) -> DataFrame:
    """Rows (key, pos from 1, line, kind) with kind blank, title, heading, list_item or paragraph."""
    rows = docs.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("long").alias("pos"), F.trim("line").alias("line"))
    kind = F.when(F.col("line") == "", "blank").when(F.col("line").rlike("^#{2,} "), "heading").when(F.col("line").startswith("# "), "title").when(F.col("line").rlike("^[-*] "), "list_item").otherwise("paragraph")
    return rows.withColumn("kind", kind)


def blocks(docs: DataFrame, key: str) -> DataFrame:
    """Rows (key, pos, kind, text): neighbouring plain lines make a paragraph, other lines stand alone without their mark.

    Texts are dealt by key once; windows and groups find a key's lines where they stand, and so does what asks for the blocks of a key.
    """
    rows = lines(docs.select(key, "text").repartition(key), key)
    plain = F.col("kind") == "paragraph"
    nth = F.row_number().over(Window.partitionBy(key, plain).orderBy("pos"))
    islands = rows.withColumn("island", F.when(plain, F.col("pos") - nth).otherwise(-nth)).where("kind <> 'blank'").groupBy(key, "kind", "island")
    found = islands.agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    joined = F.array_join(F.transform("ls", lambda x: x["line"]), " ")
    return found.select(key, "pos", "kind", F.when(plain, joined).otherwise(F.trim(F.regexp_replace(F.col("ls")[0]["line"], r"^(#+|[-*]) ", ""))).alias("text"))
