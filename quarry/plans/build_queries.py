"""Building records: sheets, sections, dispatch by kind, normalizing, kept blocks. Line items by part stand in for sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii
from ..operators import building, chunking, dedupe
from ..sources import markdown
from .knowledge_queries import TERMS
from .registry import query, table

_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
_LINE_SQL = "concat_ws('; ', 'order: ' || l_orderkey, CASE WHEN l_discount >= 0.02 THEN 'discount: ' || CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) END, 'quantity: ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))"


def _line():
    discount = F.when(F.col("l_discount") >= 0.02, F.round(F.col("l_discount") * 100).cast("long").cast("string")).otherwise("")
    return building.cells_text({"order": F.col("l_orderkey").cast("string"), "discount": discount, "quantity": F.col("l_quantity").cast("long").cast("string")})


@query("h04_sheet_chunks", f"""
WITH r AS (SELECT *, {_LINE_SQL} AS line, count(*) OVER (PARTITION BY l_partkey, l_returnflag) AS n FROM lineitem)
SELECT l_partkey, l_returnflag, CAST(1 AS BIGINT) AS n_rows, line AS content FROM r WHERE n > 8 UNION ALL
SELECT l_partkey, l_returnflag, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY {', '.join(_ORDER)}, line) AS content FROM r WHERE n <= 8 GROUP BY ALL""")
def h04(spark, d):
    return building.sheet_chunks(table(spark, d, "lineitem"), ["l_partkey", "l_returnflag"], _ORDER, _line())


@query("h01_chunk_dispatch", f"""
WITH r AS (SELECT *, {_LINE_SQL} AS line, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_partkey, CAST(1 AS BIGINT) AS n_rows, line AS content, 'sheet' AS branch FROM r WHERE p_size % 2 = 0 AND n > 8 UNION ALL
SELECT l_partkey, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY {', '.join(_ORDER)}, line) AS content, 'sheet' AS branch FROM r WHERE p_size % 2 = 0 AND n <= 8 GROUP BY ALL UNION ALL
SELECT l_partkey, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY {', '.join(_ORDER)}, line) AS content, 'rates' AS branch FROM r WHERE p_size % 2 = 1 GROUP BY ALL""")
def h01(spark, d):
    """Parts of even size are sheets, the others, whose type has no branch, rate tables."""
    li = table(spark, d, "lineitem")
    kinds = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 2 == 0, "sheet").otherwise("other").alias("doc_type"))
    rates = chunking.rate_chunks(li, ["l_partkey"], _line(), _ORDER).withColumnRenamed("n_lines", "n_rows")
    return building.dispatched(kinds, {"rates": rates, "sheet": building.sheet_chunks(li, ["l_partkey"], _ORDER, _line())}, "rates", "l_partkey")


@query("h02_section_chunks")
def h02(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return building.section_chunks(markdown.blocks(docs, "doc_id"), docs.select("doc_id", F.col("source").alias("title")))


@query("h08_normalized_blocks")
def h08(spark, d):
    blocks = markdown.blocks(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return building.normalized(blocks, TERMS).select("doc_id", "pos", "kind", "text", F.size("invalid").cast("long").alias("n_invalid"))


@query("o04_kept_block", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INTEGER) DESC, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END DESC NULLS FIRST, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, n FROM r WHERE i = 1""")
def o04(spark, d):
    dated = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date"))
    order = building.kept_order(F.substring("o_orderpriority", 1, 1).cast("int"), dated)
    return dedupe.keep_first(table(spark, d, "orders"), ["o_custkey"], order, "o_orderkey").select("o_custkey", "o_orderkey", "n")


@query("p07_lexical_text", "SELECT p_partkey, concat_ws(' ', p_name, p_type, CASE WHEN p_size > 25 THEN 'large' END, p_brand) AS lexical FROM part")
def p07(spark, d):
    tags = F.when(F.col("p_size") > 25, "large")
    return table(spark, d, "part").select("p_partkey", building.lexical_text(F.col("p_name"), F.col("p_type"), tags, F.col("p_brand")).alias("lexical"))


_KINDS_SQL = " OR ".join(f"regexp_matches(text, '{p}')" for p in pii.PATTERNS.values())


@query("j17_report_lists", f"""
WITH c AS (SELECT doc_id, text, doc_id <> max(doc_id) OVER (PARTITION BY lang, source) AS old, (SELECT count(DISTINCT source) FROM documents e WHERE e.text = documents.text) > 1 AS again FROM documents)
SELECT 'personal_data' AS list, doc_id FROM c WHERE {_KINDS_SQL} UNION ALL SELECT 'superseded', doc_id FROM c WHERE old UNION ALL SELECT 'near_duplicate', doc_id FROM c WHERE again""")
def j17(spark, d):
    """Documents that a newer one of their language and source supersedes, that hold personal data, or whose text other sources have too."""
    docs = table(spark, d, "documents").withColumn("key", F.sha2("text", 256))
    newest = docs.groupBy("lang", "source").agg(F.max("doc_id").alias("doc_id")).select("doc_id", F.lit("active").alias("status"))
    places = dedupe.sources_of(docs.where("text is not null"), ["key"], "source").select("key", "also_found_in")
    marked = docs.select("doc_id", "key", pii.kinds(F.col("text")).alias("pii_kinds")).join(newest, "doc_id", "left").join(places, "key", "left")
    return building.report_lists(marked.withColumn("status", F.coalesce("status", F.lit("superseded"))), "doc_id")
