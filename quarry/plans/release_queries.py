"""Releases of a record set, from sources to a current version: each query builds its releases anew in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii
from ..functions.storage import shared_path
from ..operators import building, releases
from ..sources import markdown
from .knowledge_queries import TERMS
from .registry import query, table

#: Two states of the orders as records: without urgent ones, then without low ones and with large ones revised.
STATES_SQL = """o AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS stable_key, 'kb_' || lower(o_orderstatus) || '_' || substr(o_orderpriority, 1, 1) AS prefix, o_orderpriority AS p, o_totalprice > 400000 AS large FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY stable_key) AS n FROM o WHERE p <> '1-URGENT'), b AS (SELECT * FROM o WHERE p <> '5-LOW'),
c AS (SELECT prefix, count(*) AS base FROM a GROUP BY prefix),
m AS (SELECT b.stable_key, b.prefix, b.large, a.n AS old, coalesce(base, 0) AS base FROM b LEFT JOIN a USING (stable_key) LEFT JOIN c ON c.prefix = b.prefix),
r AS (SELECT stable_key, prefix, CASE WHEN old IS NOT NULL THEN old ELSE base + row_number() OVER (PARTITION BY prefix, old IS NULL ORDER BY stable_key) END AS n, old IS NULL AS new, old IS NOT NULL AND large AS revised FROM m),
ids AS (SELECT *, prefix || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS record_id FROM r),
removed AS (SELECT stable_key, prefix || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS record_id FROM a WHERE p = '5-LOW')"""


def released(spark, d) -> str:
    """Both states released one after the other; gives the root."""
    o = table(spark, d, "orders")
    records = o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("stable_key"), F.concat_ws("_", F.lit("kb"), F.lower("o_orderstatus"), F.substring("o_orderpriority", 1, 1)).alias("prefix"),
        F.sha2(F.col("o_totalprice").cast("string"), 256).alias("content_hash"), F.when(F.col("o_orderstatus") == "P", "superseded").otherwise("active").alias("status"), "o_orderpriority", "o_totalprice",
    )
    root = shared_path(spark, "releases")
    releases.build(records.where("o_orderpriority <> '1-URGENT'"), root)
    revised = F.when(F.col("o_totalprice") > 400000, F.concat("content_hash", F.lit("'"))).otherwise(F.col("content_hash"))
    releases.build(records.where("o_orderpriority <> '5-LOW'").withColumn("content_hash", revised), root)
    return root


@query("k03_manifest", f"WITH {STATES_SQL} SELECT stable_key, record_id, CASE WHEN revised THEN '1.1' ELSE '1.0' END AS version, CAST(CASE WHEN new OR revised THEN 2 ELSE 1 END AS BIGINT) AS stored_in FROM ids")
def k03_manifest(spark, d):
    return releases.current(spark, released(spark, d)).manifest.select("stable_key", "record_id", "version", "stored_in")


@query("k03_changelog", f"""
WITH {STATES_SQL} SELECT 1::BIGINT AS release, stable_key, prefix || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS record_id, 'added' AS change FROM a
UNION ALL SELECT 2, stable_key, record_id, CASE WHEN new THEN 'added' ELSE 'updated' END FROM ids WHERE new OR revised UNION ALL SELECT 2, stable_key, record_id, 'removed' FROM removed""")
def k03_changelog(spark, d):
    return releases.changelog(spark, released(spark, d))


@query("w09_counters", f"WITH {STATES_SQL} SELECT prefix, max(n) AS n FROM (SELECT prefix, n FROM ids UNION ALL SELECT prefix, n FROM a) GROUP BY prefix")
def w09_counters(spark, d):
    return releases.current(spark, released(spark, d)).counters.select("prefix", "n")


@query("s18_active_records", f"""
WITH {STATES_SQL} SELECT record_id, o_totalprice, '1.1.0' AS kb_version FROM ids JOIN orders ON lpad(CAST(o_orderkey AS VARCHAR), 9, '0') = stable_key WHERE o_orderstatus <> 'P'""")
def s18(spark, d):
    root = released(spark, d)
    now = releases.current(spark, root)
    return releases.active(releases.stored(spark, root, now), now.kb_version).select("record_id", "o_totalprice", "kb_version")


@query("k03_report", """
WITH r AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') SELECT 'o_orderpriority' AS list, o_orderpriority AS name, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT 'status', CASE WHEN o_orderstatus = 'P' THEN 'superseded' ELSE 'active' END, count(*) FROM r GROUP BY ALL""")
def k03_report(spark, d):
    root = released(spark, d)
    return releases.report(releases.stored(spark, root, releases.current(spark, root)), ["o_orderpriority", "status"])


def files(spark, d):
    """Documents, events and pages as files of several types, some of which nothing can read."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("source_id"), F.col("source").alias("uri"), F.when(F.col("lang") == "es", "odt").otherwise("text").alias("type"), F.col("text").alias("content"))
    props = F.when(F.col("event_type") == "error", F.substring("props", 1, 5)).otherwise(F.col("props"))
    events = table(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("source_id"), F.col("event_type").alias("uri"), F.lit("json").alias("type"), props.alias("content"))
    return docs.unionByName(events)


def extractors():
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return {"text": lines, "json": lambda c: F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: F.concat_ws(": ", e["key"], e["value"]))}


FILES_SQL = """f AS (SELECT 'd' || doc_id AS source_id, source AS uri, CASE WHEN lang = 'es' THEN 'odt' ELSE 'text' END AS type, text AS content FROM documents
UNION ALL SELECT 'e' || event_id, event_type, 'json', CASE WHEN event_type = 'error' THEN substr(props, 1, 5) ELSE props END FROM events)"""


@query("s12_source_blocks", f"""
WITH {FILES_SQL}, t AS (SELECT source_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM f WHERE type = 'text' AND content IS NOT NULL)
SELECT source_id, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS content FROM (SELECT source_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM t) GROUP BY source_id
UNION ALL SELECT source_id, 1, 'k: ' || CAST(json_extract_string(content, '$.k') AS VARCHAR) FROM f WHERE type = 'json' AND uri <> 'error'""")
def s12_blocks(spark, d):
    found, _ = releases.extracted(files(spark, d), extractors())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return found.groupBy("source_id").agg(F.count("*").alias("n"), F.array_join(ordered, "\n").alias("content"))


@query("s12_source_issues", f"WITH {FILES_SQL} SELECT source_id, uri, CASE WHEN type = 'odt' THEN 'no extractor for odt' ELSE 'unreadable content' END AS detail FROM f WHERE type = 'odt' OR content IS NULL OR uri = 'error'")
def s12_issues(spark, d):
    return releases.extracted(files(spark, d), extractors())[1]


def knowledge(spark, d):
    """Documents as records: sections cut to size, personal data taken out, hashed, named by language."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    blocks = building.normalized(markdown.blocks(docs.select("doc_id", "text"), "doc_id"), TERMS)
    chunks = building.section_chunks(blocks.select("doc_id", "pos", "kind", "text"), docs.select("doc_id", F.col("source").alias("title"), "lang"))
    clean = chunks.withColumn("pii_kinds", pii.kinds(F.col("content"))).withColumn("content", pii.redact(F.col("content")))
    key = F.concat_ws("#", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("section_no").cast("string"), 6, "0"), F.lpad(F.col("chunk_index").cast("string"), 6, "0"))
    hashed = F.sha2(F.concat_ws("\n", "title", "content"), 256)
    return clean.select(key.alias("stable_key"), F.concat_ws("_", F.lit("kb"), F.coalesce("lang", F.lit("und")), F.lit("sec")).alias("prefix"), hashed.alias("content_hash"), F.lit("active").alias("status"), "title", "content", "tokens", "pii_kinds", "parent_key")


@query("p1_knowledge_base")
def p1(spark, d):
    """From documents to the active records of a first release."""
    root = shared_path(spark, "knowledge")
    now = releases.build(knowledge(spark, d), root)
    return releases.active(releases.stored(spark, root, now), now.kb_version)
