"""Ranked retrieval of documents for benchmark items, and of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import checkpoint
from ..operators import answers, retrieval, vectors
from .registry import query, table
from .text_queries import TOKENS_SQL

STATS_SQL = f"""
d AS (SELECT doc_id AS id, {TOKENS_SQL} AS ts FROM documents), p AS (SELECT id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM d) GROUP BY ALL),
z AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT term, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM f, z),
u AS (SELECT list_sort(list(idf))[count(*) // 2 + 1] AS unseen FROM i),
q AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({TOKENS_SQL}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25, count(*) AS n_matched, sum(idf) AS mass FROM p JOIN q USING (term) JOIN i USING (term), z GROUP BY ALL),
t AS (SELECT query, sum(coalesce(idf, unseen)) AS total FROM q LEFT JOIN i USING (term), u GROUP BY query),
c AS (SELECT query, id, bm25, n_matched, round(mass / total, 6) AS coverage FROM s JOIN t USING (query) WHERE bm25 > 0),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, id) - 1 AS rank FROM c) WHERE rank < 20),
r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY coverage DESC, id) - 1 AS rank FROM c) WHERE rank < 20),
fu AS (SELECT query, id, coalesce(1.0 / (r1.rank + 61), 0) + coalesce(1.0 / (r2.rank + 61), 0) AS rrf FROM r1 FULL JOIN r2 USING (query, id))"""


def scored(spark, d):
    docs, asked = table(spark, d, "documents"), retrieval.query_terms(table(spark, d, "benchmark"))
    idf, size = retrieval.statistics(retrieval.terms(docs), docs)
    posted = retrieval.postings(docs, asked=asked)
    size = checkpoint(size)
    return retrieval.coverage(retrieval.bm25(posted, idf, size, asked), idf, size, asked)


@query("a01_bm25_statistics", f"WITH {STATS_SQL} SELECT term, df, round(idf, 6) AS idf FROM i")
def a01(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.statistics(retrieval.terms(docs), docs)[0].select("term", "df", F.round("idf", 6).alias("idf"))


@query("a01_index_size", f"WITH {STATS_SQL} SELECT n_docs, round(avgdl, 6) AS avgdl, round(unseen, 6) AS unseen FROM z, u")
def a01_size(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.statistics(retrieval.terms(docs), docs)[1].select("n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("unseen", 6).alias("unseen"))


@query("a02_bm25_topk", f"WITH {STATS_SQL} SELECT query, id, bm25, rank FROM r1")
def a02(spark, d):
    return retrieval.ranked(scored(spark, d), "bm25").select("query", "id", "bm25", F.col("rank").cast("long").alias("rank"))


@query("a03_coverage", f"WITH {STATS_SQL} SELECT query, id, coverage, n_matched FROM c")
def a03(spark, d):
    return scored(spark, d).select("query", "id", "coverage", "n_matched")


@query("j02_fused_candidates", f"WITH {STATS_SQL} SELECT query, id, round(rrf, 8) AS rrf FROM fu")
def j02(spark, d):
    s = scored(spark, d)
    return retrieval.fuse(retrieval.ranked(s, "bm25"), retrieval.ranked(s, "coverage")).select("query", "id", F.round("rrf", 8).alias("rrf"))


HYBRID_SQL = f"""
WITH {STATS_SQL},
b AS (SELECT query, id, c.bm25, c.coverage, source, lang, round(rrf * (0.7 + 0.6 * c.coverage) * CASE source WHEN 'src1' THEN 0.9 WHEN 'src2' THEN 0.8 WHEN 'src3' THEN 0.85 ELSE 1 END, 8) AS score
 FROM fu JOIN c USING (query, id) JOIN documents ON doc_id = id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM b),
g AS (SELECT query, coverage >= 0.3 AS answered FROM k WHERE rank = 0)
SELECT query, id, rank, round(score, 6) AS score, round(coverage, 4) AS coverage, answered, '[' || id || '] ' || lang || ' — ' || source AS citation
FROM k JOIN g USING (query) WHERE rank < CASE WHEN answered THEN 3 ELSE 1 END"""


@query("p2_hybrid_search", HYBRID_SQL)
def hybrid(spark, d):
    """Top 3 documents for each benchmark item: BM25 and coverage ranks fused, boosted, gated by coverage, with a citation.

    documents have no vectors, so coverage stands for the dense list; a query whose best hit covers little gets that hit alone.
    """
    s = scored(spark, d)
    fused = retrieval.fuse(retrieval.ranked(s, "bm25"), retrieval.ranked(s, "coverage"), "coverage")
    kind = F.when(F.col("source") == "src1", "marketing").when(F.col("source") == "src2", "testimonial").when(F.col("source") == "src3", "reference").otherwise("policy")
    no = F.lit(False)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    rows = fused.join(docs, "id").withColumn("score", F.round(retrieval.boosted(F.col("rrf"), F.col("coverage"), kind, no, no, no), 8))
    hits = retrieval.ranked(rows, "score", 3)
    gate = hits.where("rank = 0").select("query", (F.col("coverage") >= retrieval.COVERAGE_GATE).alias("answered"))
    kept = hits.join(gate, "query").where(F.col("answered") | (F.col("rank") == 0))
    cited = answers.citation(F.col("id").cast("string"), F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    return kept.select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("coverage", 4).alias("coverage"), "answered", cited.alias("citation"))


NEAREST_SQL = """
n AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, a.label AS want, b.label AS got
 FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM n)"""


def neighbours(spark, d, k):
    """The k nearest other vectors of every vector whose id is divisible by 20."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = vectors.nearest(rows, rows.where("id % 20 = 0"), k + 1).where("id <> query")
    return retrieval.ranked(near.drop("rank"), "score", k)


@query("o02_nearest_vectors", f"WITH {NEAREST_SQL} SELECT query, id, score, rank FROM k WHERE rank < 20")
def o02(spark, d):
    return neighbours(spark, d, 20).select("query", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("a14_search_quality", f"""
WITH {NEAREST_SQL}, f AS (SELECT query, min(rank) FILTER (want = got) AS first FROM k WHERE rank < 20 GROUP BY query)
SELECT count(*) AS n, round(avg(CASE WHEN first = 0 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN first < 3 THEN 1.0 ELSE 0 END), 6) AS hit_3, round(avg(coalesce(1.0 / (first + 1), 0)), 6) AS mrr FROM f""")
def a14(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    near = neighbours(spark, d, 20).join(labels.withColumnsRenamed({"vec_id": "query", "label": "want"}), "query").join(labels.withColumnsRenamed({"vec_id": "id", "label": "got"}), "id")
    return retrieval.metrics(near.groupBy("query").agg(F.min(F.when(F.col("want") == F.col("got"), F.col("rank"))).alias("first")))


@query("f09_gate", f"""
WITH {NEAREST_SQL} SELECT query, score, (score >= 0.79 AND (score >= 0.845 OR want = got)) AS answered FROM k WHERE rank = 0""")
def f09(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    near = neighbours(spark, d, 1).join(labels.withColumnsRenamed({"vec_id": "query", "label": "want"}), "query").join(labels.withColumnsRenamed({"vec_id": "id", "label": "got"}), "id")
    cover = F.when(F.col("want") == F.col("got"), 1.0).otherwise(0.0)
    return near.select("query", "score", retrieval.passes_gate(F.col("score"), cover).alias("answered"))


@query("p04_relevance", f"WITH {NEAREST_SQL} SELECT query, id, CAST(round(least(greatest(score, 0), 1) * 100) AS INTEGER) AS rel, rank + 1 AS n FROM k WHERE rank < 3")
def p04(spark, d):
    return neighbours(spark, d, 3).select("query", "id", answers.relevance(F.col("score")).alias("rel"), (F.col("rank") + 1).cast("long").alias("n"))


@query("p02_context_lines", f"""
WITH {NEAREST_SQL} SELECT query, string_agg((rank + 1) || ': ' || id, chr(10) ORDER BY rank) AS context FROM k WHERE rank < 3 GROUP BY query""")
def p02(spark, d):
    lines = neighbours(spark, d, 3).select("query", "rank", F.concat((F.col("rank") + 1).cast("string"), F.lit(": "), F.col("id").cast("string")).alias("line"))
    packed = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return lines.groupBy("query").agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("context"))
