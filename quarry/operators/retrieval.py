"""Ranked retrieval for a batch of queries: BM25, weighted coverage, fusion of ranks, boosts, and a gate for queries without an answer.

Statistics are of all documents of the index, whatever is filtered later. Scores are rounded before they are ranked, and ties go to
the smaller id, so that every engine ranks alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import reciprocal_rank
from ..functions.storage import checkpoint
from ..functions.text import tokens

K1, B, CANDIDATES, FUSION = 1.5, 0.75, 20, 60
#: Rows that are sent to tasks at most.
SENT = 1 << 20
PRIORS = {"testimonial": 0.8, "marketing": 0.9, "reference": 0.85}
DENSE_GATE, DENSE_SURE, COVERAGE_GATE = 0.79, 0.845, 0.30


def postings(docs: DataFrame, id_column: str = "doc_id", asked: DataFrame | None = None) -> DataFrame:
    """Rows (id, term, tf, dl): how often a term stands in a document, and the document's length in terms; of asked terms alone, if given.

    Documents are dealt by id once, as texts; their terms are then counted, met and scored where they stand.
    """
    rows = docs.select(F.col(id_column).alias("id"), "text").repartition("id").select("id", tokens(F.col("text")).alias("ts"))
    each = rows.select("id", F.size("ts").alias("dl"), F.explode_outer("ts").alias("term")).where("term is not null")
    if asked is not None:
        each = each.join(_sent(asked.select("term").distinct()), "term")
    return each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl")


def terms(docs: DataFrame) -> DataFrame:
    """Rows (term), one for each document that holds it: all that statistics need of postings, without bringing documents together."""
    return docs.select(F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("term")).where("term is not null")


def _sent(rows: DataFrame) -> DataFrame:
    """Rows of a stated query set, sent to tasks where they are SENT at most, a checked number; else joined as any others."""
    kept = checkpoint(rows)
    return F.broadcast(kept) if kept.count() <= SENT else kept


def statistics(posted: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (term, df, idf), and one row (n_docs, avgdl, unseen): the inverse frequency of unseen terms is the upper median of all."""
    size = docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = checkpoint(posted.groupBy("term").agg(F.count("*").alias("df")))
    idf = df.crossJoin(size).select("term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    # idf falls as df rises: its upper median is found over the few distinct frequencies, not over all terms
    by_df = idf.groupBy("df", "idf").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("df")))
    median = by_df.withColumn("upto", upto).crossJoin(by_df.agg(F.sum("n").alias("all"))).where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("idf").alias("unseen"))
    return idf, size.crossJoin(median)


def query_terms(queries: DataFrame, id_column: str = "item_id") -> DataFrame:
    """Rows (query, term, qtf): repeated terms count as often as they stand."""
    return queries.select(F.col(id_column).alias("query"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))


def bm25(posted: DataFrame, idf: DataFrame, size: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (query, id, bm25, matched) of positive scores. Postings meet only terms that are asked for."""
    wanted = _sent(asked.join(idf, "term"))
    met = posted.join(wanted, "term").crossJoin(F.broadcast(size.select("avgdl")))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query", "id").agg(F.round(F.sum(part), 6).alias("bm25"), F.count("*").alias("n_matched"), F.sum("idf").alias("mass")).where("bm25 > 0")


def coverage(scored: DataFrame, idf: DataFrame, size: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds coverage: the share of a query's inverse-frequency mass that a document holds. Unseen terms weigh the index's median."""
    known = asked.join(idf, "term", "left").crossJoin(F.broadcast(size.select("unseen")))
    total = known.groupBy("query").agg(F.sum(F.coalesce("idf", "unseen")).alias("total"))
    return scored.join(_sent(total), "query").withColumn("coverage", F.round(F.col("mass") / F.col("total"), 6)).drop("mass", "total")


def ranked(scored: DataFrame, score: str, most: int = CANDIDATES, name: str = "rank") -> DataFrame:
    """The best rows of each query with their rank from 0."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(score), "id"))
    # the plain comparison lets Spark drop what is behind the best of its partition before rows are moved
    return scored.withColumn("_place", place).where(F.col("_place") <= most).withColumn(name, F.col("_place") - 1).drop("_place")


def fuse(first: DataFrame, second: DataFrame, *keep: str) -> DataFrame:
    """Candidates (query, id, rank) of two lists, full outer, with the columns kept: a list that lacks a row adds nothing."""
    a = first.select("query", "id", F.col("rank").alias("r1"), *[F.col(c).alias(f"{c}_1") for c in keep])
    b = second.select("query", "id", F.col("rank").alias("r2"), *[F.col(c).alias(f"{c}_2") for c in keep])
    both = a.join(b, ["query", "id"], "full_outer").withColumn("rrf", reciprocal_rank(F.col("r1"), FUSION) + reciprocal_rank(F.col("r2"), FUSION))
    return both.select("query", "id", "r1", "r2", "rrf", *[F.coalesce(f"{c}_1", f"{c}_2").alias(c) for c in keep])


def boosted(rrf: Column, cover: Column, doc_type: Column, product_match: Column, age_match: Column, needs_review: Column) -> Column:
    """The fused score after coverage, prior of the document's type, matches and a penalty for what needs review."""
    prior = F.lit(1.0)
    for kind, weight in PRIORS.items():
        prior = F.when(doc_type == kind, weight).otherwise(prior)
    return rrf * (0.7 + 0.6 * cover) * prior * F.when(product_match, 1.3).otherwise(1.0) * F.when(age_match, 1.3).otherwise(1.0) * F.when(needs_review, 0.5).otherwise(1.0)


def passes_gate(dense: Column, cover: Column, rerank: Column | None = None) -> Column:
    """Whether a best hit answers its query: similar enough, and either surely so or covering the query. A reranker's sign overrules."""
    if rerank is not None:
        return rerank > 0
    return (dense >= DENSE_GATE) & ((dense >= DENSE_SURE) | (cover >= COVERAGE_GATE))


def metrics(ranks: DataFrame) -> DataFrame:
    """hit@1, hit@3 and mean reciprocal rank over rows (query, first): the first right rank from 0, null if there is none."""
    return ranks.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(F.col("first") == 0, 1.0).otherwise(0.0)), 6).alias("hit_1"),
        F.round(F.avg(F.when(F.col("first") < 3, 1.0).otherwise(0.0)), 6).alias("hit_3"),
        F.round(F.avg(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0))), 6).alias("mrr"),
    )
