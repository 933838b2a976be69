"""Each stage against what its operator says about that stage's own input."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from quarry.llm import decontam, language, simhash, toxicity
from quarry.llm.common import DOCUMENT_COLUMNS, table


def test_stages(spark, data, tmp_path):
    docs, given = table(spark, data, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given.append({r["doc_id"]: r["text"] for r in docs.collect()})
        out = stage(spark, docs, data)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == DOCUMENT_COLUMNS
        before = docs
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if i == 0:
            known = language.identify(before, language.learned(before)).where("score > 0")
            assert kept == {r["doc_id"] for r in known.collect()} and len(kept) >= 0.98 * len(given[0])
        elif i == 1:
            scored = toxicity.score(before, toxicity.learned(before, table(spark, data, "labels")))
            assert kept == {r["doc_id"] for r in scored.where("predicted = 0").collect()}
        elif i == 2:
            near = simhash.near_duplicates(before)
            assert kept == {r["component_id"] for r in near.collect()}
        elif i == 3:
            dirty = {r["doc_id"] for r in decontam.contamination(before, table(spark, data, "benchmark")).collect()}
            items = [r["text"] for r in table(spark, data, "benchmark").collect()]
            assert kept == set(given[3]) - dirty and not any(x in given[3][k] for k in kept for x in items)
    last = {r["doc_id"]: r["decoded_sha256"] for r in docs.collect()}
    assert last == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in given[4].items()}


def test_odd_rows(spark, data, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the words of the text and more of it", "en", "s", 1), (4, "x" * 50_000, "en", "s", 1), (4, "x" * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("component_id", F.lit("clash"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.count() <= len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0
