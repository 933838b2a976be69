"""Releases: ids that stay, what a release writes, and builds that were cut off."""

import os
import tempfile

from pyspark.sql import functions as F

from quarry.operators import building, releases
from quarry.plans.registry import release_queries


def records(spark, rows):
    return spark.createDataFrame(rows, "stable_key string, prefix string, content_hash string, status string, body string")


def release(spark, root, rows):
    now = releases.build(records(spark, rows), root)
    manifest = {r["stable_key"]: (r["record_id"], r["version"], r["stored_in"]) for r in now.manifest.collect()}
    return now, manifest


def row(key, body, prefix="kb_in_faq"):
    return (key, prefix, body, "active", body)


def test_releases(spark):
    root = tempfile.mkdtemp(prefix="spark-") + "/kb"
    assert releases.current(spark, root) is None
    now, manifest = release(spark, root, [row("b", "two"), row("a", "one"), row("c", "three", "kb_ph_form")])
    assert now.kb_version == "1.0.0" and manifest == {"a": ("kb_in_faq_001", "1.0", 1), "b": ("kb_in_faq_002", "1.0", 1), "c": ("kb_ph_form_001", "1.0", 1)}
    # the same records are the same release
    now, again = release(spark, root, [row("b", "two"), row("a", "one"), row("c", "three", "kb_ph_form")])
    assert now.release == 1 and again == manifest
    # an update alone: the patch number, and only what changed is written
    now, manifest = release(spark, root, [row("a", "one"), row("b", "TWO"), row("c", "three", "kb_ph_form")])
    assert now.kb_version == "1.0.1" and manifest["b"] == ("kb_in_faq_002", "1.1", 2) and manifest["a"][2] == 1
    assert [r["stable_key"] for r in spark.read.parquet(releases.folder(root, "records", 2)).collect()] == ["b"]
    # removed ids aren't given again
    now, manifest = release(spark, root, [row("a", "one"), row("aa", "new"), row("c", "three", "kb_ph_form")])
    assert now.kb_version == "1.1.0" and manifest["aa"] == ("kb_in_faq_003", "1.0", 3) and "b" not in manifest
    assert {r["stable_key"]: r["body"] for r in releases.stored(spark, root, now).collect()} == {"a": "one", "aa": "new", "c": "three"}
    log = sorted((r["release"], r["record_id"], r["change"]) for r in releases.changelog(spark, root).collect())
    assert log[3:] == [(2, "kb_in_faq_002", "updated"), (3, "kb_in_faq_002", "removed"), (3, "kb_in_faq_003", "added")] and len(log) == 6


def test_a_build_that_was_cut_off(spark):
    root = tempfile.mkdtemp(prefix="spark-") + "/kb"
    release(spark, root, [row("a", "one")])
    for name in ("records", "manifest", "changelog"):  # what a second build left before its info stood
        spark.read.parquet(releases.folder(root, name, 1)).limit(0).write.parquet(releases.folder(root, name, 2))
    now = releases.current(spark, root)
    assert now.release == 1 and now.manifest.count() == 1
    now, manifest = release(spark, root, [row("a", "one"), row("b", "two")])
    assert now.release == 2 and manifest["b"] == ("kb_in_faq_002", "1.0", 2) and os.path.isdir(f"{root}/info")
    assert releases.changelog(spark, root).count() == 2


def test_knowledge_base(spark, data):
    """A second build over the same documents changes nothing; over changed ones it writes only their records."""
    root = tempfile.mkdtemp(prefix="spark-") + "/kb"
    made = release_queries.knowledge(spark, data).persist()
    first = releases.build(made, root)
    assert releases.build(made, root).release == first.release == 1
    revised = made.withColumn("content_hash", F.when(F.col("prefix") == "kb_fr_sec", F.lit("x")).otherwise(F.col("content_hash")))
    second = releases.build(revised, root)
    assert second.kb_version == "1.0.1" and spark.read.parquet(releases.folder(root, "records", 2)).select("prefix").distinct().collect() == [("kb_fr_sec",)]
    assert releases.stored(spark, root, second).count() == made.count() == first.manifest.select("record_id").distinct().count()
    assert not made.where(F.col("content").rlike(r"[a-z]@[a-z]+\.com")).count()


def test_files_that_cannot_be_read(spark):
    df = spark.createDataFrame([("1", "u", "json", '{"a": "b"}'), ("2", "u", "json", "{"), ("3", "u", "pdf", "x"), ("4", "u", None, "x"), ("5", "u", "text", "p\n\n q"), ("6", "u", "text", None)], "source_id string, uri string, type string, content string")
    blocks, issues = releases.extracted(df, release_queries.extractors())
    assert sorted(map(tuple, blocks.collect())) == [("1", 0, "a: b"), ("5", 0, "p"), ("5", 1, "q")]
    assert sorted((r["source_id"], r["detail"]) for r in issues.collect()) == [("2", "unreadable content"), ("3", "no extractor for pdf"), ("4", "no extractor for null"), ("6", "unreadable content")]


def test_blank_rows_of_a_sheet_do_not_count(spark):
    df = spark.createDataFrame([("s", i, str(i) if i < 8 else "") for i in range(12)], "sheet string, pos long, v string")
    got = building.sheet_chunks(df, ["sheet"], ["pos"], F.col("v")).collect()
    assert [(r["n_rows"], r["content"]) for r in got] == [(8, "\n".join(map(str, range(8))))]
