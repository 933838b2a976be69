"""Releases of a record set: ids that stay, versions that follow changes, and a snapshot that is swapped at once.

A release writes only what it changed: records that are new or whose content differs, into a folder of their own. The manifest names for each
record its id, version, hash and the release that stored it; counters of ids by prefix go on from release to release. The one row of
`info`, written last, makes a release the current one: until it stands, readers see the release before, and a build that was cut off
leaves nothing that counts; the same number is built again over what it left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import running_totals
from ..functions.storage import checkpoint, exists
from . import versioning

FIRST = "1.0.0"
MANIFEST = "stable_key string, prefix string, record_id string, content_hash string, version string, stored_in long"
COUNTERS = "prefix string, n long"
INFO = "release long, kb_version string, added long, updated long, removed long, records long"


@dataclass
class Snapshot:
    """A release as it stands in its folder."""

    release: int
    kb_version: str
    manifest: DataFrame
    counters: DataFrame


def folder(root: str, table: str, release: int) -> str:
    return f"{root}/{table}/release={release}"


def current(spark: SparkSession, root: str) -> Snapshot | None:
    """The newest release whose info stands; None before the first."""
    if not exists(spark, f"{root}/info"):
        return None
    last = spark.read.schema(INFO).parquet(f"{root}/info").orderBy(F.desc("release")).first()  # one row a release
    if last is None:
        return None
    read = lambda table, schema: spark.read.schema(schema).parquet(folder(root, table, last["release"]))
    return Snapshot(last["release"], last["kb_version"], read("manifest", MANIFEST), read("counters", COUNTERS))


def numbered(records: DataFrame, before: Snapshot | None, release: int) -> tuple[DataFrame, DataFrame]:
    """Rows (stable_key, prefix, content_hash, record_id, version, stored_in, change) of records; and the counters after them.

    A known key keeps its id, and its version moves on if its content differs. New keys are numbered within their prefix in order of key, from
    the counter on; no prefix comes together in one task. Ids of removed keys are never given again. Only these columns are moved.
    """
    records = records.select("stable_key", "prefix", "content_hash")
    spark = records.sparkSession
    manifest = before.manifest if before else spark.createDataFrame([], MANIFEST)
    counters = before.counters if before else spark.createDataFrame([], COUNTERS)
    old = manifest.select("stable_key", F.col("record_id").alias("_id"), F.col("content_hash").alias("_hash"), F.col("version").alias("_version"), F.col("stored_in").alias("_stored"))
    known = checkpoint(records.join(old, "stable_key", "left"))
    fresh = running_totals(known.where("_id is null"), ["prefix"], ["stable_key"], name="_n").join(counters.withColumnRenamed("n", "_from"), "prefix", "left")
    number = F.coalesce("_from", F.lit(0)) + F.col("_n")
    added = fresh.select(*records.columns, F.concat_ws("_", "prefix", F.lpad(number.cast("string"), F.greatest(F.lit(3), F.length(number.cast("string"))), F.lit("0"))).alias("record_id"), F.lit("1.0").alias("version"), F.lit(release).cast("long").alias("stored_in"), F.lit("added").alias("change"))
    same = F.col("_hash") == F.col("content_hash")
    version = F.when(same, F.col("_version")).otherwise(versioning.bump_minor(F.col("_version")))
    kept = known.where("_id is not null").select(*records.columns, F.col("_id").alias("record_id"), version.alias("version"), F.when(same, F.col("_stored")).otherwise(release).cast("long").alias("stored_in"), F.when(same, "unchanged").otherwise("updated").alias("change"))
    counts = counters.union(added.groupBy("prefix").agg(F.count("*").alias("n"))).groupBy("prefix").agg(F.sum("n").alias("n"))
    return added.unionByName(kept), counts


def build(records: DataFrame, root: str) -> Snapshot:
    """Releases records (stable_key, prefix, content_hash and their own columns) under root; the same records again make the same release again.

    Additions or removals raise the release's minor number, updates alone its patch number. A changelog is kept of releases that changed something.
    """
    spark = records.sparkSession
    before = current(spark, root)
    release = before.release + 1 if before else 1
    records = checkpoint(records)
    placed, counters = numbered(records, before, release)
    placed = checkpoint(placed)
    gone = None
    if before:
        gone = before.manifest.join(placed.select("stable_key"), "stable_key", "left_anti").select("stable_key", "record_id", F.lit("removed").alias("change"))
    changes = placed.where("change <> 'unchanged'").select("stable_key", "record_id", "change")
    changes = checkpoint(changes.union(gone) if gone is not None else changes)
    n = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    if before and not n:
        return before
    counted = spark.range(1).select(F.lit(before.kb_version if before else FIRST).alias("v"), *[F.lit(n.get(c, 0)).cast("long").alias(c) for c in ("added", "updated", "removed")])
    bumped = versioning.bump_release(F.col("v"), F.col("added"), F.col("updated"), F.col("removed")) if before else F.col("v")
    changed = placed.where("change <> 'unchanged'").select("stable_key", "record_id", "version")
    records.join(changed, "stable_key").select(*records.columns, "record_id", "version").write.mode("overwrite").parquet(folder(root, "records", release))
    placed.select(*[x.split()[0] for x in MANIFEST.split(", ")]).write.mode("overwrite").parquet(folder(root, "manifest", release))
    counters.write.mode("overwrite").parquet(folder(root, "counters", release))
    changes.write.mode("overwrite").parquet(folder(root, "changelog", release))
    info = counted.select(F.lit(release).cast("long").alias("release"), bumped.alias("kb_version"), "added", "updated", "removed", F.lit(placed.count()).cast("long").alias("records"))
    info.coalesce(1).write.mode("append").parquet(f"{root}/info")
    return current(spark, root)


def stored(spark: SparkSession, root: str, snapshot: Snapshot) -> DataFrame:
    """The records of a release, each from the folder of the release that stored it. What it stored itself is all its own and is not joined."""
    parts = spark.read.option("basePath", f"{root}/records").parquet(f"{root}/records").withColumn("release", F.col("release").cast("long"))
    now = F.col("release") == snapshot.release
    named = snapshot.manifest.select("stable_key", F.col("stored_in").alias("release"))
    return parts.where(now).unionByName(parts.where(~now).join(named, ["stable_key", "release"])).drop("release") if snapshot.release > 1 else parts.where(now).drop("release")


def active(records: DataFrame, kb_version: str) -> DataFrame:
    """What is searched: active records, under the release's name."""
    return records.where("status = 'active'").withColumn("kb_version", F.lit(kb_version))


def changelog(spark: SparkSession, root: str) -> DataFrame:
    """Rows (release, stable_key, record_id, change) of all finished releases."""
    done = spark.read.schema(INFO).parquet(f"{root}/info").select("release")
    rows = spark.read.option("basePath", f"{root}/changelog").parquet(f"{root}/changelog").withColumn("release", F.col("release").cast("long"))
    return rows.join(done, "release", "left_semi").select("release", "stable_key", "record_id", "change")


def report(records: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (list, name, n): how many records there are by each of the columns, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).cast("string").alias("name")) for c in columns])
    return records.select(F.explode(pairs).alias("x")).groupBy("x.list", "x.name").agg(F.count("*").alias("n"))


def extracted(files: DataFrame, extractors: dict) -> tuple[DataFrame, DataFrame]:
    """Blocks (source_id, pos, text) and issues (source_id, uri, detail) of files (source_id, uri, type, content).

    extractors: for each type a function of the file's content column that gives an array of texts, null where it can't be read.
    A file of no known type, or that can't be read, is an issue and nothing else: the others go on.
    """
    texts, known = F.lit(None).cast("array<string>"), F.lit(False)
    for kind, extract in extractors.items():
        texts = F.when(F.col("type") == kind, extract(F.col("content"))).otherwise(texts)
        known = known | (F.col("type") == kind)
    read = files.select("source_id", "uri", "type", F.coalesce(known, F.lit(False)).alias("known"), texts.alias("texts"))
    blocks = read.where("texts is not null").select("source_id", F.posexplode("texts").alias("pos", "text"))
    why = F.when(F.col("known"), F.lit("unreadable content")).otherwise(F.concat(F.lit("no extractor for "), F.coalesce("type", F.lit("null"))))
    return blocks, read.where("texts is null").select("source_id", "uri", why.alias("detail"))
