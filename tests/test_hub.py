"""The hub: events once, state by field, and what who joins is told."""

import json
import tempfile

from pyspark.sql import functions as F

from quarry.streaming import hub


def test_a_batch_that_runs_twice(spark, data):
    rows = spark.read.parquet(f"{data}/events.parquet")
    path = tempfile.mkdtemp(prefix="spark-") + "/hub"
    parts = [rows.where(F.col("event_id") % 3 == k) for k in range(3)]
    for number in (0, 1, 2, 1):
        hub.put_batch(parts[number], number, path)
    kept = hub.events(spark, path)
    assert kept.count() == rows.count() and "received_at" in kept.columns and kept.select("event_id").distinct().count() == rows.count()


def test_stream(spark, data):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = spark.read.parquet(f"{data}/events.parquet")
    rows.repartition(4).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for _ in range(2):  # the second run finds nothing new
        hub.publish(source, f"{folder}/out", f"{folder}/cp").awaitTermination(120)
    kept = hub.events(spark, f"{folder}/out")
    assert kept.select("batch").distinct().count() == 4 and sorted(r[0] for r in kept.select("event_id").collect()) == sorted(r[0] for r in rows.select("event_id").collect())


def test_state_and_snapshot(spark):
    rows = [("r", "n1", 1, "a", None), ("r", "n1", 2, None, "x"), ("r", "n1", 3, "b", None), ("r", "n2", 1, None, None), ("s", "n1", 9, "c", "y")]
    df = spark.createDataFrame(rows, "room string, id string, at long, title string, shown string")
    assert sorted(map(tuple, hub.latest_fields(df, ["room", "id"], ["at"], ["title", "shown"]).collect()), key=repr) == [("r", "n1", "b", "x"), ("r", "n2", None, None), ("s", "n1", "c", "y")]
    got = {r["room"]: [json.loads(e)["at"] for e in r["events"]] for r in hub.snapshot(df, "room", ["at", "id"], 3).collect()}
    assert got == {"r": [1, 2, 3], "s": [9]} and hub.snapshot(df.limit(0), "room", ["at"]).count() == 0
