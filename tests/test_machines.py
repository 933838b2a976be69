"""Keyed machines: cases with known results, and batch against stream."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.plans import stream_queries
from quarry.streaming import commits, extraction, machines, opportunities, utterances
from quarry.streaming.nudges import Controls

SAID = "room long, seq long, at double, speaker string, raised array<string>, addressed array<string>"


def events(spark, rows, **kw):
    df = spark.createDataFrame([(1, i, float(at), who, raised, addressed) for i, (at, who, raised, addressed) in enumerate(rows)], SAID)
    return [(r["at"], r["key"], r["event"]) for r in opportunities.tracked(df, **kw).orderBy("at", "seq", "key", "event").collect()]


def test_opportunities(spark):
    opened = [(0, "customer", ["plan"], None)]
    assert events(spark, opened) == [(0, "plan", "opened"), (25, "plan", "escalated")]
    # utterances of one turn count once; the second turn escalates, and only once
    turns = [(1, "agent", None, None), (2, "agent", None, []), (3, "customer", [], None), (4, "agent", None, ["rider"]), (5, "customer", ["plan", "rider"], None)]
    assert events(spark, opened + turns) == [(0, "plan", "opened"), (4, "plan", "escalated")]
    assert events(spark, [*opened, (3, "agent", None, ["plan"]), (9, "customer", ["plan"], None)]) == [(0, "plan", "opened"), (3, "plan", "resolved")]
    assert events(spark, [*opened, (30, "agent", None, ["plan"])]) == [(0, "plan", "opened"), (25, "plan", "escalated"), (30, "plan", "resolved")]
    assert events(spark, [(0, "customer", None, None)]) == []


def test_held_escalations_are_tried_again(spark):
    templates = {"missed_opportunity": {"priority": 2, "topic": "sales", "ttl_s": 30}}
    rows = [(0, "customer", ["plan"], None), (2, "customer", ["rider"], None), (60, "agent", None, ["rider"])]
    got = events(spark, rows, templates=templates, controls=Controls(cooldown_s=0, gap_s=8))
    # two seconds after the first escalation the second is too soon; nine later it is not
    assert got == [(0, "plan", "opened"), (2, "rider", "opened"), (25, "plan", "escalated"), (27, "rider", "held"), (36, "rider", "escalated"), (60, "rider", "resolved")]


def decisions(spark, rows, **context):
    context = {"agent_speaking": False, "yes_no": False, "paused": False} | context
    df = spark.createDataFrame([(1, i, float(at), kind, text, *context.values()) for i, (at, kind, text) in enumerate(rows)], "call long, seq long, at double, kind string, text string, agent_speaking boolean, yes_no boolean, paused boolean")
    return [(round(r["at"], 6), r["decision"], r["text"]) for r in commits.committed(df).orderBy("at").collect()]


def test_turn_commits(spark):
    speech = lambda text, end=1.0: [(0, "start", None), (end - 0.1, "final", text), (end, "end", None)]
    assert decisions(spark, speech("I want a plan.")) == [(1.0, "committed", "I want a plan.")]
    assert decisions(spark, speech("I want a plan and")) == [(1.8, "committed", "I want a plan and")]
    assert decisions(spark, speech("I want")) == [(2.0, "committed", "I want")]
    assert decisions(spark, speech("yes")) == [(1.8, "committed", "yes")]
    assert decisions(spark, speech("yes"), yes_no=True) == [(1.4, "committed", "yes")]
    assert decisions(spark, speech("yes"), agent_speaking=True) == [(1.0, "discarded", "yes")]
    assert decisions(spark, speech("I want a plan."), paused=True) == [(1.0, "discarded", "I want a plan.")]
    # new speech cancels, and the later words count
    assert decisions(spark, [*speech("I want"), (1.9, "start", None), (2.5, "final", "a plan."), (3, "end", None)]) == [(1.9, "cancelled", "I want"), (3.0, "committed", "a plan.")]
    # a final that comes after the pause began; noise alone commits nothing
    assert decisions(spark, [(0, "start", None), (1, "end", None), (1.5, "final", "Late words.")]) == [(1.6, "committed", "Late words.")]
    assert decisions(spark, [(0, "start", None), (1, "end", None), (1.7, "final", "Later words.")]) == [(1.7, "committed", "Later words.")]
    assert decisions(spark, [(0, "start", None), (1, "end", None)]) == []
    # the final of words that were committed from their interim
    assert decisions(spark, [(0, "start", None), (0.9, "interim", "A plan."), (1, "end", None), (2, "final", "a plan"), (5, "final", "A plan.")]) == [(1.0, "committed", "A plan."), (5.0, "committed", "A plan.")]
    # words that only stand inside longer ones are new
    assert decisions(spark, [*speech("Blue eyesight."), (1.5, "start", None), (2, "final", "yes"), (2.1, "end", None)]) == [(1.0, "committed", "Blue eyesight."), (2.9, "committed", "yes")]
    # words older than the window are forgotten
    assert decisions(spark, [(0, "final", None), (0.5, "start", None), (1, "interim", "Old words."), (7, "end", None)]) == []


def test_late_extraction(spark):
    row = lambda seq, at, kind, turn, updates=None: (1, seq, float(at), kind, turn, "ask", updates and json.dumps(updates))
    rows = [row(0, 0, "asked", 1), row(1, 1.4, "result", 1, {"age": "3"}), row(2, 2, "asked", 2), row(3, 20, "asked", 3), row(4, 11.4, "result", 2, {"age": "4", "city": None}), row(5, 29.6, "result", 3, {"age": "5"})]
    df = spark.createDataFrame(rows, "call long, seq long, at double, kind string, turn long, intent string, updates string")
    got = [(r["at"], r["turn"], r["path"], r["intent"], json.loads(r["fields"]), r["lost"]) for r in extraction.extracted(df).orderBy("at").collect()]
    assert got == [
        (1.4, 1, "on_time", "ask", {"age": "3"}, 0), (3.5, 2, "timeout", None, {"age": "3"}, 0), (11.4, 2, "late", None, {"age": "4"}, 0),
        (21.5, 3, "timeout", None, {"age": "4"}, 0), (29.5, 3, "lost", None, {"age": "4"}, 1), (29.6, 3, "unasked", None, {"age": "4"}, 1),
    ]
    assert [tuple(r) for r in extraction.merged_fields(extraction.extracted(df)).collect()] == [(1, "age", "4")]


CASES = {
    "opportunities": (stream_queries.said, lambda df: opportunities.tracked(df, seconds=21600.0), lambda df: opportunities.stream(df, seconds=21600.0)),
    "commits": (stream_queries.heard, commits.committed, commits.stream),
    "extraction": (stream_queries.extractions, extraction.extracted, extraction.stream),
    "utterances": (stream_queries.recognized, utterances.numbered, utterances.stream),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_batch_equals_stream(spark, data, name):
    rows, batch, stream = CASES[name]
    stored = rows(spark, data).persist()
    key = stored.columns[0] if "room" not in stored.columns else "room"
    # a far row of a key of its own moves the watermark past all timers
    end = stored.agg(F.max("at")).first()[0] + 1e6
    far = stored.limit(1).withColumn(key, F.lit(-1).cast("long")).withColumn("at", F.lit(end))
    folder = tempfile.mkdtemp(prefix="spark-")
    cuts = [-1.0, *stored.approxQuantile("at", [0.3, 0.7], 0.01), end - 1]
    for low, high in zip(cuts, cuts[1:], strict=False):
        stored.where((F.col("at") > low) & (F.col("at") <= high)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    far.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    run.awaitTermination(300)
    got = sorted((tuple(r) for r in spark.table(name).collect() if r[0] != -1), key=repr)
    want = sorted(map(tuple, batch(stored).collect()), key=repr)
    assert got == want and len(got) > 50


def test_empty(spark, data):
    for rows, batch, _ in CASES.values():
        assert batch(rows(spark, data).limit(0)).count() == 0
    assert machines.caught_up(opportunities.Opportunities(2, 25.0, None, Controls()), 1e9) == []
