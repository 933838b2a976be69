"""Short answers, files and sinks: small cases with known results."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import answering, sinks, turns, versioning
from quarry.sources import files


@pytest.mark.parametrize(("kind", "said", "value"), [
    ("number", "I am just 41 years old", "41"), ("number", "Forty one.", "41"), ("amount", "3000 monthly", "36000"), ("amount", "12k", "12000"), ("amount", "perhaps 7 or 8 thousand", None), ("amount", "about 45,500 rupees per year", "45500"), ("amount", "2.5 lakh", "250000"),
    ("number", "41, Delhi", None), ("number", "41 and 12", None), ("number", "41?", None), ("number", "", None), ("number", None, None),
    ("yesno", "No, none of us do.", "false"), ("yesno", "Not really", None), ("yesno", "I think we do", None), ("yesno", "Of course, sir", "true"), ("yesno", "yes, but my aunt has asthma", None), ("yesno", "yes, we don't", None), ("yesno", "Okay.", None), ("yesno", "haan ji", "true"),
    ("city", "Im based in Lucknow", "lucknow"), ("city", "Surat", None), ("name", "Yeah, it's Meera", "Meera"), ("name", "my name is asha rao", "Asha Rao"), ("name", "yes", None), ("name", "Bot", None), ("name", "hello there how are you", None),
])
def test_answers(spark, kind, said, value):
    df = spark.createDataFrame([(said,)], "text string")
    assert answering.resolve(df, kind, known=("lucknow",), rejected=("bot",)).first()["value"] == value


def test_allowed_words_and_options(spark):
    df = spark.createDataFrame([("No, we have no pre-existing conditions.",)], "text string")
    assert answering.resolve(df, "yesno", allowed=("preexisting", "conditions")).first()["value"] == "false"
    said = {"the second one": 2, "the cheapest": 2, "the biggest plan": 3, "10": 1, "option 25": 3, "hm": None, "first or third": None, "third": 3}
    rows = spark.createDataFrame([(t,) for t in said], "text string").withColumn("options", F.array(F.lit(10), F.lit(5), F.lit(25)))
    assert {r["text"]: r["p"] for r in rows.select("text", answering.pick(answering.normal(F.col("text")), F.col("options")).alias("p")).collect()} == said


def test_fuzzy_columns(spark):
    df = spark.createDataFrame([("no waiting period", "there is no waiting periode at all", "a b c", "a x c d"), (None, "x", None, None)], "p string, w string, r string, h string")
    got = df.select(answering.partial_ratio("p", "w").alias("a"), answering.word_edits("r", "h").alias("b")).collect()
    assert tuple(got[0]) == (100.0, 2) and tuple(got[1]) == (0.0, 0)
    sets = spark.createDataFrame([("where is my refund", "my refund where is it"), ("a b", "c d"), (None, "x")], "p string, w string").select(answering.token_set_ratio("p", "w").alias("a")).collect()
    assert sets[0]["a"] == 100.0 and sets[1]["a"] < 50 and sets[2]["a"] == 0.0


def test_string_table_and_rates(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/t.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write('product, band ,rate\nA,18-25,"1,200"\nA,26-35,\n ,,\nB,18-25,007\n')
    rows = files.string_table(spark, path)
    assert rows.columns == ["product", "band", "rate"] and rows.count() == 3
    flagged = spark.createDataFrame([("B", "18-25")], "product string, band string")
    got = {(r["product"], r["band"]): r["rate"] for r in files.rates(rows, ["product", "band"], "rate", flagged).collect()}
    assert got == {("A", "18-25"): 1200.0, ("A", "26-35"): None, ("B", "18-25"): None}


def test_json_lines_runs_and_calls(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/a.jsonl", "w", encoding="utf-8") as f:
        f.write('{"kind":"asr","at":1.5}\n\n{"kind":"llm"}\n')
    assert {(r["kind"], r["at"]) for r in files.json_lines(spark, f"{folder}/*.jsonl", "kind string, at double").collect()} == {("asr", 1.5), ("llm", None)}
    assert files.json_lines(spark, f"{folder}/*.none", "kind string").count() == 0
    runs = spark.createDataFrame([("live-x",), ("y",)], "run string")
    labels = spark.createDataFrame([("x", 1)], "name string, expected int")
    assert {(r["run"], r["expected"]) for r in files.with_labels(runs, labels).collect()} == {("live-x", 1), ("y", None)}
    for n in ("1", "2"):
        os.makedirs(f"{folder}/calls/{n}")
        with open(f"{folder}/calls/{n}/result.json", "w", encoding="utf-8") as f:
            json.dump({"call_id": n, "grade": "hot", "extra": 1}, f, indent=1)
    got = files.recorded_calls(spark, f"{folder}/calls/*/result.json", "call_id string, grade string", ["call_id", "grade"]).collect()
    assert [r["call_id"] for r in got] == ["2", "1"]


def test_rule_files():
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/base.yaml", "w", encoding="utf-8") as f:
        f.write("signals: {quote: {patterns: [a], nudge: n}}\nwords: [x]\n")
    with open(f"{folder}/own.yaml", "w", encoding="utf-8") as f:
        f.write("extends: base.yaml\nsignals: {quote: {patterns: [b]}}\nwords: [y]\n")
    assert files.rule_file(f"{folder}/own.yaml") == {"signals": {"quote": {"patterns": ["a", "b"], "nudge": "n"}}, "words": ["x", "y"]}


def test_table_cells(spark):
    rows = spark.createDataFrame([("t", 1, ["Plan", "", "Age"]), ("t", 2, ["Gold", "x"]), ("p", 1, ["just", "text"])], "k string, pos int, vs array<string>")
    got = {(r["k"], r["pos"]): (r["kind"], r["text"]) for r in files.cells(rows, "k", "pos", "vs").collect()}
    assert got == {("t", 2): ("table_row", "Plan: Gold; col2: x; Age: "), ("p", 1): ("paragraph", "just text")}


def test_sinks(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([("r2", "active"), ("r1", "active"), ("r3", "superseded")], "record_id string, status string")
    sinks.write_records(df, f"{folder}/records")
    assert [r["record_id"] for r in spark.read.json(f"{folder}/records").orderBy("record_id").collect()] == ["r1", "r2", "r3"]
    for version in ("1.0.0", "1.0.1", "1.0.1"):
        sinks.write_version(df, f"{folder}/index", version)
    assert spark.read.parquet(f"{folder}/index").groupBy("kb_version").count().orderBy("kb_version").collect() == [("1.0.0", 2), ("1.0.1", 2)]
    same = spark.createDataFrame([("a", "1")], "stable_key string, content_hash string")
    assert not sinks.append_changes(versioning.changes(same, same), f"{folder}/log", "1.0.0")
    assert sinks.append_changes(versioning.changes(same.limit(0), same), f"{folder}/log", "1.0.0") and spark.read.parquet(f"{folder}/log").count() == 1
    df.write.json(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).json(f"{folder}/in")
    sinks.log_batches(stream, f"{folder}/out", f"{folder}/cp").awaitTermination(60)
    assert spark.read.json(f"{folder}/out").count() == 3
    assert sinks.with_json(df.select(F.struct("record_id").alias("s")), ["s"]).first()["s"] == '{"record_id":"r2"}'


def test_lines_by_turn(spark):
    df = spark.createDataFrame([(0, "Asha"), (1, None)], "t long, n string")
    line = turns.variant(["Hello {name}.", "Hello."], F.col("t"), {"name": F.col("n")})
    assert [r["x"] for r in df.select(line.alias("x")).collect()] == ["Hello Asha.", "Hello."]
