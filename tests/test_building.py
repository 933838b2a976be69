"""Records from sources of several kinds: small cases with known results."""

from pyspark.sql import functions as F

from quarry.operators import building


def test_normalized_blocks(spark):
    df = spark.createDataFrame([(1, 0, "heading", "2. WHAT IS COVERED:"), (1, 1, "paragraph", "The wait time ends on 3 March 2025, not 31/02/2025."), (1, 2, "paragraph", None)], "doc_id long, pos long, kind string, text string")
    got = {r["pos"]: (r["text"], r["invalid"]) for r in building.normalized(df, {"waiting period": ["wait time"]}).collect()}
    assert got == {0: ("What Is Covered", []), 1: ("The waiting period ends on 2025-03-03, not 31/02/2025.", ["31/02/2025"]), 2: (None, [])}


def test_sheets(spark):
    rows = [("long", i, f"v{i}") for i in range(9)] + [(None, 2, "b"), (None, 1, "a"), (None, 3, ""), ("empty", 1, "")]
    df = spark.createDataFrame(rows, "sheet string, pos int, v string")
    got = building.sheet_chunks(df, ["sheet"], ["pos"], building.cells_text({"v": F.col("v"), "w": F.lit("")})).collect()
    assert {(r["sheet"], r["n_rows"], r["content"]) for r in got} == {("long", 1, f"v: v{i}") for i in range(9)} | {(None, 2, "v: a\nv: b")}
    assert building.sheet_chunks(df.limit(0), ["sheet"], ["pos"], F.col("v")).count() == 0


def test_section_chunks(spark):
    said = "enough words to be kept as a chunk of this section"
    rows = [(1, 0, "paragraph", said), (1, 1, "heading", "Claims"), (1, 2, "list_item", said), (1, 3, "heading", "How do I pay?"), (1, 4, "paragraph", said)]
    blocks = spark.createDataFrame(rows, "doc_id long, pos long, kind string, text string")
    titles = spark.createDataFrame([(1, "Guide")], "doc_id long, title string")
    got = building.section_chunks(blocks, titles).orderBy("section_no").collect()
    assert [(r["title"], r["content"], r["parent_key"]) for r in got] == [("Guide", said, "1#0"), ("Guide › Claims", f"- {said}", "1#1"), ("How do I pay?", said, "1#2")]


def test_dispatch_takes_each_document_once(spark):
    kinds = spark.createDataFrame([(1, "form"), (2, "page"), (3, None)], "doc_id long, doc_type string")
    every = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    got = building.dispatched(kinds, {"form": every, "sections": every}, "sections").collect()
    assert {(r["doc_id"], r["branch"]) for r in got} == {(1, "form"), (2, "sections"), (3, "sections")} and len(got) == 3


def test_report_lists(spark):
    df = spark.createDataFrame([("a", ["EMAIL"], "superseded", None), ("b", [], "active", ["x"]), ("c", [], "active", [])], "record_id string, pii_kinds array<string>, status string, also_found_in array<string>")
    assert {(r["list"], r["record_id"]) for r in building.report_lists(df).collect()} == {("personal_data", "a"), ("superseded", "a"), ("near_duplicate", "b")}
