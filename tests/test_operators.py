"""Small cases with known results."""

import tempfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quarry.functions import pii, text
from quarry.operators import calls, chunking, cleaning, conflicts, dedupe, normalizing, reports, retrieval, turns, versioning
from quarry.functions import ranks, spoken
from quarry.operators.dialogue import Field, merge_claims
from quarry.sources import markdown, web
from quarry.streaming import nudges, windows


def one(spark, value, column, name="x"):
    return spark.createDataFrame([(value,)], f"{name} string").select(column.alias("y")).first()["y"]


def test_running_lines(spark):
    pages = [["ACME | Policy Wording | UIN 1", "Body one.", "Footer text | Page 1"], ["ACME | Policy Wording | UIN 1", "Body two.", "Footer text | Page 2"]]
    rows = [("d", p + 1, i + 1, line) for p, ls in enumerate(pages) for i, line in enumerate(ls)]
    kept = cleaning.drop_running_lines(spark.createDataFrame(rows, "doc_id string, page int, pos int, line string")).orderBy("page").collect()
    assert [r["line"] for r in kept] == ["Body one.", "Body two."]


def test_boilerplate(spark):
    rows = [("s", d, t) for d in range(4) for t in ("Menu ", f"text {d}")] + [("t", 9, "Menu"), ("t", 8, "Menu")]
    df = spark.createDataFrame(rows, "source string, doc_id int, text string")
    assert [tuple(r) for r in cleaning.boilerplate(df).collect()] == [("s", "menu", 4)]
    assert cleaning.drop_boilerplate(df).count() == 6


def test_glyphs_terms_dates(spark):
    clean, counts = normalizing.repair_glyphs(F.col("x"), [(r"(?<![\p{L}])n(?=\d)", "₹"), ("■(?=\\d)", "₹")])
    r = spark.createDataFrame([("ambulance up to n2,000 and ■5 lakh; not inner2",)], "x string").select(clean.alias("c"), (counts[0] + counts[1]).alias("n")).first()
    assert tuple(r) == ("ambulance up to ₹2,000 and ₹5 lakh; not inner2", 2)
    terms = {"hospitalisation": ["hospitalization"], "sum insured": ["cover amount", "SI"], "auto-debit arrangement": ["ADA"]}
    said = "Cover amount and SI differ; Hospitalization counts. ADA (auto-debit arrangement). Simple: si, in-SI-de"
    r = spark.createDataFrame([(said,), (None,)], "x string").select(normalizing.terminology(F.col("x"), terms).alias("t")).select("t.*").collect()
    assert r[0]["text"] == "Sum insured and sum insured differ; Hospitalisation counts. auto-debit arrangement. Simple: si, in-SI-de"
    assert r[0]["hits"] == ["ADA", "SI", "cover amount", "hospitalization"] and r[1]["text"] is None
    cases = [("Since 1st April 2025.", "Since 2025-04-01.", []), ("01/04/2024 to April 1, 2025", "2024-04-01 to 2025-04-01", []), ("1 Januari 2025, 31/02/2025", "2025-01-01, 31/02/2025", ["31/02/2025"]), ("none", "none", [])]
    for said, clean, invalid in cases:
        got = one(spark, said, normalizing.dates(F.col("x")))
        assert (got["text"], got["invalid"]) == (clean, invalid)
    assert one(spark, "is my mom covered", normalizing.expanded(F.col("x"), {"parents": ["mother", "mom"], "spouse": ["wife"]})) == "is my mom covered parents"


def test_text_columns(spark):
    assert one(spark, "123450", text.indian_grouping(F.col("x"))) == "1,23,450"
    assert one(spark, "6400", text.indian_grouping(F.col("x"))) == "6,400"
    assert one(spark, "12", text.indian_grouping(F.col("x"))) == "12"
    for word, stem in [("menagih", "agih"), ("penagihan", "agih"), ("menyanyi", "anyi"), ("makan", "makan"), ("diberikan", "beri"), ("cicilannya", "cicilan"), ("kantor", "kantor"), ("terkan", "ter")]:
        assert one(spark, word, text.stem_id(F.col("x"))) == stem
    assert one(spark, "2.1 WHAT IS COVERED:", chunking.heading(F.col("x"))) == "What Is Covered" and one(spark, "Key facts", chunking.heading(F.col("x"), {"key facts": "Summary"})) == "Summary"
    assert one(spark, "4. Waiting Periods", chunking.heading(F.col("x"))) == "Waiting Periods"
    assert one(spark, "a b", F.size(text.shingles(text.words(F.col("x"))))) == 1
    assert one(spark, "", F.size(text.shingles(text.words(F.col("x"))))) == 1
    assert one(spark, "é  x", text.normalize_whitespace(F.col("x"))) == "é x"
    assert one(spark, None, text.normalize_whitespace(F.col("x"))) is None


def test_personal_data(spark):
    t = "Call me on +91 98765 43210 or mail ramesh.k@example.com, PAN ABCPV1234F"
    clean = one(spark, t, pii.redact(F.col("x")))
    assert clean == "Call me on [REDACTED_PHONE] or mail [REDACTED_EMAIL], PAN [REDACTED_IN_PAN]"
    assert one(spark, t, pii.kinds(F.col("x"))) == ["EMAIL", "IN_PAN", "PHONE"]
    assert one(spark, "2363", pii.verhoeff_valid(F.col("x"))) and not one(spark, "2364", pii.verhoeff_valid(F.col("x")))
    assert one(spark, "4539578763621486", pii.luhn_valid(F.col("x"))) and not one(spark, "4539578763621487", pii.luhn_valid(F.col("x")))


def test_outliers_and_contradictions(spark):
    df = spark.createDataFrame([(1, 5000.0), (2, 6000.0), (3, 70000.0), (4, None), (5, 9000.0)], "i int, v double").withColumn("s", F.lit("a"))
    assert [r["i"] for r in conflicts.outliers(df, ["s"], ["i"], "v").where("flagged").collect()] == [3]
    facts = spark.createDataFrame([("in", "wait", 24.0, 5, None, 1), ("in", "wait", 36.0, 2, "2025-01-01", 2), ("in", "age", 60.0, 1, None, 3)], "market string, fact string, value double, authority int, effective_date string, record_id int")
    rows = {r["record_id"]: r for r in conflicts.contradictions(facts).collect()}
    assert set(rows) == {1, 2} and rows[2]["needs_review"] and not rows[1]["needs_review"] and rows[2]["authoritative_value"] == 24.0


def test_versions(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "stable_key string, content_hash string")
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "stable_key string, content_hash string")
    assert {r["stable_key"]: r["change"] for r in versioning.changes(b, a).collect()} == {"a": "unchanged", "b": "updated", "c": "removed", "d": "added"}
    assert one(spark, "1.3", versioning.bump_minor(F.col("x"))) == "1.4"
    assert one(spark, "1.2.3", versioning.bump_release(F.col("x"), F.lit(0), F.lit(2), F.lit(0))) == "1.2.4"


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.col("id"))
    rows = dedupe.row_numbers(df, "g", "id").collect()
    assert all(r["n"] == r["id"] // 3 + 1 for r in rows)


def test_near_pairs_and_greedy_merge(spark):
    base = [f"w{i}" for i in range(80)]
    docs = [(1, " ".join(base)), (2, " ".join([*base[:79], "x"])), (3, " ".join(base)), (4, " ".join(f"v{i}" for i in range(80))), (5, "w1 w2"), (6, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("market", F.lit("m"))
    assert [(r["a"], r["b"]) for r in dedupe.near_pairs(df).collect()] == [(1, 2)]
    assert {r["doc_id"]: r["class_id"] for r in dedupe.classes(df).collect()}[3] == 1
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert sorted((r["gone"], r["kept"]) for r in dedupe.greedy_merge(pairs).collect()) == [(2, 1), (4, 3)]


def test_classes_without_a_market_and_of_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = [(1, None, long), (2, None, long), (3, "m", long), (4, "m", None), (5, "m", None), (6, "m", "")]
    df = spark.createDataFrame(docs, "doc_id long, market string, text string")
    found = dedupe.classes(df)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_retrieval_coverage(spark):
    docs = spark.createDataFrame([(1, "cosmetic exclusion"), (2, "covered dental"), (3, "covered opd"), (4, "covered room")], "doc_id long, text string")
    asked = retrieval.query_terms(spark.createDataFrame([(0, "cosmetic covered")], "item_id long, text string"))
    posted = retrieval.postings(docs)
    idf, size = retrieval.statistics(posted, docs)
    got = {r["id"]: r["coverage"] for r in retrieval.coverage(retrieval.bm25(posted, idf, size, asked), idf, size, asked).collect()}
    assert got[1] > got[2] == got[3] == got[4]


def test_turn_columns(spark):
    for heard, kind in [("okay.", "backchannel"), ("I would like to", "incomplete"), ("I am done.", "complete"), ("maybe later", "unknown"), ("हाँ।", "complete")]:
        assert one(spark, heard, turns.fast_class(F.col("x"))) == kind
    assert one(spark, "I'm 34 years old", turns.coerce_int(F.col("x"), 0, 99)) == 34
    assert one(spark, "yes", turns.coerce_bool(F.col("x"))) is True and one(spark, "perhaps", turns.coerce_bool(F.col("x"))) is None
    said = {"one lakh and fifty thousand": 150_000, "one hundred and five": None, "one hundred five": 105, "four thirty": None, "": None, "1.5 lakh": 150_000, "thirty four": 34, "34 and 31": None, "and": None, "thousand": 1000, "two lakh and": None, "nineteen hundred": 1900, "thirty twelve": None, "5 crore 3 lakh 20": 50_300_020}
    for phrase, n in said.items():
        assert one(spark, phrase, spoken.spoken_number(F.col("x"))) == n, phrase


def test_number_words(spark):
    said = lambda ns, language: [r[0] for r in spark.createDataFrame(list(enumerate(ns)), "i int, n long").orderBy("i").select(spoken.in_words(F.col("n"), language)).collect()]
    assert said([0, 7500, 1_000_000, 99, 12_00_00_000_000], "hi") == ["शून्य", "सात हज़ार पाँच सौ", "दस लाख", "निन्यानवे", "बारह हज़ार करोड़"]
    assert said([1_250_000, 1000, 121_000, 15, 100, 21_001_000], "id") == ["satu juta dua ratus lima puluh ribu", "seribu", "seratus dua puluh satu ribu", "lima belas", "seratus", "dua puluh satu juta seribu"]
    assert said([310_020, 7, 2_000_000_100, None], "en") == ["three hundred ten thousand twenty", "seven", "two billion one hundred", None]
    assert one(spark, "11320", spoken.amount_in_words(F.col("x").cast("double"), "INR")) == "eleven thousand three hundred rupees"
    assert one(spark, "-5", spoken.in_words(F.col("x").cast("long"))) == "minus five"
    for typed, read in [("sunday 3pm", "on Sunday at 3 PM"), ("tomorrow, 11:30 am", "tomorrow at 11:30 AM"), ("the weekend evening", "on the weekend, in the evening"), ("6 pm", "at 6 PM"), ("later", "later"), ("Friday, 9:15 P.M.", "on Friday at 9:15 PM"), ("this weekend", "on the weekend"), ("weekend after 4pm", "on the weekend after 4 PM"), ("tonight", "tonight")]:
        assert one(spark, typed, spoken.when_spoken(F.col("x"))) == read


def test_claims(spark):
    fields = [Field("stage", "enum", values=("view", "click", "buy"), widening=("view", "click")), Field("budget", "int", low=0, soft_max=100_000), Field("city", known=("pune", "delhi"))]
    said = [("stage", "view", 0.9, False), ("stage", "click", 0.9, False), ("stage", "view", 0.9, False), ("stage", "click", 0.9, False), ("stage", "buy", 0.9, True), ("stage", "sell", 0.9, False), ("shoe", "42", 0.9, False)]
    said += [("budget", "5 00 000", 0.9, False), ("budget", "500000", 0.9, False), ("budget", "20000", 0.9, False), ("budget", "30000", 0.9, False), ("budget", "40000", 0.9, None), ("city", "Ten", 0.9, False), ("city", "Pune", 0.9, False), ("city", "Agra", 0.9, False)]
    rows = [(1, f, float(i), i, v, c, k) for i, (f, v, c, k) in enumerate(said)]
    got = merge_claims(spark.createDataFrame(rows, "call_id long, field string, at double, seq long, raw string, confidence double, correction boolean"), fields).orderBy("seq").collect()
    assert [r["outcome"] for r in got] == ["set", "widened", "conflict", "confirmed", "corrected", "invalid", "unknown_field", "set", "conflict", "corrected", "conflict", "corrected", "set", "corrected", "conflict"]


def test_percentiles_of_large_groups(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") % 17).cast("double").alias("v")).union(spark.createDataFrame([(None, 3.0), (0, None)], "g long, v double"))
    got = {r["g"]: tuple(r)[1:] for r in ranks.at_places(df, ["g"], "v", {"a": ranks.nearest(0.5), "b": ranks.floored(0.95)}).collect()}
    for g in (0, 1):
        v = sorted(float(i % 17) for i in range(5000) if i % 2 == g)
        assert got[g] == (2500, 0.0, 16.0, v[int(0.5 * 2499 + 0.5)], v[int(0.95 * 2499)])
    assert got[None] == (1, 3.0, 3.0, 3.0, 3.0)


def test_crawl(spark):
    page = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    pages = [(1, "http://h/a", page("/a/b#top", "/a/c?q=1", "mailto:x@y", "http://other/a/z")), (2, "http://h/a/b", page("/a", "/a/dead")), (3, "http://h/a/c", page("/b/off")), (4, "http://h/b/off", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("http://h/a",)], "url string")
    got = {r["url"]: (r["depth"], r["stored"]) for r in web.crawl(df, seeds, "http://h/a").collect()}
    assert got == {"http://h/a": (0, True), "http://h/a/b": (1, True), "http://h/a/c": (1, True), "http://h/a/dead": (2, False)}
    assert {r["url"] for r in web.crawl(df, seeds, "http://h/a", max_pages=2).where("stored").collect()} == {"http://h/a", "http://h/a/b"}
    robots = spark.createDataFrame([("http://h/a/b",), ("http://other/",)], "prefix string")
    assert {r["url"] for r in web.crawl(df, seeds, "http://h/a", disallowed=robots).collect()} == {"http://h/a", "http://h/a/c"}
    chain = spark.createDataFrame([(i, f"http://c/{i}", page(f"/{i + 1}")) for i in range(14)], "page_id long, url string, html string")
    assert web.crawl(chain, spark.createDataFrame([("http://c/0",)], "url string"), "http://c/").count() == 15


def test_markdown(spark):
    rows = markdown.blocks(spark.createDataFrame([(1, "# T\n\npara one\nstill\n\n## H\n- item\nlast")], "doc_id long, text string"), "doc_id").orderBy("pos").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [("title", "T"), ("paragraph", "para one still"), ("heading", "H"), ("list_item", "item"), ("paragraph", "last")]


def test_as_of_forward(spark):
    left = spark.createDataFrame([("k", 1.0), ("k", 5.0), ("k", 9.0), ("z", 1.0)], "k string, t double")
    right = spark.createDataFrame([("k", 2.0, "a"), ("k", 5.0, "b")], "k string, u double, m string")
    assert [r["m"] for r in calls.as_of_forward(left, right, "k", "t", "u", "m").orderBy("k", "t").collect()] == ["a", "b", "b", None]


def test_expected_nudges(spark):
    want = spark.createDataFrame([(1, "k", 1, 0.0, 10.0), (1, "k", 2, 0.0, 10.0), (1, "k", 3, 50.0, 60.0)], "run long, key string, seq long, lo double, hi double")
    got = spark.createDataFrame([(1, "k", 9.0, 8), (1, "k", 3.0, 7)], "run long, key string, at double, id long")
    m = reports.match_expected(want, got)
    assert [(r["seq"], r["id"]) for r in m.orderBy("seq").collect()] == [(1, 7), (2, 8), (3, None)]
    assert tuple(reports.precision_recall(m, got).first()) == (2, 0, 1, 1.0, pytest.approx(0.666667))


T = {"gap": {"priority": 1, "topic": "c"}, "sell": {"priority": 3, "topic": "s"}, "ask": {"priority": 2, "topic": "q"}, "frustration": {"priority": 2, "topic": "f"}}


def signal(seq, at, key, **kw):
    return {"room": 1, "seq": seq, "at": float(at), "key": key, "speaker": "agent", "source": "rules", "confidence": 0.9, "asr_confidence": 0.9, "words": 9, "noisy": False} | kw


def decide(*signals, controls=nudges.Controls()):
    room, out = nudges.Room(), []
    for s in map(lambda s: SimpleNamespace(**s), signals):
        room = nudges.Room.of(room.text())
        room.expire(s.at)
        out.append(nudges.consider(room, s, T, controls)[-1][4])
    return out


def test_controls():
    assert decide(signal(1, 0, "frustration", asr_confidence=0.4)) == ["low_asr_confidence"]
    got = decide(signal(1, 0, "sell"), signal(2, 1, "gap"), signal(3, 2, "gap"), signal(4, 3, "ask"), signal(5, 20, "ask"), signal(6, 21, "sell"), signal(7, 23, "nothing"))
    assert got == ["passed_controls", "passed_controls", "duplicate_active_refreshed", "global_rate_limit", "passed_controls", "duplicate_active_refreshed", "informational_only"]
    assert decide(*[signal(i, i, k, confidence=0.1) for i, k in enumerate(("gap", "sell", "ask"))], controls=nudges.Controls(enabled=False)) == ["passed_controls"] * 3
    assert decide(signal(1, 0, "ask", noisy=True), signal(2, 1, "ask", speaker="customer", words=1), signal(3, 2, "ask", source="llm", confidence=0.7)) == ["noisy_agent_audio", "utterance_too_short", "low_confidence"]


def test_controls_on_what_is_shown():
    room, at = nudges.Room(), lambda i, key, **kw: SimpleNamespace(**signal(i, i * 10, key, **kw))
    for i, key in enumerate(("sell", "ask", "frustration")):
        nudges.consider(room, at(i, key), T, nudges.Controls())
    evicting = nudges.consider(room, at(3, "gap"), T, nudges.Controls())
    assert [(x[2], x[3], x[4]) for x in evicting] == [("sell", "superseded", "higher_priority"), ("gap", "emitted", "passed_controls")]
    assert [x[2] for x in room.resolve(["gap"], "disclosed", 31.0)] == ["gap"] and nudges.title("Tell", 2) == "Reminder: Tell" and nudges.title("Tell", 1) == "Tell"
    assert [(x[1], x[2], x[3]) for x in room.expire(100.0)] == [(55.0, "ask", "expired"), (65.0, "frustration", "expired")]


def test_batch_equals_stream(spark, data):
    from quarry.plans.call_queries import SLOW, TEMPLATES, signals

    stored = signals(spark, data)
    want = sorted(map(tuple, nudges.replay(stored, TEMPLATES, SLOW).collect()))
    folder = tempfile.mkdtemp(prefix="spark-")
    cuts = [0.0, *stored.approxQuantile("at", [0.3, 0.7], 0.01), 1e18]
    for low, high in zip(cuts, cuts[1:], strict=False):  # in order of time, as a stream has them
        stored.where((F.col("at") >= low) & (F.col("at") < high)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = nudges.stream(source, TEMPLATES, SLOW).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(200)
    got = sorted(map(tuple, spark.table("decided").collect()))
    lasting = stored.agg(F.max("at")).first()[0] - 15  # what ends later than the stream's own time goes on
    assert [x for x in got if x[4] != "expired"] == [x for x in want if x[4] != "expired"] and set(got) <= set(want)
    assert [x for x in got if x[4] == "expired" and x[2] < lasting] == [x for x in want if x[4] == "expired" and x[2] < lasting]


def test_stream_windows(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    folder = tempfile.mkdtemp(prefix="spark-")
    events.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    windows.to_table(windows.sessions(source, "6 hours"), f"{folder}/out", f"{folder}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{folder}/out").count() > 0
