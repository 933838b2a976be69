"""Further operators over the driver tables: evaluation conditions, evidence checks, short answers, table rows, preferences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks, spoken, text
from ..operators import answering, answers, calls, normalizing, turns
from ..sources import files
from .registry import query, table
from .text_queries import CLAUSES_SQL, WORDS_SQL


@query("f10_eval_conditions", """
SELECT doc_id, (contains(lower(text), 'the') AND contains(lower(text), 'tion')) OR (lang IN ('fr', 'es') AND contains(lower(text), 'que')) AS expected FROM documents""")
def f10(spark, d):
    low = F.lower("text")
    every = lambda *parts: F.forall(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))
    return table(spark, d, "documents").select("doc_id", (every("the", "tion") | (F.col("lang").isin("fr", "es") & every("que"))).alias("expected"))


@query("f11_active_nudges", """
SELECT event_id FROM events WHERE event_type = 'click' AND ts + to_seconds(CAST(value AS BIGINT) * 3600) > TIMESTAMP '2024-01-20'""")
def f11(spark, d):
    expires = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.bround("value", 0).cast("long") * 3600
    return table(spark, d, "events").where((F.col("event_type") == "click") & (expires > F.unix_seconds(F.lit("2024-01-20").cast("timestamp")))).select("event_id")


@query("f14_evidence", """
SELECT conv_id, turn, contains(lower(text), 'tion') AND regexp_matches(lower(text), 'the|que') AS verified FROM conversations WHERE role = 'user'""")
def f14(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", (F.contains(F.lower("text"), F.lit("tion")) & F.lower("text").rlike("the|que")).alias("verified"))


@query("f14_fuzzy_evidence")
def f14_fuzzy(spark, d):
    """How well each turn's first clause is found in the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.try_element_at(text.clauses(F.lower("text")), F.lit(1)).alias("part"), F.lag(F.lower("text")).over(w).alias("whole"))
    return rows.select("conv_id", "turn", F.round(answering.partial_ratio("part", "whole"), 4).alias("ratio"))


@query("f17_caller_guard", f"""
WITH c AS (SELECT conv_id, turn, list_filter({CLAUSES_SQL}, lambda s: NOT regexp_matches(lower(s), 'licen|policy|premium')) AS cs FROM conversations WHERE role = 'user')
SELECT conv_id, turn, array_to_string(cs[1:2], ' ') AS reply FROM c""")
def f17(spark, d):
    kept = F.filter(text.clauses(F.col("text")), lambda s: ~F.lower(s).rlike("licen|policy|premium"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(F.slice(kept, 1, 2), " ").alias("reply"))


SYNONYMS = {"article": ["the", "than"], "joiner": ["que", "und"]}


@query("c10_query_expansion", f"""
WITH q AS (SELECT item_id, text, {WORDS_SQL} AS ws FROM benchmark)
SELECT item_id, text || CASE WHEN list_has_any(ws, ['the', 'than']) AND NOT contains(lower(text), 'article') THEN ' article' ELSE '' END || CASE WHEN list_has_any(ws, ['que', 'und']) AND NOT contains(lower(text), 'joiner') THEN ' joiner' ELSE '' END AS expanded FROM q""")
def c10(spark, d):
    return table(spark, d, "benchmark").select("item_id", normalizing.expanded(F.col("text"), SYNONYMS).alias("expanded"))


#: Cues in the words that the conversations hold, and their SQL: scores of words, none of which may be left over.
CUES = answering.Cues(yes=("the", "und"), no=("of", "les"), unsure=("maybe",), fillers=("to", "die", "que", "de", "la", "and", "a", "in"))
SAID_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '[''’]', '', 'g'), '([\p{L}\p{N}_])-([\p{L}\p{N}_])', '\1\2', 'g'), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g'))"""


@query("c28_polarity", rf"""
WITH c AS (SELECT conv_id, turn, unnest(string_split_regex(text, '\s+')) AS a FROM conversations),
w AS (SELECT conv_id, turn, {SAID_SQL.replace('(t)', '(a)')} AS t, count(*) AS n FROM c GROUP BY ALL)
SELECT conv_id, turn, t AS said, CASE WHEN t IN ('the', 'und') THEN true WHEN t IN ('of', 'les') THEN false END AS yes, CAST(sum(n) AS BIGINT) AS n FROM w WHERE t IN ('the', 'und', 'of', 'les') GROUP BY ALL""")
def c28(spark, d):
    """Single words of turns as answers: what scores as yes or no under cues of their own."""
    said = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"\s+")).alias("t")).select("conv_id", "turn", answering.normal(F.col("t"), CUES).alias("said"))
    scored = said.groupBy("conv_id", "turn", "said").agg(F.count("*").alias("n")).withColumn("yes", answering.polarity(F.col("said"), CUES))
    return scored.where("yes is not null").select("conv_id", "turn", "said", "yes", "n")


@query("c30_short_answers", """
SELECT event_id, CASE WHEN k % 4 = 0 THEN CAST(k * 12 AS VARCHAR) WHEN k % 4 = 1 THEN CAST(k * 1000 AS VARCHAR) WHEN k % 4 = 2 THEN CAST(k * 1000 AS VARCHAR) END AS value
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def c30(spark, d):
    """Amounts as events' k would be said: a month's, in thousands, grouped, and two at once, which is no answer."""
    k = F.get_json_object("props", "$.k").cast("long")
    n = k.cast("string")
    said = (
        F.when(k % 4 == 0, F.concat(F.lit("About "), n, F.lit(" rupees a month.")))
        .when(k % 4 == 1, F.when(k > 0, F.concat(n, F.lit("k please"))).otherwise("0"))
        .when(k % 4 == 2, F.concat(F.format_number(k * 1000, 0), F.lit(" per year")))
        .otherwise(F.concat(n, F.lit(" or "), n, F.lit(" thousand")))
    )
    return answering.resolve(table(spark, d, "events").select("event_id", said.alias("text")), "amount").select("event_id", "value")


@query("c32_question_focus", "SELECT page_id, CASE WHEN contains(url, '?') THEN regexp_extract(url, '([^/]*)\\?', 1) END AS focus FROM pages")
def c32(spark, d):
    return table(spark, d, "pages").select("page_id", F.when(F.contains("url", F.lit("?")), F.regexp_extract("url", r"([^/]*)\?", 1)).alias("focus"))


@query("c35_word_error_rate")
def c35(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("ref"), F.regexp_replace(F.lower("text"), "[.,]", "").alias("hyp"))
    return rows.select("item_id", answering.word_edits("ref", "hyp").alias("edits"), F.size(F.split("ref", " ")).cast("long").alias("n_words"))


_SAID = lambda n: f"CASE WHEN {n} < 20 THEN ({spoken.ENGLISH})[CAST({n} + 1 AS INTEGER)] ELSE ({spoken.ENGLISH_TENS})[CAST({n} // 10 - 1 AS INTEGER)] || CASE WHEN {n} % 10 = 0 THEN '' ELSE ' ' || ({spoken.ENGLISH})[CAST({n} % 10 + 1 AS INTEGER)] END END"


@query("c37_amounts_in_words", f"""
WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders), p AS (SELECT *, n // 100000 AS l, n // 1000 % 100 AS t, n // 100 % 10 AS h, n % 100 AS r FROM o)
SELECT o_orderkey, concat_ws(' ', CASE WHEN l > 0 THEN {_SAID('l')} || ' lakh' END, CASE WHEN t > 0 THEN {_SAID('t')} || ' thousand' END, CASE WHEN h > 0 THEN {_SAID('h')} || ' hundred' END, CASE WHEN r > 0 OR n = 0 THEN {_SAID('r')} END) AS spoken FROM p""")
def c37(spark, d):
    return table(spark, d, "orders").select("o_orderkey", spoken.in_words(F.floor("o_totalprice")).alias("spoken"))


@query("c27_spoken_numbers", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders")
def c27(spark, d):
    """Amounts said and understood again."""
    return table(spark, d, "orders").select("o_orderkey", spoken.spoken_number(spoken.in_words(F.floor("o_totalprice"))).alias("n"))


@query("c38_dates_spoken", "SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || ' ' || monthname(o_orderdate) AS in_date, monthname(o_orderdate) || ' ' || CAST(day(o_orderdate) AS VARCHAR) AS ph_date FROM orders")
def c38(spark, d):
    return table(spark, d, "orders").select("o_orderkey", spoken.date_spoken(F.col("o_orderdate")).alias("in_date"), spoken.date_spoken(F.col("o_orderdate"), "ph").alias("ph_date"))


@query("p01_rounding", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) AS score, round_even(l_extendedprice / 7, 0) AS amount FROM lineitem")
def p01(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 8, 2).alias("score"), F.bround(F.col("l_extendedprice") / 7, 0).alias("amount"))


@query("p03_citations", "SELECT page_id, '[' || page_id || '] ' || regexp_extract(html, '<title>([^<]*)', 1) || ' — ' || list_extract(string_split(url, '/'), -1) AS citation FROM pages")
def p03(spark, d):
    cite = answers.citation(F.col("page_id").cast("string"), F.regexp_extract("html", "<title>([^<]*)", 1), F.col("url"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    return table(spark, d, "pages").select("page_id", cite.alias("citation"))


@query("p05_summaries", "SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' END, 'undecided') AS outcome, o_totalprice AS premium FROM orders")
def p05(spark, d):
    outcome = F.coalesce(F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open"), F.lit("undecided"))
    return table(spark, d, "orders").select("o_orderkey", outcome.alias("outcome"), F.col("o_totalprice").alias("premium"))


@query("j16_fallback_choice", """
WITH s AS (SELECT l_orderkey, l_linenumber, 1 AS pref, l_partkey FROM lineitem WHERE l_discount >= 0.05 UNION ALL SELECT l_orderkey, l_linenumber, 2, l_partkey FROM lineitem WHERE l_quantity > 10)
SELECT l_orderkey, arg_min(pref, pref * 1000000000 + l_linenumber * 10000000 + l_partkey) AS pref, arg_min(l_partkey, pref * 1000000000 + l_linenumber * 10000000 + l_partkey) AS l_partkey FROM s GROUP BY l_orderkey""")
def j16(spark, d):
    li = table(spark, d, "lineitem")
    pick = lambda rows, n: rows.select("l_orderkey", F.lit(n).alias("pref"), "l_linenumber", "l_partkey")
    both = pick(li.where("l_discount >= 0.05"), 1).union(pick(li.where("l_quantity > 10"), 2))
    return both.groupBy("l_orderkey").agg(F.min(F.struct("pref", "l_linenumber", "l_partkey")).alias("m")).select("l_orderkey", "m.pref", "m.l_partkey")


@query("j18_templates", "SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 3 END AS priority, event_type = 'view' AS informational FROM events")
def j18(spark, d):
    from .call_queries import TEMPLATES

    known = spark.createDataFrame([(k, t["priority"]) for k, t in TEMPLATES.items()], "event_type string, priority int")
    return table(spark, d, "events").join(F.broadcast(known), "event_type", "left").select("event_id", "priority", F.col("priority").isNull().alias("informational"))


@query("s06_table_rows", """
SELECT n_regionkey, n_nationkey, 'key: ' || n_nationkey || '; col2: ' || n_name AS text FROM nation""")
def s06(spark, d):
    n = table(spark, d, "nation")
    rows = n.select("n_regionkey", (F.col("n_nationkey") + 1).alias("pos"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("vs"))
    heads = n.select("n_regionkey").distinct().select("n_regionkey", F.lit(0).alias("pos"), F.array(F.lit("key"), F.lit("")).alias("vs"))
    return files.cells(heads.union(rows), "n_regionkey", "pos", "vs").select("n_regionkey", (F.col("pos") - 1).alias("n_nationkey"), "text")


@query("s17_rates", "SELECT p_partkey, p_brand, CASE WHEN p_brand = 'Brand#2' AND p_type = 'ECONOMY' THEN NULL ELSE p_retailprice END AS rate FROM part")
def s17(spark, d):
    part = table(spark, d, "part")
    rows = part.select("p_partkey", "p_brand", "p_type", F.col("p_retailprice").cast("string").alias("rate"))
    return files.rates(rows, ["p_brand", "p_type"], "rate", part.where("p_brand = 'Brand#2' AND p_type = 'ECONOMY'")).select("p_partkey", "p_brand", "rate")


@query("o03_dedupe_order", "SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS place FROM documents")
def o03(spark, d):
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc(F.length("text")), "doc_id"))
    return table(spark, d, "documents").select("doc_id", place.cast("long").alias("place"))


@query("o12_reranked", "SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars % 97 - CASE WHEN lang = 'en' THEN 20 ELSE 0 END DESC, doc_id) AS BIGINT) AS place FROM documents QUALIFY place <= 10")
def o12(spark, d):
    score = F.col("n_chars") % 97 - F.when(F.col("lang") == "en", 20).otherwise(0)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(score), "doc_id"))
    return table(spark, d, "documents").withColumn("place", place.cast("long")).where("place <= 10").select("doc_id", "source", "place")


@query("t06_due_calls", """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type <> 'error'),
g AS (SELECT user_id, list({'t': t, 'id': event_id} ORDER BY t, event_id) AS es FROM e GROUP BY user_id),
r AS (SELECT user_id, list_reduce(es, lambda s, x: CASE WHEN x.t - s.t >= 14400 THEN {'t': x.t, 'ids': list_append(s.ids, x.id)} ELSE s END, {'t': -1e18::DOUBLE, 'ids': []::BIGINT[]}) AS s FROM g)
SELECT user_id, unnest(s.ids) AS event_id FROM r""")
def t06(spark, d):
    """Calls of a model that are due: four hours or more after the last one made."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ev = table(spark, d, "events").where("event_type <> 'error'").withColumn("at", at)
    return calls.debounced(ev, "user_id", "at", "event_id", 14400.0).select("user_id", "event_id")


@query("a09_bench_means", f"""
WITH r AS (SELECT lang, len({WORDS_SQL}) AS n FROM documents), s AS (SELECT lang, list_sort(list(n)) AS v, avg(n) AS m FROM r GROUP BY lang) SELECT lang, round(m, 6) AS mean, v[len(v) // 2 + 1] AS median FROM s""")
def a09(spark, d):
    n = table(spark, d, "documents").select("lang", F.size(text.words(F.col("text"))).cast("long").alias("n"))
    medians = ranks.at_places(n, ["lang"], "n", {"median": lambda m: F.floor(m / 2)}).select("lang", "median")
    return n.groupBy("lang").agg(F.round(F.avg("n"), 6).alias("mean")).join(medians, "lang")


@query("c31_coerce_kinds", r"""
SELECT c_custkey, TRY_CAST(regexp_extract(CAST(c_acctbal AS VARCHAR), '-?[0-9]+(\.[0-9]+)?') AS DOUBLE) AS number, c_mktsegment IN ('BUILDING') AS flag FROM customer""")
def c31(spark, d):
    flag = F.coalesce(turns.coerce_bool(F.when(F.col("c_mktsegment") == "BUILDING", "yes").otherwise("no")), F.lit(False))
    return table(spark, d, "customer").select("c_custkey", turns.coerce_number(F.col("c_acctbal").cast("string")).alias("number"), flag.alias("flag"))
