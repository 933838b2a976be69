"""Eligibility, pricing and account rules over customers, parts and orders as stand-ins for applicants, rate tables and installments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rules
from .registry import query, table

BANDS = [("1-10", 1, 10), ("11-20", 11, 20), ("21-35", 21, 35), ("36-45", 36, 45)]
BANDS_SQL = "(VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in BANDS) + ") AS bands(name, lo, hi)"


@query("j04_quote_lookup", """
WITH r AS (SELECT p_brand, p_type, p_size, min(p_retailprice) AS rate FROM part GROUP BY ALL)
SELECT l_orderkey, l_linenumber, p_partkey, p_size, rate FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN r USING (p_brand, p_type, p_size)""")
def j04(spark, d):
    part = table(spark, d, "part")
    rates = part.groupBy("p_brand", "p_type", "p_size").agg(F.min("p_retailprice").alias("rate"))
    priced = part.select("p_partkey", "p_brand", "p_type", "p_size").join(rates, ["p_brand", "p_type", "p_size"], "left")
    return table(spark, d, "lineitem").join(priced, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_partkey", "p_size", "rate")


@query("j05_age_bands", f"SELECT p_partkey, p_size, (SELECT name FROM {BANDS_SQL} WHERE p_size BETWEEN lo AND hi ORDER BY lo LIMIT 1) AS band FROM part")
def j05(spark, d):
    bands = spark.createDataFrame(BANDS, "name string, lo int, hi int")
    return rules.in_band(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", bands)


@query("j06_zones", "SELECT c_custkey, CASE WHEN regexp_matches(lower(c_mktsegment), 'house|build') THEN 'A' WHEN regexp_matches(lower(c_mktsegment), 'auto') THEN 'B' ELSE 'C' END AS zone FROM customer")
def j06(spark, d):
    return table(spark, d, "customer").select("c_custkey", rules.zone(F.col("c_mktsegment"), {"A": ["house", "build"], "B": ["auto"]}).alias("zone"))


@query("o10_option_pick", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 5 THEN 5 WHEN l_quantity <= 10 THEN 10 WHEN l_quantity <= 25 THEN 25 ELSE 40 END AS option FROM lineitem")
def o10(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.smallest_at_least([5, 10, 25, 40], F.col("l_quantity")).alias("option"))


@query("o09_option_spread", """
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM n WHERE n <= 3 OR i IN (1, n // 2 + 1, n)""")
def o09(spark, d):
    w = Window.partitionBy("l_orderkey")
    rows = table(spark, d, "lineitem").withColumn("i", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).withColumn("n", F.count("*").over(w))
    return rules.spread(rows, "l_orderkey", "n", "i").select("l_orderkey", "l_linenumber", "l_partkey")


APPLICANT_SQL = """a AS (SELECT c_custkey, CASE WHEN c_acctbal < -900 THEN NULL ELSE CAST(18 + c_custkey % 63 AS INTEGER) END AS age, CASE c_mktsegment WHEN 'BUILDING' THEN 'parents' WHEN 'AUTOMOBILE' THEN 'family' WHEN 'MACHINERY' THEN 'self_spouse' ELSE 'self' END AS cover,
 CAST(c_custkey % 5 AS INTEGER) AS children, c_acctbal > 9900 AS treatment, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(55 + c_custkey % 25 AS INTEGER) END AS eldest FROM customer)"""


def applicants(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < -900, None).otherwise((18 + k % 63).cast("int")).alias("age"),
        F.when(F.col("c_mktsegment") == "BUILDING", "parents").when(F.col("c_mktsegment") == "AUTOMOBILE", "family").when(F.col("c_mktsegment") == "MACHINERY", "self_spouse").otherwise("self").alias("cover"),
        (k % 5).cast("int").alias("children"),
        (F.col("c_acctbal") > 9900).alias("treatment"),
        F.when(k % 7 == 0, None).otherwise((55 + k % 25).cast("int")).alias("eldest"),
    )


@query("r01_eligibility", f"""
WITH {APPLICANT_SQL}, d AS (SELECT *, CASE WHEN treatment THEN 'refer' WHEN age IS NULL AND cover <> 'parents' THEN 'incomplete' WHEN cover = 'parents' AND eldest IS NULL THEN 'incomplete' WHEN cover = 'parents' AND eldest > 75 THEN 'not_eligible'
 WHEN cover = 'parents' THEN 'eligible' WHEN age > 75 THEN 'not_eligible' WHEN age > 65 THEN 'eligible' WHEN cover IN ('self_spouse', 'family') AND children > 3 THEN 'not_eligible' ELSE 'eligible' END AS decision FROM a)
SELECT c_custkey, decision, CASE WHEN decision <> 'eligible' THEN NULL WHEN cover = 'parents' OR age > 65 THEN 'Silver' WHEN cover IN ('self_spouse', 'family') THEN 'Family' ELSE 'Secure' END AS product,
 CASE WHEN decision <> 'eligible' THEN NULL WHEN cover = 'parents' OR age > 65 OR cover = 'self' THEN '1 adult' WHEN cover = 'self_spouse' OR children = 0 THEN '2 adults' WHEN children = 1 THEN '2 adults + 1 child' ELSE '2 adults + 2 children' END AS members FROM d""")
def r01(spark, d):
    a = applicants(spark, d)
    return a.select("c_custkey", rules.eligibility(F.col("age"), F.col("cover"), F.col("children"), F.col("treatment"), F.col("eldest")).alias("e")).select("c_custkey", "e.*")


@query("r02_quotes", """
WITH s AS (SELECT o_orderkey, o_totalprice, o_orderpriority, c_acctbal, CASE WHEN regexp_matches(lower(c_mktsegment), 'house|build') THEN 1.0 WHEN regexp_matches(lower(c_mktsegment), 'auto') THEN 0.9 ELSE 0.8 END AS factor FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT *, CAST(round_even(o_totalprice / 50 * factor, 0) AS BIGINT) AS premium FROM s)
SELECT o_orderkey, premium, CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 'cold' WHEN premium <= c_acctbal * 1.15 AND o_orderpriority = '1-URGENT' THEN 'hot' ELSE 'warm' END AS grade FROM p""")
def r02(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    zone = rules.zone(F.col("c_mktsegment"), {"A": ["house", "build"], "B": ["auto"]})
    factor = F.when(zone == "A", 1.0).when(zone == "B", 0.9).otherwise(0.8)
    timeline = F.when(F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED"), "later").when(F.col("o_orderpriority") == "1-URGENT", "immediate").otherwise("soon")
    quoted = rows.withColumn("premium", rules.premium(F.col("o_totalprice") / 50, factor))
    return quoted.select("o_orderkey", "premium", rules.grade(F.col("premium"), F.col("c_acctbal"), timeline).alias("grade"))


@query("r04_accounts", """
WITH a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS due, date_diff('day', DATE '1998-08-02', CAST(o_orderdate AS DATE)) AS days_to_due, o_totalprice FROM orders)
SELECT o_orderkey, days_to_due, strftime(due + INTERVAL 15 DAY, '%Y-%m-%d') AS grace_end, round(o_totalprice * 2 / 100, 4) AS late_fee, CASE WHEN days_to_due >= 0 THEN 'due' WHEN days_to_due >= -15 THEN 'grace' ELSE 'late' END AS stage FROM a""")
def r04(spark, d):
    due = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", rules.account(due, F.lit("1998-08-02").cast("date"), F.col("o_totalprice"), 15, 2).alias("a")).select("o_orderkey", "a.*")


@query("r06_missing_fields", f"""
WITH {APPLICANT_SQL} SELECT c_custkey, array_to_string(list_filter([CASE WHEN cover <> 'parents' AND age IS NULL THEN 'age' END, CASE WHEN cover = 'parents' AND eldest IS NULL THEN 'eldest' END], lambda x: x IS NOT NULL), ',') AS missing FROM a""")
def r06(spark, d):
    need = {"age": F.col("cover") != "parents", "eldest": F.col("cover") == "parents"}
    missing = rules.required_missing(need, {"age": F.col("age"), "eldest": F.col("eldest")})
    return applicants(spark, d).select("c_custkey", F.array_join(missing, ",").alias("missing"))


@query("r05_field_merge", """
WITH c AS (SELECT user_id AS call_id, ts, event_id AS seq, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS v, value > 80 AS fix, CASE WHEN value < 2 THEN 0.2 ELSE 0.9 END AS sure FROM events),
g AS (SELECT call_id, list({'seq': seq, 'v': v, 'fix': fix, 'sure': sure} ORDER BY ts, seq) AS cs FROM c GROUP BY call_id),
r AS (SELECT call_id, list_reduce(cs, lambda s, x: CASE
 WHEN x.v IS NULL THEN {'v': s.v, 'sure': s.sure, 'd': s.d, 'out': list_append(s.out, {'seq': x.seq, 'value': x.v, 'outcome': 'invalid', 'current': s.v})}
 WHEN s.v IS NULL THEN {'v': x.v, 'sure': x.sure::DOUBLE, 'd': false, 'out': list_append(s.out, {'seq': x.seq, 'value': x.v, 'outcome': 'set', 'current': x.v})}
 WHEN s.v = x.v THEN {'v': s.v, 'sure': greatest(s.sure, x.sure::DOUBLE), 'd': false, 'out': list_append(s.out, {'seq': x.seq, 'value': x.v, 'outcome': CASE WHEN s.d THEN 'confirmed' ELSE 'same' END, 'current': s.v})}
 WHEN list_position(['view', 'click', 'purchase'], x.v) > list_position(['view', 'click', 'purchase'], s.v) THEN {'v': x.v, 'sure': x.sure::DOUBLE, 'd': false, 'out': list_append(s.out, {'seq': x.seq, 'value': x.v, 'outcome': 'widened', 'current': x.v})}
 WHEN x.fix OR s.d OR s.sure <= 0.3 THEN {'v': x.v, 'sure': x.sure::DOUBLE, 'd': false, 'out': list_append(s.out, {'seq': x.seq, 'value': x.v, 'outcome': 'corrected', 'current': x.v})}
 ELSE {'v': s.v, 'sure': s.sure, 'd': true, 'out': list_append(s.out, {'seq': x.seq, 'value': x.v, 'outcome': 'conflict', 'current': s.v})} END,
 {'v': NULL::VARCHAR, 'sure': 0::DOUBLE, 'd': false, 'out': []::STRUCT(seq BIGINT, "value" VARCHAR, outcome VARCHAR, current VARCHAR)[]}) AS s FROM g),
o AS (SELECT call_id, unnest(s.out) AS o FROM r) SELECT call_id, 'stage' AS field, o.seq AS seq, o.value AS value, o.outcome AS outcome, o.current AS current FROM o""")
def r05(spark, d):
    """Each user's event types as claims of one field, merged in order; errors are no stage."""
    from ..operators.dialogue import Field, merge_claims

    ev = table(spark, d, "events")
    sure = F.when(F.col("value") < 2, 0.2).otherwise(0.9)
    claims = ev.select(F.col("user_id").alias("call_id"), F.lit("stage").alias("field"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("raw"), sure.alias("confidence"), (F.col("value") > 80).alias("correction"))
    stage = Field("stage", "enum", values=("view", "click", "purchase", "signup"), widening=("view", "click", "purchase"))
    return merge_claims(claims, [stage])
