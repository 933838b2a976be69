"""Calls: conversations as scripted utterances, events as signals of rooms (users)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import answering, calls, turns
from ..streaming import nudges
from .registry import query, table
from .text_queries import WORDS_SQL

#: What a shown nudge is like, by key: events stand in for signals of these kinds.
TEMPLATES = {
    "error": {"priority": 1, "topic": "compliance", "ttl_s": 7200},
    "purchase": {"priority": 2, "topic": "sales", "ttl_s": 3600},
    "click": {"priority": 3, "topic": "sales", "ttl_s": 3600},
    "signup": {"priority": 3, "topic": "service", "ttl_s": 1800},
}
SLOW = nudges.Controls(cooldown_s=7200, gap_s=900, max_repeats=40)


def utterances(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", turns.speaker(F.col("role")).alias("speaker"), "text")


def signals(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("user_id").alias("room"), F.col("event_id").alias("seq"), at.alias("at"), F.col("event_type").alias("key"),
        F.when(k % 2 == 0, "agent").otherwise("customer").alias("speaker"), F.when(k % 3 == 0, "llm").otherwise("rules").alias("source"),
        F.least(F.lit(1.0), 0.4 + k / 100).alias("confidence"), F.least(F.lit(1.0), 0.5 + F.col("value") / 40).alias("asr_confidence"), (k % 11).alias("words"), (k % 13 == 0).alias("noisy"),
    )


@query("s21_customer_turns", "SELECT conv_id, turn, text, 1.0::DOUBLE AS confidence FROM conversations WHERE role = 'user' AND trim(text) <> ''")
def s21(spark, d):
    return utterances(spark, d).where((F.col("speaker") == "customer") & (F.trim("text") != "")).select("conv_id", "turn", "text", F.lit(1.0).alias("confidence"))


CLOCK_SQL = f"""c AS (SELECT conv_id, turn, role, text, len({WORDS_SQL}) / 2.6 AS dur FROM conversations),
b AS (SELECT *, coalesce(sum(dur + 0.7) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)"""


@query("s22_virtual_clock", f"WITH {CLOCK_SQL} SELECT conv_id, turn, round(0.5 + before, 3) AS start_s, round(0.5 + before + dur, 3) AS end_s FROM b")
def s22(spark, d):
    return calls.virtual_clock(utterances(spark, d), "conv_id", ["turn"], F.size(words(F.col("text")))).select("conv_id", "turn", "start_s", "end_s")


@query("w03_turn_changes", """
WITH c AS (SELECT conv_id, turn, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS f FROM conversations)
SELECT conv_id, turn, CAST(sum(f) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn_no FROM c""")
def w03(spark, d):
    return calls.turn_changes(utterances(spark, d), "conv_id", ["turn"], "speaker").select("conv_id", "turn", "turn_no")


@query("w04_grouped_turns", """
WITH c AS (SELECT user_id, event_id, ts, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR epoch(ts) - epoch(lag(ts) OVER w) >= 3600 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS group_no FROM c""")
def w04(spark, d):
    ev = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return calls.grouped(ev, "user_id", ["ts", "event_id"], "event_type", "at", 3600.0).select("event_id", "group_no")


@query("w05_rolling_least", """
SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS least FROM events""")
def w05(spark, d):
    ev = table(spark, d, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    return calls.rolling_least(ev, "user_id", "at", "value", 21600, "least").select("event_id", "least")


@query("w06_recent_statements", """
SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ',') AS recent FROM events""")
def w06(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    joined = F.array_join(F.collect_list("event_type").over(w), ",")
    return table(spark, d, "events").select("event_id", F.when(F.count("*").over(w) > 0, joined).alias("recent"))


@query("w07_frustration", """
WITH s AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 1.0 WHEN 'view' THEN 0.4 ELSE 0.0 END AS score FROM events),
h AS (SELECT *, list(score) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM s),
l AS (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, v::DOUBLE[]), lambda a, x: 0.3 * x + 0.7 * a) AS level FROM h)
SELECT event_id, round(level, 9) AS level, round(level, 9) >= 0.45 AND level > coalesce(lag(level) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS fires FROM l""")
def w07(spark, d):
    score = F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "view", 0.4).otherwise(0.0)
    ev = table(spark, d, "events").withColumn("score", score)
    return calls.frustration(ev, "user_id", ["ts", "event_id"], "score", alpha=0.3).select("event_id", F.round("level", 9).alias("level"), "fires")


@query("t05_repeated_statements")
def t05(spark, d):
    """Customer statements like one of their last five, and the scores that come of it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, -1)
    said = utterances(spark, d).where("speaker = 'customer'").withColumn("before", F.collect_list("text").over(w)).withColumn("earlier", F.explode_outer("before"))
    like = said.withColumn("ratio", answering.token_set_ratio(F.lower("text"), F.lower("earlier"))).groupBy("conv_id", "turn").agg(F.max("ratio").alias("ratio"), F.first("text").alias("text"))
    repeated = (F.length("text") > 15) & (F.coalesce("ratio", F.lit(0.0)) > 85)
    return like.select("conv_id", "turn", repeated.alias("repeated"), calls.frustration_score(F.lit(0), repeated, F.lit(None).cast("double")).alias("score"))


@query("w08_quote_before_disclosure", """
WITH f AS (SELECT *, bool_or(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT event_id, user_id FROM f WHERE event_type = 'purchase' AND NOT d""")
def w08(spark, d):
    ev = table(spark, d, "events")
    return calls.disclosed_before(ev, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id", "user_id")


@query("t03_missed_deadline", """
WITH s AS (SELECT user_id, min(epoch(ts)) FILTER (event_type <> 'view') AS a, min(epoch(ts)) FILTER (event_type = 'signup') AS d, max(epoch(ts)) AS z FROM events GROUP BY user_id)
SELECT user_id, d IS NULL AS never FROM s WHERE z > a + 86400 AND (d IS NULL OR d > a + 86400)""")
def t03(spark, d):
    ev = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    agent, told = F.col("event_type") != "view", F.col("event_type") == "signup"
    return calls.deadline_missed(ev, "user_id", "at", agent, told, 86400.0).select("user_id", F.col("first_disclosure").isNull().alias("never"))


@query("w15_streaks", """
WITH b AS (SELECT event_id, user_id, ts, CASE WHEN value < 10 THEN 1 ELSE 0 END AS bad FROM events), i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b)
SELECT event_id, CAST(sum(bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM i""")
def w15(spark, d):
    return calls.streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") < 10).select("event_id", "streak")


@query("w16_attempts", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events")
def w16(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", n.cast("long").alias("attempt"))


@query("t15_sessions", """
WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, CASE WHEN epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) <= 21600 THEN 0 ELSE 1 END AS f FROM events),
n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(max(s) - min(s), 3) AS seconds FROM n GROUP BY ALL""")
def t15(spark, d):
    ev = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return calls.sessionize(ev, "user_id", "at", 21600.0).select("user_id", "session", "n", F.round(F.col("end") - F.col("start"), 3).alias("seconds"))


@query("j09_asof_forward", """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), r AS (SELECT user_id, ts, event_id AS mark FROM events WHERE event_type = 'click'),
z AS (SELECT user_id, arg_max(mark, (ts, mark)) AS mark FROM r GROUP BY user_id)
SELECT l.event_id, coalesce(r.mark, z.mark) AS mark FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts LEFT JOIN z ON z.user_id = l.user_id""")
def j09(spark, d):
    ev = table(spark, d, "events")
    errors = ev.where("event_type = 'error'").select("event_id", "user_id", "ts")
    clicks = ev.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("mark"))
    return calls.as_of_forward(errors, clicks, "user_id", "ts", "ts", "mark").select("event_id", "mark")


@query("j13_addressed_earlier", """
SELECT c.event_id FROM events c WHERE c.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.user_id = c.user_id AND a.event_type = 'signup' AND a.ts < c.ts)""")
def j13(spark, d):
    ev = table(spark, d, "events")
    first = ev.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("first"))
    open_ = ev.where("event_type = 'click'").join(first, "user_id", "left")
    return open_.where(F.col("first").isNull() | (F.col("first") >= F.col("ts"))).select("event_id")


@query("j15_signal_rules", r"""
SELECT conv_id, turn, 'long' AS type FROM conversations WHERE role = 'user' AND regexp_matches(lower(text), 'tion|ción') UNION ALL
SELECT conv_id, turn, 'formal' FROM conversations WHERE role = 'user' AND regexp_matches(lower(text), '(^|[^\p{L}])(the|und|que)([^\p{L}]|$)') UNION ALL
SELECT conv_id, turn, 'plural' FROM conversations WHERE role = 'assistant' AND regexp_matches(lower(text), 'nds|eaux')""")
def j15(spark, d):
    u, low = utterances(spark, d), F.lower("text")
    agent, customer = F.col("speaker") == "agent", F.col("speaker") == "customer"
    rules = {"long": customer & low.rlike("tion|ción"), "formal": customer & low.rlike(r"(^|[^\p{L}])(the|und|que)([^\p{L}]|$)"), "plural": agent & low.rlike("nds|eaux")}
    found = F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules.items()]), lambda x: x.isNotNull())
    return u.select("conv_id", "turn", F.explode(found).alias("type"))


@query("f18_first_question", "SELECT page_id, CASE WHEN contains(url, '?') THEN split_part(url, '?', 1) || '?' ELSE url END AS asked FROM pages")
def f18(spark, d):
    return table(spark, d, "pages").select("page_id", turns.first_question(F.col("url")).alias("asked"))


@query("t07_nudges")
def t07(spark, d):
    return nudges.replay(signals(spark, d), TEMPLATES, SLOW)


@query("t12_ablation")
def t12(spark, d):
    return nudges.ablation(signals(spark, d), TEMPLATES, SLOW)
