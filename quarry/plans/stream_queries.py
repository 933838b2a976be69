"""Batch forms of the keyed stream machines: opportunities, turn commits, late extraction, utterances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import calls, turns
from ..streaming import commits, extraction, hub, opportunities, utterances
from .call_queries import CLOCK_SQL
from .registry import query, table

#: Events as utterances of a week's calls: which kinds a customer raises, which the agent addresses.
SAID_SQL = """e AS (SELECT user_id * 10 + CAST(extract('day' FROM ts) AS BIGINT) // 7 AS room, event_id AS seq, epoch_us(ts) / 1e6 AS t, CAST(json_extract(props, '$.k') AS INTEGER) % 5 AS k,
  CASE WHEN event_type IN ('click', 'view') THEN 'customer' ELSE 'agent' END AS speaker FROM events),
n AS (SELECT *, row_number() OVER w AS i, coalesce(lag(speaker) OVER w, '') AS before FROM e WINDOW w AS (PARTITION BY room ORDER BY t, seq)),
r AS (SELECT n.*, key, speaker = 'customer' AND k = c AS raised, speaker = 'agent' AND k = c AS addressed FROM n CROSS JOIN (VALUES ('plan', 0), ('rider', 1)) v(key, c))"""


def said(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 5
    at = F.col("ts").cast("timestamp")
    kind = F.array_compact(F.array(F.when(k == 0, "plan"), F.when(k == 1, "rider")))
    customer = F.col("event_type").isin("click", "view")
    none = F.array().cast("array<string>")
    return table(spark, d, "events").select(
        (F.col("user_id") * 10 + F.floor(F.dayofmonth(at) / 7)).alias("room"), F.col("event_id").alias("seq"), (F.unix_micros(at) / 1e6).alias("at"),
        F.when(customer, "customer").otherwise("agent").alias("speaker"), F.when(customer, kind).otherwise(none).alias("raised"), F.when(customer, none).otherwise(kind).alias("addressed"),
    )


@query("t04_opportunities", f"""
WITH {SAID_SQL}, c AS (SELECT *, coalesce(bool_or(addressed) OVER (PARTITION BY room, key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS covered FROM r),
o AS (SELECT room, key, min(i) AS i, arg_min(t, i) AS opened FROM c WHERE raised AND NOT covered GROUP BY ALL),
z AS (SELECT room, key, o.i, opened, min(r.i) AS done, arg_min(r.t, r.i) AS resolved FROM o LEFT JOIN r USING (room, key) WHERE r.addressed AND r.i > o.i GROUP BY ALL),
p AS (SELECT o.*, z.done, z.resolved FROM o LEFT JOIN z USING (room, key)),
t AS (SELECT p.room, p.key, n.t, row_number() OVER (PARTITION BY p.room, p.key ORDER BY n.i) AS nth FROM p JOIN n ON n.room = p.room AND n.i > p.i AND (p.done IS NULL OR n.i < p.done) AND n.speaker = 'agent' AND n.before <> 'agent'),
x AS (SELECT p.*, t.t AS second, opened + 21600 AS due FROM p LEFT JOIN t ON t.room = p.room AND t.key = p.key AND nth = 2)
SELECT room, key, round(opened, 3) AS opened, round(resolved, 3) AS resolved, CASE WHEN second < due THEN round(second, 3) WHEN resolved IS NULL OR due <= resolved THEN round(due, 3) END AS escalated FROM x""")
def t04(spark, d):
    events = opportunities.tracked(said(spark, d), seconds=21600.0)
    at = lambda event: F.round(F.max(F.when(F.col("event") == event, F.col("at"))), 3).alias(event)
    return events.groupBy("room", "key").agg(at("opened"), at("resolved"), at("escalated"))


#: Lines of a call as speech of one caller, cut differently by turn, with pauses of different lengths.
HEARD_SQL = f"""{CLOCK_SQL}, l AS (SELECT conv_id, turn, round(0.5 + before, 3) + 0.2 * turn * (conv_id % 4) AS start_at, round(0.5 + before + dur, 3) + 0.2 * turn * (conv_id % 4) AS end_at,
  CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN rtrim(text, '.!?') WHEN 2 THEN 'yes' ELSE split_part(text, ' ', 1) || ' and' END AS heard FROM b),
k AS (SELECT *, lead(start_at) OVER (PARTITION BY conv_id ORDER BY turn) AS next_at, CASE WHEN regexp_matches(lower(trim(heard)), '^({"|".join(turns.BACKCHANNELS)})[.!,]?$') THEN 'backchannel'
  WHEN regexp_matches(lower(trim(heard)), '(^|\\s)({"|".join(turns.CONNECTORS)})[,]?$') THEN 'incomplete' WHEN regexp_matches(trim(heard), '[.?!।]$') THEN 'complete' ELSE 'unknown' END AS ending FROM l)"""


def heard(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", turns.speaker(F.col("role")).alias("speaker"), "text")
    clock = calls.virtual_clock(lines, "conv_id", ["turn"], F.size(words(F.col("text"))))
    nth = F.col("turn") % 4
    text = F.when(nth == 0, F.col("text")).when(nth == 1, F.regexp_replace("text", "[.!?]+$", "")).when(nth == 2, "yes").otherwise(F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" and")))
    later = 0.2 * F.col("turn") * (F.col("conv_id") % 4)
    event = lambda i, at, kind, words: F.struct(F.lit(i).alias("i"), at.alias("at"), F.lit(kind).alias("kind"), words.alias("text"))
    start, end = F.col("start_s") + later, F.col("end_s") + later
    none = F.lit(None).cast("string")
    events = F.array(event(0, start, "start", none), event(1, start + 0.001, "interim", F.split_part("text", F.lit(" "), F.lit(1))), event(2, end, "final", text), event(3, end + 0.4, "end", none))
    rows = clock.select("conv_id", "turn", F.explode(events).alias("e"))
    context = [(F.col("conv_id") % 3 == 0).alias("agent_speaking"), (F.col("conv_id") % 2 == 0).alias("yes_no"), F.lit(False).alias("paused")]
    return rows.select(F.col("conv_id").alias("call"), (F.col("turn") * 4 + F.col("e.i")).cast("long").alias("seq"), "e.at", "e.kind", "e.text", *context)


@query("t14_turn_commits", f"""
WITH {HEARD_SQL}, h AS (SELECT *, end_at + 0.4 AS ended, CASE WHEN ending = 'backchannel' AND conv_id % 3 = 0 THEN -1 WHEN ending = 'backchannel' AND conv_id % 2 = 0 THEN 0.4 WHEN ending IN ('backchannel', 'incomplete') THEN 0.8
  WHEN ending = 'unknown' THEN 1.0 ELSE 0.0 END AS hold FROM k)
SELECT conv_id, turn, CASE WHEN hold < 0 THEN 'discarded' WHEN hold = 0 OR next_at IS NULL OR ended + hold <= next_at THEN 'committed' ELSE 'cancelled' END AS decision,
 round(CASE WHEN hold <= 0 THEN ended WHEN next_at IS NULL OR ended + hold <= next_at THEN ended + hold ELSE next_at END, 3) AS at, trim(heard) AS said FROM h WHERE trim(heard) <> ''""")
def t14(spark, d):
    found = commits.committed(heard(spark, d))
    # a cancelled pause is told by the next line's start
    turn = F.floor(F.when(F.col("decision") == "cancelled", F.col("seq") - 4).otherwise(F.col("seq")) / 4)
    return found.select(F.col("call").alias("conv_id"), turn.alias("turn"), "decision", F.round("at", 3).alias("at"), F.col("text").alias("said"))


def extractions(spark, d):
    """Each line asks for its extraction when it ends; how long that takes follows its length."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", turns.speaker(F.col("role")).alias("speaker"), "text")
    clock = calls.virtual_clock(lines, "conv_id", ["turn"], F.size(words(F.col("text"))))
    takes = F.length("text") % 13 + 0.25
    updates = F.to_json(F.create_map(F.concat(F.lit("f"), (F.col("turn") % 3).cast("string")), F.split_part("text", F.lit(" "), F.lit(1))))
    none = F.lit(None).cast("string")
    asked = F.struct(F.lit(0).alias("i"), F.col("end_s").alias("at"), F.lit("asked").alias("kind"), none.alias("intent"), none.alias("updates"))
    result = F.struct(F.lit(1).alias("i"), (F.col("end_s") + takes).alias("at"), F.lit("result").alias("kind"), F.col("speaker").alias("intent"), updates.alias("updates"))
    rows = clock.select("conv_id", F.col("turn").cast("long").alias("turn"), F.explode(F.array(asked, result)).alias("e"))
    return rows.select(F.col("conv_id").alias("call"), (F.col("turn") * 2 + F.col("e.i")).cast("long").alias("seq"), "e.at", "e.kind", "turn", "e.intent", "e.updates")


EXTRACTED_SQL = f"""{CLOCK_SQL}, x AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'customer' WHEN role = 'assistant' THEN 'agent' ELSE 'other' END AS intent, split_part(text, ' ', 1) AS first,
  round(0.5 + before + dur, 3) AS asked, length(text) % 13 + 0.25 AS takes FROM b)"""


@query("t16_late_extraction", f"""
WITH {EXTRACTED_SQL} SELECT conv_id, turn, 'on_time' AS path, round(asked + takes, 3) AS at, intent FROM x WHERE takes < 1.5 UNION ALL SELECT conv_id, turn, 'timeout', round(asked + 1.5, 3), NULL FROM x WHERE takes > 1.5
UNION ALL SELECT conv_id, turn, 'late', round(asked + takes, 3), NULL FROM x WHERE takes > 1.5 AND takes < 9.5 UNION ALL SELECT conv_id, turn, 'lost', round(asked + 9.5, 3), NULL FROM x WHERE takes > 9.5
UNION ALL SELECT conv_id, turn, 'unasked', round(asked + takes, 3), NULL FROM x WHERE takes > 9.5""")
def t16(spark, d):
    return extraction.extracted(extractions(spark, d)).select(F.col("call").alias("conv_id"), "turn", "path", F.round("at", 3).alias("at"), F.when(F.col("path") == "on_time", F.col("intent")).alias("intent"))


@query("t16_merged_fields", f"WITH {EXTRACTED_SQL} SELECT conv_id, 'f' || (turn % 3) AS field, arg_max(first, (asked + takes, turn)) AS value FROM x WHERE takes < 9.5 GROUP BY ALL")
def t16_fields(spark, d):
    return extraction.merged_fields(extraction.extracted(extractions(spark, d))).withColumnRenamed("call", "conv_id")


def recognized(spark, d):
    """Each line as a recognizer gives it: a guess of its first word, a guess of its first hundred characters, nothing, and the line itself unless it was cut off."""
    lines = table(spark, d, "conversations")
    event = lambda i, text, final, sure: F.struct(F.lit(i).alias("i"), text.alias("text"), F.lit(final).alias("final"), F.lit(sure).alias("confidence"))
    guesses = [event(0, F.split_part("text", F.lit(" "), F.lit(1)), False, 0.5), event(1, F.substring("text", 1, 100), False, 0.7), event(2, F.lit("  "), False, 0.0)]
    events = F.when(F.length("text") % 5 == 0, F.array(*guesses)).otherwise(F.array(*guesses, event(3, F.col("text"), True, 0.0)))
    rows = lines.select("conv_id", "turn", turns.speaker(F.col("role")).alias("speaker"), F.explode(events).alias("e"))
    seq = (F.col("turn") * 4 + F.col("e.i")).cast("long")
    return rows.select(F.col("conv_id").alias("call"), seq.alias("seq"), (seq * 1.5 + 1).alias("at"), "speaker", "e.text", "e.final", "e.confidence")


RECOGNIZED_SQL = """l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'customer' WHEN role = 'assistant' THEN 'agent' ELSE 'other' END AS speaker, text FROM conversations),
g AS (SELECT conv_id, turn * 4 AS seq, speaker, split_part(text, ' ', 1) AS text, false AS final, 0.5 AS confidence FROM l UNION ALL SELECT conv_id, turn * 4 + 1, speaker, text[1:100], false, 0.7 FROM l
 UNION ALL SELECT conv_id, turn * 4 + 3, speaker, text, true, 1.0 FROM l WHERE length(text) % 5 <> 0),
u AS (SELECT conv_id, seq, speaker || '-' || CAST(coalesce(sum(CAST(final AS INTEGER)) OVER (PARTITION BY conv_id, speaker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS utterance_id, speaker,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, final, CAST(confidence AS DOUBLE) AS confidence FROM g WHERE trim(text) <> '')"""


@query("s20_utterances", f"WITH {RECOGNIZED_SQL} SELECT * FROM u")
def s20(spark, d):
    return utterances.numbered(recognized(spark, d)).select(F.col("call").alias("conv_id"), "seq", "utterance_id", "speaker", "text", "final", "confidence")


@query("t20_transcript_by_utterance", f"WITH {RECOGNIZED_SQL} SELECT conv_id, utterance_id, arg_max(text, (final, seq)) AS text, bool_or(final) AS final FROM u GROUP BY ALL")
def t20(spark, d):
    return utterances.transcript(utterances.numbered(recognized(spark, d))).select(F.col("call").alias("conv_id"), "utterance_id", "text", "final")


@query("k05_nudge_state", """
WITH u AS (SELECT user_id, event_type, ts, event_id, CASE WHEN value > 10 THEN value END AS value, CASE WHEN event_id % 3 = 0 THEN props END AS props FROM events)
SELECT user_id, event_type, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value, arg_max(props, (ts, event_id)) FILTER (props IS NOT NULL) AS props FROM u GROUP BY ALL""")
def k05(spark, d):
    """Events as updates of a user's nudges, each with some of their fields."""
    updates = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.when(F.col("value") > 10, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("props"))
    return hub.latest_fields(updates, ["user_id", "event_type"], ["ts", "event_id"], ["value", "props"])


@query("k05_history", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events QUALIFY nth <= 1000")
def k05_history(spark, d):
    return hub.recent(table(spark, d, "events"), "event_type", ["ts", "event_id"]).select("event_type", "event_id", F.col("nth").cast("long").alias("nth"))


@query("k07_snapshot", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events QUALIFY nth <= 300)
SELECT event_type, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY nth DESC) AS ids FROM r GROUP BY event_type""")
def k07(spark, d):
    found = hub.snapshot(table(spark, d, "events").select("event_type", "ts", "event_id"), "event_type", ["ts", "event_id"])
    return found.select("event_type", "n", F.array_join(F.transform("events", lambda e: F.get_json_object(e, "$.event_id")), ",").alias("ids"))
