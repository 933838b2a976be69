"""The operational store and its reports: orders and customers as records, events as hub messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reports
from .registry import query, table


def hub(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("room"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "click", "nudge").otherwise(F.col("event_type")).alias("type"), "value", "props")


@query("a06_latency_table", """
WITH v AS (SELECT event_type AS component, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT component, len(v) AS n, round(v[least(len(v) - 1, CAST(floor(0.5 * (len(v) - 1) + 0.5) AS INTEGER)) + 1], 1) AS p50, round(v[least(len(v) - 1, CAST(floor(0.95 * (len(v) - 1) + 0.5) AS INTEGER)) + 1], 1) AS p95, v[-1] AS max FROM v""")
def a06(spark, d):
    rows = table(spark, d, "events").withColumnRenamed("event_type", "component")
    return reports.latency_table(rows, "component", "value")


@query("a10_components", """
WITH g AS (SELECT event_type AS component, round(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1000.0, 1) AS ms FROM events UNION ALL SELECT 'value', value FROM events),
v AS (SELECT component, list_sort(list(ms) FILTER (ms IS NOT NULL)) AS v FROM g GROUP BY component)
SELECT component, len(v) AS n, round(v[least(len(v) - 1, CAST(floor(0.5 * (len(v) - 1) + 0.5) AS INTEGER)) + 1], 1) AS p50, round(v[least(len(v) - 1, CAST(floor(0.95 * (len(v) - 1) + 0.5) AS INTEGER)) + 1], 1) AS p95, v[-1] AS max FROM v""")
def a10(spark, d):
    ev = table(spark, d, "events")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.round((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000, 1)
    rows = ev.withColumn("gap", gap).select(F.explode(F.array(F.struct(F.col("event_type").alias("component"), F.col("gap").alias("ms")), F.struct(F.lit("value").alias("component"), F.col("value").alias("ms")))).alias("x")).select("x.*")
    return reports.latency_table(rows, "component", "ms")


@query("a11_by_run", """
WITH v AS (SELECT user_id AS run, list_sort(list(value)) AS v FROM events GROUP BY user_id)
SELECT run, len(v) AS n, round(v[least(len(v) - 1, CAST(floor(0.5 * (len(v) - 1) + 0.5) AS INTEGER)) + 1], 1) AS p50, round(v[least(len(v) - 1, CAST(floor(0.95 * (len(v) - 1) + 0.5) AS INTEGER)) + 1], 1) AS p95 FROM v""")
def a11(spark, d):
    return reports.by_run(table(spark, d, "events").withColumnRenamed("user_id", "run"), "run", "value")


@query("a13_reason_histogram", "SELECT role, count(*) AS n FROM conversations GROUP BY role")
def a13(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"))


@query("a19_rooms", "SELECT user_id AS room, CAST(max(ts) AS VARCHAR) AS last_seen, count(*) FILTER (event_type = 'click') AS nudges FROM events GROUP BY user_id")
def a19(spark, d):
    return reports.rooms(hub(spark, d)).select("room", F.regexp_replace(F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "").alias("last_seen"), "nudges")


@query("a21_stream_latency", """
SELECT user_id, round(epoch_us(min(ts) FILTER (event_type = 'view')) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS first_view_s, count(*) AS n, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 6) AS per_second FROM events GROUP BY user_id""")
def a21(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = F.min(us), F.max(us)
    view = F.min(F.when(F.col("event_type") == "view", us))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(view / 1e6 - first / 1e6, 3).alias("first_view_s"), F.count("*").alias("n"), F.round(F.count("*") / F.nullif((last - first) / 1e6, F.lit(0.0)), 6).alias("per_second"))


@query("a24_latest_state", """
SELECT user_id AS room, event_type AS type, arg_max(value, (ts, event_id)) FILTER (value > 5) AS value, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY ALL""")
def a24(spark, d):
    ups = table(spark, d, "events").select(F.col("user_id").alias("room"), F.col("event_type").alias("type"), "ts", "event_id", F.when(F.col("value") > 5, F.col("value")).alias("value"), "props")
    return reports.latest_state(ups, ["room", "type"], ["ts", "event_id"], ["value", "props"])


@query("a25_decision_totals", "SELECT count(*) AS decisions, count(*) FILTER (event_type = 'purchase') AS emitted FROM events")
def a25(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("decisions"), F.count_if(F.col("event_type") == "purchase").alias("emitted"))


@query("a12_precision_recall", """
WITH j AS (SELECT toxic, quality FROM labels) SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, round(count(*) FILTER (toxic = 1 AND quality = 1) / count(*) FILTER (toxic = 1), 6) AS precision,
 round(count(*) FILTER (toxic = 1 AND quality = 1) / count(*) FILTER (quality = 1), 6) AS recall FROM j""")
def a12(spark, d):
    tp, shown, real = F.count_if((F.col("toxic") == 1) & (F.col("quality") == 1)), F.count_if(F.col("toxic") == 1), F.count_if(F.col("quality") == 1)
    return table(spark, d, "labels").agg(tp.alias("tp"), F.round(F.try_divide(tp, shown), 6).alias("precision"), F.round(F.try_divide(tp, real), 6).alias("recall"))


@query("w17_newest_events", "SELECT user_id AS room, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events QUALIFY back <= 30")
def w17(spark, d):
    return reports.newest(hub(spark, d), 30).select("room", "id", F.col("back").cast("long").alias("back"))


@query("o07_feed_order", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, ts DESC, event_id) AS place FROM events""")
def o07(spark, d):
    priority = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(priority, F.desc("ts"), "event_id"))
    return table(spark, d, "events").select("event_id", place.cast("long").alias("place"))


@query("j08_deliveries", """
WITH s AS (SELECT user_id AS room, event_id AS id FROM events WHERE event_type = 'click'), h AS (SELECT user_id AS room, CAST(json_extract(props, '$.k') AS BIGINT) AS id, min(event_id) AS received FROM events WHERE event_type = 'view' GROUP BY ALL),
x AS (SELECT user_id AS room, CAST(json_extract(props, '$.k') AS BIGINT) AS id, min(event_id) AS displayed FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT s.room, s.id, coalesce(displayed, received) AS delivered_at, CASE WHEN displayed IS NOT NULL THEN 'display' WHEN received IS NOT NULL THEN 'hub' END AS via
FROM s LEFT JOIN x ON x.room = s.room AND x.id = s.id % 100 LEFT JOIN h ON h.room = s.room AND h.id = s.id % 100""")
def j08(spark, d):
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    by = lambda kind: ev.where(F.col("event_type") == kind).select(F.col("user_id").alias("room"), k.alias("id"), F.col("event_id").alias("at"))
    shown = ev.where("event_type = 'click'").select(F.col("user_id").alias("room"), F.col("event_id").alias("nudge"), (F.col("event_id") % 100).alias("id"))
    return reports.deliveries(shown, by("purchase"), by("view")).select("room", F.col("nudge").alias("id"), "delivered_at", "via")


@query("j10_expected_nudges", """
WITH e AS (SELECT user_id AS run, event_id AS id, event_type, epoch_us(ts) / 1e6 AS t FROM events),
w AS (SELECT run, list({'seq': id, 'lo': t - 1, 'hi': t + 7200} ORDER BY id) AS ws FROM e WHERE event_type = 'purchase' GROUP BY run),
g AS (SELECT run, list({'t': t, 'id': id} ORDER BY t, id) AS gs FROM e WHERE event_type = 'click' GROUP BY run),
r AS (SELECT run, list_reduce(ws, lambda s, x: {'used': list_append(s.used, list_filter(s.gs, lambda g: g.t >= x.lo AND g.t <= x.hi AND NOT list_contains(s.used, g.id))[1].id),
 'out': list_append(s.out, {'seq': x.seq, 'id': list_filter(s.gs, lambda g: g.t >= x.lo AND g.t <= x.hi AND NOT list_contains(s.used, g.id))[1].id}), 'gs': s.gs},
 {'used': []::BIGINT[], 'out': []::STRUCT(seq BIGINT, id BIGINT)[], 'gs': coalesce(gs, []::STRUCT(t DOUBLE, id BIGINT)[])}) AS s FROM w LEFT JOIN g USING (run)),
o AS (SELECT run, unnest(s.out) AS o FROM r) SELECT run, 'click' AS key, o.seq AS seq, o.id AS id, o.id IS NOT NULL AS found FROM o""")
def j10(spark, d):
    ev = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    want = ev.where("event_type = 'purchase'").select(F.col("user_id").alias("run"), F.lit("click").alias("key"), F.col("event_id").alias("seq"), at.alias("lo"), (at + 7200).alias("hi"))
    got = ev.where("event_type = 'click'").select(F.col("user_id").alias("run"), F.col("event_type").alias("key"), at.alias("at"), F.col("event_id").alias("id"))
    return reports.match_expected(want, got)


@query("a08_recent_percentiles", """
WITH n AS (SELECT user_id AS room, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20), v AS (SELECT room, list_sort(list(value)) AS v FROM n GROUP BY room)
SELECT room, len(v) AS n, CAST(round_even(v[CAST(floor(0.5 * (len(v) - 1)) AS INTEGER) + 1], 0) AS BIGINT) AS p50, CAST(round_even(v[CAST(floor(0.95 * (len(v) - 1)) AS INTEGER) + 1], 0) AS BIGINT) AS p95 FROM v""")
def a08(spark, d):
    return reports.recent_percentiles(hub(spark, d), "value", 20)


@query("a22_path_ratios", """
WITH t AS (SELECT event_type IN ('click', 'view') AS quick, value > 10 AS fast FROM events), c AS (SELECT count(*) AS turns, count(*) FILTER (quick) AS quick, count(*) FILTER (fast) AS fast, count(*) FILTER (quick AND fast) AS both FROM t)
SELECT *, quick + fast AS avoided, round((quick + fast) / (2 * turns), 6) AS share FROM c""")
def a22(spark, d):
    return reports.path_ratios(table(spark, d, "events").select(F.col("event_type").isin("click", "view").alias("quick"), (F.col("value") > 10).alias("fast")))


@query("t19_first_ack", "SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL")
def t19(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query("t20_transcript_upsert", "SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations GROUP BY ALL")
def t20(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"))


@query("s16_newest_orders", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def s16(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@query("k08_json_columns", "SELECT o_orderkey, '{\"status\":\"' || o_orderstatus || '\",\"priority\":\"' || o_orderpriority || '\"}' AS fields FROM orders")
def k08(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).alias("fields"))


@query("f12_events_since", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def f12(spark, d):
    return table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")
