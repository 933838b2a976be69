"""Knowledge-base building over the driver tables: cleaning, duplicates, contradictions, versions, chunks, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii, ranks, text
from ..operators import calls, chunking, cleaning, conflicts, dedupe, versioning
from ..sources import markdown
from .registry import query, table
from .text_queries import TOKENS_SQL, WORDS_SQL

LINES_SQL = "SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents"


def lines(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", "source", "lang", "line", (F.col("p") + 1).cast("long").alias("pos"))


@query("f01_active_records", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def f01(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority")


@query("f02_metadata_filter", "SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND source IN ('src0', 'src3', 'src9')")
def f02(spark, d):
    return table(spark, d, "documents").where((F.col("lang") == "fr") & F.col("source").isin("src0", "src3", "src9")).select("doc_id", "lang", "source")


@query("f03_nonempty_lines", f"SELECT doc_id, count(*) AS n FROM ({LINES_SQL}) WHERE trim(line) <> '' GROUP BY doc_id")
def f03(spark, d):
    return lines(spark, d).where(F.trim("line") != "").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f04_boilerplate", f"""
WITH l AS ({LINES_SQL}), n AS (SELECT source, count(DISTINCT doc_id) AS docs FROM l GROUP BY source),
k AS (SELECT source, lower(trim(line)) AS key, count(DISTINCT doc_id) AS n_docs FROM l WHERE length(line) < 200 AND trim(line) <> '' GROUP BY ALL)
SELECT source, key, n_docs FROM k JOIN n USING (source) WHERE docs >= 3 AND n_docs >= greatest(3, ceil(docs * 0.02))""")
def f04(spark, d):
    return cleaning.boilerplate(lines(spark, d).withColumnRenamed("line", "text"), share=0.02)


@query("f05_running_lines", f"""
WITH l AS (SELECT source AS doc_id, doc_id AS page, pos, line FROM ({LINES_SQL})), n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY doc_id),
k AS (SELECT *, regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g') AS key FROM l),
r AS (SELECT doc_id, key, count(DISTINCT page) AS c FROM k GROUP BY ALL),
bad AS (SELECT doc_id, key FROM r JOIN n USING (doc_id) WHERE c >= greatest(2, ceil(pages * 0.02)))
SELECT doc_id, page, count(*) AS kept FROM k WHERE NOT regexp_matches(key, '^(page )?#( of #)?$|\\| page #')
 AND NOT (pos <= 2 AND (length(line) - length(replace(line, ' | ', ''))) / 3 >= 2) AND (doc_id, key) NOT IN (SELECT (doc_id, key) FROM bad) GROUP BY ALL""")
def f05(spark, d):
    pages = lines(spark, d).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "pos", "line")
    return cleaning.drop_running_lines(pages, share=0.02).groupBy("doc_id", "page").agg(F.count("*").alias("kept"))


@query("f06_least_length", "SELECT item_id FROM benchmark WHERE length(text) >= 25")
def f06(spark, d):
    return table(spark, d, "benchmark").where(F.length("text") >= chunking.LEAST_CHARS).select("item_id")


_KINDS_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM documents WHERE regexp_matches(text, '{p}')" for k, p in pii.PATTERNS.items())


@query("f07_quarantine", f"SELECT doc_id, count(DISTINCT kind) AS n_kinds FROM ({_KINDS_SQL}) GROUP BY doc_id HAVING count(DISTINCT kind) >= 3")
def f07(spark, d):
    return cleaning.quarantined(table(spark, d, "documents").select("doc_id", F.explode(pii.kinds(F.col("text"))).alias("kind")))


@query("f08_allowed_addresses", rf"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pii.PATTERNS["EMAIL"]}')) AS found FROM documents)
SELECT doc_id, found, NOT list_bool_or(list_transform(['mail1.example.com', 'mail2.example.com'], lambda a: contains(lower(found), a) OR contains(a, lower(found)))) AS personal FROM m""")
def f08(spark, d):
    allowed = F.array(F.lit("mail1.example.com"), F.lit("mail2.example.com"))
    m = table(spark, d, "documents").select("doc_id", F.explode(pii.found(F.col("text"), "EMAIL")).alias("found"))
    return m.withColumn("personal", ~F.exists(allowed, lambda a: F.contains(F.lower("found"), a) | F.contains(a, F.lower("found"))))


@query("j01_source_lookup", """
SELECT n_name, count(*) AS n_lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def j01(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    by = li.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return by.groupBy("n_name").agg(F.sum("n").alias("n_lines"), F.sum("q").alias("quantity"))


@query("j07_version_changes", """
WITH b AS (SELECT o_orderkey AS stable_key, o_orderstatus AS content_hash FROM orders WHERE o_orderpriority <> '1-URGENT'),
a AS (SELECT o_orderkey AS stable_key, CASE WHEN o_totalprice > 400000 THEN 'F' ELSE o_orderstatus END AS content_hash FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT stable_key, CASE WHEN b.stable_key IS NULL THEN 'added' WHEN a.stable_key IS NULL THEN 'removed' WHEN b.content_hash = a.content_hash THEN 'unchanged' ELSE 'updated' END AS change,
 b.content_hash AS old_hash, a.content_hash AS new_hash FROM b FULL JOIN a USING (stable_key)""")
def j07(spark, d):
    return versioning.changes(*snapshots(spark, d))


def snapshots(spark, d):
    """Two states of the orders as manifests: before, without urgent ones; after, without low ones and with large ones closed."""
    o = table(spark, d, "orders")
    before = o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("stable_key"), F.col("o_orderstatus").alias("content_hash"))
    after = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("stable_key"), F.when(F.col("o_totalprice") > 400000, "F").otherwise(F.col("o_orderstatus")).alias("content_hash"))
    return before, after


@query("c20_release_number", """
WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderpriority <> '1-URGENT'),
a AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 400000 THEN 'F' ELSE o_orderstatus END AS h FROM orders WHERE o_orderpriority <> '5-LOW'),
c AS (SELECT count(*) FILTER (b.k IS NULL) AS added, count(*) FILTER (b.h <> a.h) AS updated, count(*) FILTER (a.k IS NULL) AS removed FROM b FULL JOIN a USING (k))
SELECT added, updated, removed, CASE WHEN added > 0 OR removed > 0 THEN '1.1.0' WHEN updated > 0 THEN '1.0.1' ELSE '1.0.0' END AS kb_version FROM c""")
def c20(spark, d):
    c = versioning.changes(*snapshots(spark, d)).agg(*[F.count_if(F.col("change") == x).alias(x) for x in ("added", "updated", "removed")])
    return c.withColumn("kb_version", versioning.bump_release(F.lit("1.0.0"), F.col("added"), F.col("updated"), F.col("removed")))


@query("c22_record_ids", """
SELECT o_orderkey, 'kb_' || lower(o_orderstatus) || '_' || substr(o_orderpriority, 1, 1) || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS record_id
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)""")
def c22(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws("_", F.lower("o_orderstatus"), F.substring("o_orderpriority", 1, 1)).alias("prefix"))
    n = dedupe.row_numbers(o, "prefix", "o_orderkey")
    parts = F.split("prefix", "_")
    return n.select("o_orderkey", versioning.record_id(parts[0], parts[1], F.col("n")).alias("record_id"))


@query("x01_union_of_ids", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 40")
def x01(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")).union(table(spark, d, "part").where("p_size > 40").select("p_partkey")).distinct()


@query("x02_shared_terms", f"""
WITH q AS (SELECT item_id, list_distinct({TOKENS_SQL}) AS q FROM benchmark), s AS (SELECT source, list_distinct(flatten(list({TOKENS_SQL}))) AS t FROM documents GROUP BY source)
SELECT item_id, source, CAST(len(list_intersect(q, t)) AS BIGINT) AS n_matched FROM q, s WHERE len(list_intersect(q, t)) > 0""")
def x02(spark, d):
    q = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("t"))
    s = table(spark, d, "documents").select("source", F.explode(text.tokens(F.col("text"))).alias("t")).distinct()
    return q.join(s, "t").groupBy("item_id", "source").agg(F.count("*").alias("n_matched"))


@query("x03_removed_keys", "SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def x03(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")).subtract(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("x04_ordered_distinct", f"""
WITH w AS (SELECT item_id, {WORDS_SQL} AS ws FROM benchmark), e AS (SELECT item_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w)
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT item_id, w, min(i) AS i FROM e GROUP BY ALL) GROUP BY item_id""")
def x04(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(text.words(F.col("text"))), " ").alias("words"))


@query("x05_last_wins", "SELECT l_orderkey, l_suppkey, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def x05(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("l_partkey"))


@query("x06_issues", rf"""
SELECT 'quarantined' AS kind, source AS source_id, CAST(doc_id AS VARCHAR) AS uri FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_KINDS_SQL}) GROUP BY doc_id HAVING count(DISTINCT kind) >= 3)
UNION ALL SELECT 'extraction_failure', regexp_extract(url, '^https?://([^/]+)', 1), url FROM pages WHERE length(html) < 600
UNION ALL SELECT 'warning', source, CAST(doc_id AS VARCHAR) FROM documents WHERE length(text) < 60""")
def x06(spark, d):
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    held = docs.where(F.size(pii.kinds(F.col("text"))) >= 3).select(F.lit("quarantined").alias("kind"), F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("uri"))
    failed = pages.where(F.length("html") < 600).select(F.lit("extraction_failure").alias("kind"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source_id"), F.col("url").alias("uri"))
    short = docs.where(F.length("text") < 60).select(F.lit("warning").alias("kind"), F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("uri"))
    return held.unionByName(failed).unionByName(short)


@query("a04_counters", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def a04(spark, d):
    return table(spark, d, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n")).select("lang", "source", "n")


@query("a05_line_frequency", f"SELECT lower(trim(line)) AS key, count(DISTINCT doc_id) AS n_docs FROM ({LINES_SQL}) WHERE trim(line) <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) > 1")
def a05(spark, d):
    keyed = lines(spark, d).select(F.lower(F.trim("line")).alias("key"), "doc_id").where("key <> ''").distinct()
    return keyed.groupBy("key").agg(F.count("*").alias("n_docs")).where("n_docs > 1")


@query("a15_contradictions", """
WITH f AS (SELECT CAST(l_partkey AS VARCHAR) AS market, l_returnflag AS fact, l_discount AS value, l_linenumber AS authority, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d, l_orderkey * 10 + l_linenumber AS record_id FROM lineitem),
w AS (SELECT *, row_number() OVER (PARTITION BY market, fact ORDER BY authority DESC, d DESC, record_id) AS rn FROM f),
t AS (SELECT market, fact, count(DISTINCT value) AS n_values FROM f GROUP BY ALL HAVING count(DISTINCT value) > 1)
SELECT f.market, f.fact, f.record_id, f.value, w.value AS authoritative_value, w.record_id AS authoritative_record, n_values, f.value <> w.value AS needs_review
FROM f JOIN t USING (market, fact) JOIN w ON w.market = f.market AND w.fact = f.fact AND w.rn = 1""")
def a15(spark, d):
    li = table(spark, d, "lineitem")
    facts = li.select(F.col("l_partkey").cast("string").alias("market"), F.col("l_returnflag").alias("fact"), F.col("l_discount").alias("value"), F.col("l_linenumber").alias("authority"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("effective_date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"))
    return conflicts.contradictions(facts)


@query("a16_superseded", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) THEN 'active' ELSE 'superseded' END AS status FROM orders""")
def a16(spark, d):
    return conflicts.superseded(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "status")


@query("a17_kinds_by_record", f"SELECT doc_id, string_agg(kind, ',' ORDER BY kind) AS pii_types FROM ({_KINDS_SQL}) GROUP BY doc_id")
def a17(spark, d):
    found = table(spark, d, "documents").select("doc_id", pii.kinds(F.col("text")).alias("k"))
    return found.where(F.size("k") > 0).select("doc_id", F.array_join("k", ",").alias("pii_types"))


@query("a18_modes", """
WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS rn FROM c)
SELECT p_brand, p_size AS mode_size, (SELECT max(p_size) FROM part x WHERE x.p_brand = m.p_brand) AS max_size FROM m WHERE rn = 1""")
def a18(spark, d):
    c = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return c.groupBy("p_brand").agg(F.max_by("p_size", F.struct("n", (-F.col("p_size")).alias("s"))).alias("mode_size"), F.max("p_size").alias("max_size"))


CATEGORIES = {"travel": ["the", "and"], "haus": ["und", "die"], "maison": ["que", "les"], "casa": ["ción", "las"]}


def _score_sql(words):
    return " + ".join(f"3 * ((length(lang) - length(replace(lang, '{w}', ''))) // {len(w)}) + ((length(text) - length(replace(text, '{w}', ''))) // {len(w)})" for w in words)


@query("a23_categories", f"""
WITH s AS (SELECT doc_id, {', '.join(f'{_score_sql(w)} AS {c}' for c, w in CATEGORIES.items())} FROM (SELECT doc_id, lang, lower(text) AS text FROM documents)),
b AS (SELECT *, greatest({', '.join(CATEGORIES)}) AS top FROM s)
SELECT doc_id, CASE WHEN top = 0 THEN 'general' {' '.join(f"WHEN {c} = top THEN '{c}'" for c in CATEGORIES)} END AS category FROM b""")
def a23(spark, d):
    from ..operators.normalizing import category

    docs = table(spark, d, "documents")
    return docs.select("doc_id", category(F.col("lang"), F.lower("text"), CATEGORIES, "general").alias("category"))


@query("w02_outliers", """
WITH n AS (SELECT l_orderkey, l_linenumber, l_extendedprice, list_sort(list_filter([lag(l_extendedprice, 2) OVER w, lag(l_extendedprice, 1) OVER w, lead(l_extendedprice, 1) OVER w, lead(l_extendedprice, 2) OVER w], lambda x: x IS NOT NULL)) AS near
 FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice))
SELECT l_orderkey, l_linenumber, l_extendedprice, coalesce(l_extendedprice > 3 * list_median(near), false) AS flagged FROM n""".replace("list_median(near)", "((near[(len(near) + 1) // 2] + near[len(near) // 2 + 1]) / 2)"))
def w02(spark, d):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    return conflicts.outliers(table(spark, d, "lineitem"), ["l_partkey"], order, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice", "flagged")


@query("w10_keep_first", r"""
WITH k AS (SELECT doc_id, lang, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key, length(text) AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY n DESC, doc_id) AS rn, count(*) OVER (PARTITION BY lang, key) AS c FROM k)
SELECT doc_id, lang, c AS n FROM r WHERE rn = 1""")
def w10(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", text.dedupe_key(F.col("text")).alias("key"), F.length("text").alias("n_text"))
    rows = rows.withColumn("key", F.sha2("key", 256))
    return dedupe.keep_first(rows, ["lang", "key"], [-F.col("n_text")], "doc_id").select("doc_id", "lang", "n")


PAIRS_SQL = f"""
WITH w AS (SELECT doc_id, lang, {WORDS_SQL} AS ws FROM documents),
s AS (SELECT doc_id, lang, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: hash(array_to_string(ws[i:i + 4], ' '))))) AS sh FROM w),
c AS (SELECT lang, sh, min(doc_id) AS doc_id, len(sh) AS m FROM s GROUP BY ALL),
e AS (SELECT lang, doc_id, m, unnest(sh) AS x FROM c),
d AS (SELECT lang, x, count(*) AS df FROM e GROUP BY ALL),
r AS (SELECT e.*, row_number() OVER (PARTITION BY e.lang, doc_id ORDER BY df, e.x) AS i FROM e JOIN d ON d.lang = e.lang AND d.x = e.x),
h AS (SELECT * FROM r WHERE i <= m - ceil(0.8 * m) + 1),
k AS (SELECT DISTINCT a.lang, a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.lang = b.lang AND a.x = b.x AND a.doc_id < b.doc_id AND a.m >= 0.8 * b.m AND b.m >= 0.8 * a.m),
p AS (SELECT k.lang AS market, k.a, k.b, len(list_intersect(x.sh, y.sh)) AS common, x.m AS ma, y.m AS mb FROM k JOIN c x ON x.doc_id = k.a JOIN c y ON y.doc_id = k.b)
SELECT market, a, b, round(common / (ma + mb - common), 6) AS jaccard FROM p WHERE common / (ma + mb - common) >= 0.8"""


@query("j12_near_pairs", PAIRS_SQL)
def j12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("market"), "text")
    return dedupe.near_pairs(docs).select("market", "a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("j12_classes", f"""
WITH w AS (SELECT doc_id, lang, {WORDS_SQL} AS ws FROM documents),
s AS (SELECT doc_id, lang AS market, hash(list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: hash(array_to_string(ws[i:i + 4], ' ')))))) AS sh FROM w)
SELECT market, doc_id, min(doc_id) OVER (PARTITION BY market, sh) AS class_id FROM s""")
def j12_classes(spark, d):
    return dedupe.classes(table(spark, d, "documents").select("doc_id", F.col("lang").alias("market"), "text"))


@query("j12_greedy_merge")
def j12_merge(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("market"), "text")
    return dedupe.greedy_merge(dedupe.near_pairs(docs))


@query("h03_rate_chunks", """
SELECT l_suppkey, l_returnflag, count(*) AS n_lines, string_agg(l_orderkey || '/' || l_linenumber || ': ' || CASE WHEN l_discount > 0.09 THEN 'unavailable' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END, chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS content
FROM lineitem GROUP BY ALL""")
def h03(spark, d):
    value = F.when(F.col("l_discount") > 0.09, "unavailable").otherwise(F.col("l_quantity").cast("long").cast("string"))
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit(": "), value)
    return chunking.rate_chunks(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], line, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


@query("h06_alias_tags", f"""
WITH t AS (SELECT source, string_agg(DISTINCT kind, ',' ORDER BY kind) AS tags FROM ({_KINDS_SQL}) JOIN documents USING (doc_id) GROUP BY source) SELECT doc_id, source, tags FROM documents LEFT JOIN t USING (source)""")
def h06(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", pii.kinds(F.col("text")).alias("k"))
    tags = docs.select("source", F.explode("k").alias("k")).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("tags"))
    return docs.join(tags, "source", "left").select("doc_id", "source", "tags")


@query("h07_also_found_in", r"""
WITH k AS (SELECT source, md5(lower(trim(text))) AS key FROM documents), s AS (SELECT key, list_sort(list(DISTINCT source)) AS a FROM k GROUP BY key)
SELECT key, a[1] AS source, array_to_string(a[2:], ',') AS also_found_in FROM s""")
def h07(spark, d):
    rows = table(spark, d, "documents").select("source", F.md5(F.lower(F.trim("text"))).alias("key"))
    return dedupe.sources_of(rows, ["key"], "source").select("key", "source", F.array_join("also_found_in", ",").alias("also_found_in"))


@query("w13_sections", r"""
WITH l AS (SELECT doc_id, pos, line, regexp_matches(line, '\.$') AND length(line) < 60 AS head FROM (""" + LINES_SQL + r""") WHERE trim(line) <> '')
SELECT doc_id, pos, last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section, count(CASE WHEN head THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM l""")
def w13(spark, d):
    rows = lines(spark, d).where(F.trim("line") != "")
    head = F.col("line").rlike(r"\.$") & (F.length("line") < 60)
    blocks = rows.select("doc_id", "pos", F.when(head, "heading").otherwise("paragraph").alias("kind"), F.col("line").alias("text"))
    return chunking.sections(blocks).select("doc_id", "pos", "section", "section_no")


@query("w14_packed_chunks")
def w14(spark, d):
    blocks = markdown.blocks(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return chunking.pack(chunking.sections(blocks).withColumn("overlap", ~F.coalesce(F.rtrim("section").endswith("?"), F.lit(False))))


@query("o08_longest_first", "SELECT p_type, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names, max(length(p_name)) AS longest FROM part GROUP BY p_type")
def o08(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("names"), F.max(F.length("p_name")).cast("long").alias("longest"))


@query("j14_facts", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{16}') THEN 'card' WHEN regexp_matches(text, '[0-9]+%') THEN 'percent' WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'licence' END AS fact FROM documents""")
def j14(spark, d):
    fact = conflicts.first_matching(F.lower("text"), {"card": "[0-9]{16}", "percent": "[0-9]+%", "licence": "licen[sc]e"})
    return table(spark, d, "documents").select("doc_id", fact.alias("fact"))


@query("a01_medians", """
WITH s AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, round(v[least(len(v) - 1, CAST(floor(0.95 * (len(v) - 1) + 0.5) AS INTEGER)) + 1], 1) AS nearest95, v[CAST(floor(0.95 * (len(v) - 1)) AS INTEGER) + 1] AS floor95, v[len(v) // 2 + 1] AS upper_median, (v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2 AS median FROM s""")
def a01_medians(spark, d):
    places = {"nearest95": ranks.nearest(0.95), "floor95": ranks.floored(0.95), "upper_median": lambda n: F.floor(n / 2), "lower_median": lambda n: F.floor((n - 1) / 2)}
    s = ranks.at_places(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", places)
    return s.select("l_suppkey", F.round("nearest95", 1).alias("nearest95"), "floor95", "upper_median", ((F.col("lower_median") + F.col("upper_median")) / 2).alias("median"))


@query("c02_glyph_repairs", "SELECT doc_id, (length(text) - length(replace(text, '###', ''))) // 3 AS repairs, replace(replace(text, '###', '#'), '%%%', '%') AS clean FROM documents")
def c02(spark, d):
    from ..operators.normalizing import repair_glyphs

    clean, repairs = repair_glyphs(F.col("text"), [("###", "#"), ("%%%", "%")])
    return table(spark, d, "documents").select("doc_id", repairs[0].cast("long").alias("repairs"), clean.alias("clean"))


TERMS = {"the organisation": ["thone", "than"], "AND": ["UND"], "maison": ["aux les", "les"]}


@query("c09_terminology")
def c09(spark, d):
    from ..operators.normalizing import terminology

    found = table(spark, d, "documents").select("doc_id", terminology(F.col("text"), TERMS).alias("t"))
    return found.select("doc_id", F.col("t.text").alias("clean"), F.array_join("t.hits", ",").alias("hits"))


@query("c11_dates", r"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' / ' || strftime(o_orderdate, '%Y-%m-%d') || ' / ' || strftime(o_orderdate, '%Y-%m-%d') || ' / 31/02/2025, order ' || o_orderkey AS text, '31/02/2025' AS invalid FROM orders""")
def c11(spark, d):
    from ..operators.normalizing import dates

    day, month, year = F.dayofmonth("o_orderdate").cast("string"), F.date_format("o_orderdate", "MMMM"), F.year("o_orderdate").cast("string")
    forms = [F.concat(day, F.lit(" "), month, F.lit(" "), year), F.concat(month, F.lit(" "), day, F.lit(", "), year), F.concat(day, F.lit("/"), F.month("o_orderdate").cast("string"), F.lit("/"), year)]
    said = F.concat_ws(" / ", *forms, F.concat(F.lit("31/02/2025, order "), F.col("o_orderkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", dates(said).alias("x")).select("o_orderkey", "x.text", F.array_join("x.invalid", ",").alias("invalid"))


@query("w12_rolling_buffer", """
SELECT event_id, count(*) OVER w AS n_heard, round(avg(value) OVER w, 6) AS average_confidence FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 14400000000 PRECEDING AND CURRENT ROW)""")
def w12(spark, d):
    """What was heard in the last four hours: events are hours apart where utterances are seconds."""
    ev = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return calls.rolling_buffer(ev, "user_id", "us", 14_400, "value").select("event_id", "n_heard", F.round("average_confidence", 6).alias("average_confidence"))


@query("j11_names_near_ids", rf"""
WITH t AS (SELECT doc_id, string_split_regex(trim(text), '\s+') AS ts FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN regexp_matches(ts[i], '{pii.DIRECT_ID}') THEN i END), lambda x: x IS NOT NULL) AS ids,
 list_filter(list_transform(range(1, len(ts)), lambda i: CASE WHEN regexp_matches(ts[i], '{pii.CAPITALISED}') AND regexp_matches(ts[i + 1], '{pii.CAPITALISED}') THEN i END), lambda x: x IS NOT NULL) AS names FROM t)
SELECT doc_id, len(names) AS n_names, len(list_filter(names, lambda i: len(list_filter(ids, lambda j: abs(i - j) <= 15)) > 0)) AS n_kept FROM p WHERE len(names) > 0""")
def j11(spark, d):
    tokens = F.split(F.trim("text"), r"\s+")
    placed = table(spark, d, "documents").select("doc_id", pii.name_places(tokens).alias("names"), pii.id_places(tokens).alias("ids")).where(F.size("names") > 0)
    return placed.select("doc_id", F.size("names").cast("long").alias("n_names"), F.size(pii.near(F.col("names"), F.col("ids"), 15)).cast("long").alias("n_kept"))


@query("h05_form_schema", r"""
WITH l AS (SELECT doc_id, pos, line FROM (""" + LINES_SQL + r""")), f AS (SELECT doc_id, pos, trim(split_part(line, ':', 1)) AS label FROM l WHERE regexp_matches(line, '^[^:]{1,40}:\s*\S') UNION ALL
SELECT doc_id, pos, trim(line) FROM l WHERE regexp_matches(line, '^[^|]+ \| '))
SELECT doc_id, string_agg(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), ',' ORDER BY pos, label) AS fields, count(*) AS n FROM f GROUP BY doc_id""")
def h05(spark, d):
    rows = lines(spark, d)
    values = rows.where(F.col("line").rlike(r"^[^:]{1,40}:\s*\S")).select("doc_id", "pos", F.trim(F.split_part("line", F.lit(":"), F.lit(1))).alias("label"))
    columns = rows.where(F.col("line").rlike(r"^[^|]+ \| ")).select("doc_id", "pos", F.trim("line").alias("label"))
    return chunking.form_schema(values.union(columns), [])
