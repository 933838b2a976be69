"""Text columns over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii, text
from ..operators import answers, chunking, turns
from .registry import query, table

STOP_SQL = ", ".join(f"'{w}'" for w in text.STOPWORDS)
WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
TOKENS_SQL = f"list_filter({WORDS_SQL}, lambda w: length(w) > 1 AND w NOT IN ({STOP_SQL}))"


@query("c01_normalize_whitespace", r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[\s\x{00a0}\x{200b}\x{200c}\x{200d}\x{feff}]+', ' ', 'g'), ' ') AS clean FROM documents")
def c01(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_whitespace(F.col("text")).alias("clean"))


@query("c03_line_keys", r"""
SELECT key, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs
FROM (SELECT doc_id, regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g') AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
WHERE key <> '' GROUP BY key""")
def c03(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", text.line_key(F.col("line")).alias("key"))
    return lines.where("key <> ''").groupBy("key").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


@query("c04_dedupe_key", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key FROM documents")
def c04(spark, d):
    return table(spark, d, "documents").select("doc_id", text.dedupe_key(F.col("text")).alias("key"))


@query("c05_shingles", f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
s AS (SELECT doc_id, list_transform(range(1, greatest(len(ws) - 2, 1) + 1), lambda i: array_to_string(ws[i:i + 2], ' ')) AS sh FROM w)
SELECT doc_id, len(sh) AS n_shingles, len(list_distinct(sh)) AS n_distinct FROM s""")
def c05(spark, d):
    sh = table(spark, d, "documents").select("doc_id", text.shingles(text.words(F.col("text"))).alias("sh"))
    return sh.select("doc_id", F.size("sh").cast("long").alias("n_shingles"), F.size(F.array_distinct("sh")).cast("long").alias("n_distinct"))


@query("c06_token_count", f"SELECT doc_id, CAST(floor(len({WORDS_SQL}) * 1.3) AS BIGINT) AS token_count FROM documents")
def c06(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("token_count"))


@query("c07_tokenize", f"SELECT doc_id, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM documents")
def c07(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query("c08_stems", f"""
WITH t AS (SELECT DISTINCT unnest({WORDS_SQL}) AS word FROM documents),
a AS (SELECT word, CASE WHEN length(word) >= 6 THEN regexp_replace(word, '(nya|lah|kah|kan|an)$', '') ELSE word END AS a FROM t),
b AS (SELECT word, CASE WHEN length(a) >= 6 THEN regexp_replace(a, '^(meng|meny|mem|men|me|peng|peny|pem|pen|pe|ber|ter|di|ke|se)', '') ELSE a END AS b FROM a)
SELECT word, CASE WHEN length(word) < 6 OR length(b) < 3 THEN word ELSE b END AS stem FROM b""")
def c08(spark, d):
    ws = table(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    return ws.select("word", text.stem_id(F.col("word")).alias("stem"))


@query("c12_headings", r"""
WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages),
a AS (SELECT page_id, title, rtrim(trim(regexp_replace(title, '^\s*[0-9]+(\.[0-9]+)*[.)]?\s+', '')), ':') AS h FROM t),
b AS (SELECT *, CASE WHEN h = upper(h) AND h <> lower(h) THEN array_to_string(list_transform(string_split(lower(h), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') ELSE h END AS k FROM a)
SELECT page_id, title, CASE lower(h) WHEN 'home' THEN 'Start' ELSE CASE WHEN k LIKE 'ß%' THEN 'SS' ELSE upper(substr(k, 1, 1)) END || substr(k, 2) END AS heading FROM b""")
def c12(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return rows.select("page_id", "title", chunking.heading(F.col("title"), {"home": "Start"}).alias("heading"))


@query("c13_form_fields", """
SELECT l_linestatus || ' ' || l_returnflag AS label, CASE WHEN l_returnflag = 'A' THEN 'accepted' WHEN l_returnflag LIKE 'R%' THEN 'returned'
 ELSE lower(l_linestatus || '_' || l_returnflag) END AS field, count(*) AS n FROM lineitem GROUP BY ALL""")
def c13(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat_ws(" ", "l_linestatus", "l_returnflag").alias("label"))
    field = chunking.form_field(F.col("label"), [(r" A$", "accepted"), (r" R", "returned")])
    return rows.select("label", field.alias("field")).groupBy("label", "field").agg(F.count("*").alias("n"))


@query("c14_product", """
SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'jewel' WHEN contains(p_name, 'bolt') THEN 'fastener' WHEN contains(p_name, 'widget') THEN 'device' END AS product FROM part""")
def c14(spark, d):
    product = chunking.first_keyword(F.col("p_name"), {"ring": "jewel", "bolt": "fastener", "widget": "device"})
    return table(spark, d, "part").select("p_partkey", product.alias("product"))


@query("c15_indian_grouping", r"""
WITH d AS (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS s FROM orders)
SELECT o_orderkey, '₹' || CASE WHEN length(s) <= 3 THEN s WHEN length(s) <= 5 THEN substr(s, 1, length(s) - 3) || ',' || right(s, 3)
 ELSE substr(s, 1, length(s) - 5) || ',' || substr(s, length(s) - 4, 2) || ',' || right(s, 3) END AS amount FROM d""")
def c15(spark, d):
    digits = F.floor("o_totalprice").cast("string")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("₹"), text.indian_grouping(digits)).alias("amount"))


_PRODUCT, _PERMUTE = pii.verhoeff_tables()
VERHOEFF_SQL = f"""
WITH d AS (SELECT o_orderkey, reverse(CAST(o_orderkey AS VARCHAR)) AS r FROM orders),
f AS (SELECT o_orderkey, list_reduce(list_prepend(0, list_transform(range(0, length(r)), lambda i: 10 * (i % 8) + CAST(substr(r, i + 1, 1) AS BIGINT))),
 lambda c, x: ({[v for row in _PRODUCT for v in row]})[1 + 10 * c + ({[v for row in _PERMUTE for v in row]})[1 + x]]) AS c FROM d)
SELECT o_orderkey, c = 0 AS valid FROM f"""


@query("c16_verhoeff", VERHOEFF_SQL)
def c16(spark, d):
    return table(spark, d, "orders").select("o_orderkey", pii.verhoeff_valid(F.col("o_orderkey").cast("string")).alias("valid"))


_EXTRACTS = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS n_{k.lower()}" for k, p in pii.PATTERNS.items())


@query("c17_personal_data", f"SELECT doc_id, {_EXTRACTS} FROM documents")
def c17(spark, d):
    counts = [F.size(pii.found(F.col("text"), k)).cast("long").alias(f"n_{k.lower()}") for k in pii.PATTERNS]
    return table(spark, d, "documents").select("doc_id", *counts)


_LUHN = """list_sum(list_transform(range(0, length(c)), lambda i: CASE WHEN i % 2 = 1 THEN
 CASE WHEN CAST(substr(reverse(c), i + 1, 1) AS BIGINT) * 2 > 9 THEN CAST(substr(reverse(c), i + 1, 1) AS BIGINT) * 2 - 9 ELSE CAST(substr(reverse(c), i + 1, 1) AS BIGINT) * 2 END
 ELSE CAST(substr(reverse(c), i + 1, 1) AS BIGINT) END)) % 10 = 0"""


@query("c17_card_numbers", rf"WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pii.PATTERNS['CARD']}')) AS c FROM documents) SELECT doc_id, c AS card, {_LUHN} AS valid FROM c")
def c17_cards(spark, d):
    cards = table(spark, d, "documents").select("doc_id", F.explode(pii.found(F.col("text"), "CARD")).alias("card"))
    return cards.withColumn("valid", pii.luhn_valid(F.col("card")))


_REDACT = "text"
for _k, _p in pii.PATTERNS.items():
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '[REDACTED_{_k}]', 'g')"


@query("c18_redact", f"SELECT doc_id, {_REDACT} AS clean FROM documents")
def c18(spark, d):
    return table(spark, d, "documents").select("doc_id", pii.redact(F.col("text")).alias("clean"))


@query("c19_content_hash", "SELECT doc_id, substr(sha256(concat_ws(chr(10), source, text)), 1, 16) AS content_hash FROM documents")
def c19(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


@query("c21_stable_key", "SELECT o_orderkey, concat_ws('|', o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)) AS stable_key FROM orders")
def c21(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("stable_key"))


@query("c24_citations", r"""
WITH t AS (SELECT l_orderkey, l_linenumber, 'Part ' || l_partkey || ' [' || l_linenumber || '] by ' || l_suppkey || ' [' || CAST(l_quantity AS BIGINT) || '].' AS answer FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, list_transform(regexp_extract_all(answer, '\[([0-9]+)\]', 1), lambda x: CAST(x AS INTEGER)) AS all_n FROM t)
SELECT l_orderkey, l_linenumber, len(all_n) AS n_marks, len(list_filter(all_n, lambda n: n BETWEEN 1 AND 4)) AS n_cited FROM c""")
def c24(spark, d):
    li = table(spark, d, "lineitem")
    answer = F.concat(F.lit("Part "), "l_partkey", F.lit(" ["), "l_linenumber", F.lit("] by "), "l_suppkey", F.lit(" ["), F.col("l_quantity").cast("long"), F.lit("]."))
    marks = answers.citation_marks(answer)
    return li.select("l_orderkey", "l_linenumber", F.size(marks).cast("long").alias("n_marks"), F.size(answers.valid_marks(marks, F.lit(4))).cast("long").alias("n_cited"))


@query("c25_extractive", r"""
SELECT doc_id, substr(array_to_string(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], ' '), 1, 320) AS answer FROM documents""")
def c25(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_sentences(F.col("text"), 2, 320).alias("answer"))


@query("c31_coerce", r"""
WITH k AS (SELECT event_id, json_extract_string(props, '$.k') AS raw, event_type FROM events)
SELECT event_id, CASE WHEN TRY_CAST(regexp_extract(raw, '-?[0-9]+') AS INTEGER) BETWEEN 10 AND 90 THEN TRY_CAST(regexp_extract(raw, '-?[0-9]+') AS INTEGER) END AS int_value,
 CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type END AS enum_value FROM k""")
def c31(spark, d):
    ev = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("raw"), "event_type")
    return ev.select("event_id", turns.coerce_int(F.col("raw"), 10, 90).alias("int_value"), turns.coerce_enum(F.col("event_type"), ["click", "view", "purchase"]).alias("enum_value"))


CLAUSES_SQL = r"list_filter(list_transform(string_split(regexp_replace(text, '([,.?!।])\s*|\n+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query("c33_turn_class", rf"""
WITH p AS (SELECT conv_id, turn, unnest({CLAUSES_SQL}) AS heard FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(heard), '^({'|'.join(turns.BACKCHANNELS)})[.!,]?$') THEN 'backchannel'
 WHEN regexp_matches(lower(heard), '(^|\s)({'|'.join(turns.CONNECTORS)})[,]?$') THEN 'incomplete'
 WHEN regexp_matches(heard, '[.?!।]$') THEN 'complete' ELSE 'unknown' END AS turn_class, count(*) AS n FROM p GROUP BY ALL""")
def c33(spark, d):
    heard = table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.clauses(F.col("text"))).alias("heard"))
    return heard.groupBy("conv_id", "turn", turns.fast_class(F.col("heard")).alias("turn_class")).agg(F.count("*").alias("n"))


@query("c35_character_error_rate", r"""
WITH p AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '?', 'g') AS ref, regexp_replace(regexp_replace(lower(text), '[^ -~]', '?', 'g'), '[^a-z0-9? ]+', '', 'g') AS hyp FROM conversations WHERE length(text) > 0)
SELECT conv_id, turn, levenshtein(ref, hyp) AS edits, round(levenshtein(ref, hyp) / length(ref), 6) AS cer FROM p""")
def c35(spark, d):
    ref = F.regexp_replace("text", "[^ -~]", "?")
    hyp = F.regexp_replace(F.regexp_replace(F.lower("text"), "[^ -~]", "?"), "[^a-z0-9? ]+", "")
    rows = table(spark, d, "conversations").where("length(text) > 0").select("conv_id", "turn", F.levenshtein(ref, hyp).alias("edits"), F.length(ref).alias("n"))
    return rows.select("conv_id", "turn", F.col("edits").cast("long").alias("edits"), F.round(F.col("edits") / F.col("n"), 6).alias("cer"))


@query("c36_term_recall", """
WITH t AS (SELECT doc_id, len(list_filter(['the', 'que', 'und', 'les'], lambda x: contains(lower(text), x))) AS found FROM documents)
SELECT doc_id, found, round(found / 4, 4) AS recall FROM t""")
def c36(spark, d):
    found = answers.terms_found(F.lower("text"), ["the", "que", "und", "les"])
    return table(spark, d, "documents").select("doc_id", found.cast("long").alias("found"), F.round(found / 4, 4).alias("recall"))


@query("c39_clauses", r"""
WITH c AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([,.?!।])\s*|\n+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS cs FROM conversations)
SELECT conv_id, turn, len(cs) AS n_clauses, cs[1] AS first_clause FROM c""")
def c39(spark, d):
    cs = table(spark, d, "conversations").select("conv_id", "turn", text.clauses(F.col("text")).alias("cs"))
    return cs.select("conv_id", "turn", F.size("cs").cast("long").alias("n_clauses"), F.try_element_at("cs", F.lit(1)).alias("first_clause"))


@query("c40_variant_lines", """
WITH o AS (SELECT o_orderkey, o_custkey, ['Order ' || o_orderkey || ' is noted.', 'Thanks, order ' || o_orderkey || ' is in.', 'Noted: ' || o_orderkey || '.'] AS v FROM orders)
SELECT o_orderkey, v[1 + o_custkey % 3] AS line FROM o""")
def c40(spark, d):
    lines = ["Order {order} is noted.", "Thanks, order {order} is in.", "Noted: {order}."]
    line = turns.variant(lines, F.col("o_custkey"), {"order": F.col("o_orderkey").cast("string")})
    return table(spark, d, "orders").select("o_orderkey", line.alias("line"))


@query("c41_time_phrases", r"""
SELECT conv_id, turn, regexp_extract(lower(text), '(to|in|at|on) (the|a|an) ([\p{L}]+)', 3) AS phrase FROM conversations
WHERE regexp_matches(lower(text), '(to|in|at|on) (the|a|an) [\p{L}]+')""")
def c41(spark, d):
    pattern = r"(to|in|at|on) (the|a|an) ([\p{L}]+)"
    return table(spark, d, "conversations").where(F.lower("text").rlike(pattern)).select("conv_id", "turn", F.regexp_extract(F.lower("text"), pattern, 3).alias("phrase"))


@query("c42_json_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def c42(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("c43_roles", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent' ELSE 'other' END AS speaker FROM conversations")
def c43(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", turns.speaker(F.col("role")).alias("speaker"))


@query("c44_table_cells", r"SELECT item_id, replace(CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END, '|', '\|') AS cell FROM benchmark")
def c44(spark, d):
    return table(spark, d, "benchmark").select("item_id", answers.table_cell(F.col("text"), 120).alias("cell"))


@query("s11_markdown_blocks", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents),
k AS (SELECT doc_id, pos, trim(line) AS line, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^#{2,} ') THEN 'heading' WHEN trim(line) LIKE '# %' THEN 'title'
 WHEN regexp_matches(trim(line), '^[-*] ') THEN 'list_item' ELSE 'paragraph' END AS kind FROM l),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, kind = 'paragraph' ORDER BY pos) AS island FROM k)
SELECT doc_id, min(pos) AS pos, kind, string_agg(line, ' ' ORDER BY pos) AS text FROM i WHERE kind <> 'blank' AND kind = 'paragraph' GROUP BY doc_id, kind, island
UNION ALL SELECT doc_id, pos, kind, trim(regexp_replace(line, '^(#+|[-*]) ', '')) AS text FROM i WHERE kind NOT IN ('blank', 'paragraph')""")
def s11(spark, d):
    from ..sources.markdown import blocks

    return blocks(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query("s04_page_links", r"""
WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, CASE WHEN starts_with(bare, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || bare ELSE bare END AS link
FROM (SELECT *, split_part(split_part(href, '#', 1), '?', 1) AS bare FROM h) WHERE bare <> '' AND NOT regexp_matches(href, '^(mailto|tel|javascript):')""")
def s04(spark, d):
    from ..sources.web import links

    return links(table(spark, d, "pages")).select("page_id", "link")


@query("s05_page_blocks")
def s05(spark, d):
    from ..sources.web import page_blocks

    return page_blocks(table(spark, d, "pages"))


@query("s07_page_rules", """
SELECT page_id, url, CASE WHEN contains(url, '/fr/') THEN 'marketing' WHEN contains(url, 'blog.') THEN 'testimonial' WHEN contains(url, '?') THEN 'reference' ELSE 'policy' END AS doc_type,
 CASE WHEN contains(url, '/fr/') THEN 2 WHEN contains(url, 'blog.') THEN 1 WHEN contains(url, '?') THEN 3 ELSE 5 END AS authority FROM pages""")
def s07(spark, d):
    from ..sources.web import by_rule

    rules = [("/fr/", "marketing", 2), ("blog.", "testimonial", 1), ("?", "reference", 3)]
    return by_rule(table(spark, d, "pages").select("page_id", "url"), rules, ("policy", 5))


@query("s05_main_text")
def s05_main(spark, d):
    """The main text of all pages, by the extractor that finds more."""
    from ..sources.maintext import main_blocks

    return main_blocks(table(spark, d, "pages"))
