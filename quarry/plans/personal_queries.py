"""Personal data of documents, and of customers' records made of table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii
from ..operators import personal
from .registry import query, table

#: Orders as lines of a customer record: a number of each kind is made of the order's key; two of five stand far from their name.
RECORD_SQL = """r AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS d, o_orderkey % 8 AS m, CASE WHEN o_orderkey % 5 < 2 THEN 120 ELSE 20 END AS gap FROM orders),
t AS (SELECT *, CASE m WHEN 0 THEN 'ABCPD' || right(d, 4) || 'F' WHEN 1 THEN '+91 98' || left(d, 3) || ' ' || right(d, 5) WHEN 2 THEN '+63 917 ' || left(d, 3) || ' ' || right(d, 4) WHEN 3 THEN '+62 812 ' || left(d, 4) || ' ' || right(d, 4)
  WHEN 4 THEN '123-' || left(d, 3) || '-' || right(d, 3) WHEN 5 THEN '12.' || left(d, 3) || '.' || right(d, 3) || '.1-234.567' WHEN 6 THEN 'a' || d || '@example.com' ELSE 'nothing' END AS found,
 CASE m WHEN 0 THEN 'IN_PAN' WHEN 4 THEN 'PH_TIN' WHEN 5 THEN 'ID_NPWP' WHEN 6 THEN 'EMAIL' WHEN 7 THEN NULL ELSE 'PHONE' END AS label FROM r)"""


def records(spark, d):
    k = F.col("o_orderkey")
    n = F.lpad(k.cast("string"), 8, "0")
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    left, right = lambda i: F.substring(n, 1, i), lambda i: F.substring(n, 9 - i, i)
    forms = [
        part("ABCPD", right(4), "F"), part("+91 98", left(3), " ", right(5)), part("+63 917 ", left(3), " ", right(4)), part("+62 812 ", left(4), " ", right(4)),
        part("123-", left(3), "-", right(3)), part("12.", left(3), ".", right(3), ".1-234.567"), part("a", n, "@example.com"), F.lit("nothing"),
    ]
    gap = F.when(k % 5 < 2, 120).otherwise(20)
    text = F.concat(F.lit("Name: Anil Verma;"), F.repeat(F.lit("."), gap), F.lit(" "), F.element_at(F.array(*forms), (k % 8 + 1).cast("int")), F.lit(" end"))
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"))


@query("c18_record_redaction", f"""
WITH {RECORD_SQL} SELECT k AS o_orderkey, 'Name: ' || CASE WHEN label IS NOT NULL AND gap = 20 THEN '[REDACTED_PERSON]' ELSE 'Anil Verma' END || ';' || repeat('.', gap) || ' ' || CASE WHEN label IS NULL THEN found ELSE '[REDACTED_' || label || ']' END || ' end' AS clean FROM t""")
def c18(spark, d):
    found = personal.with_spans(records(spark, d))
    return found.select("o_orderkey", personal.redacted(F.col("text"), F.col("spans")).alias("clean"))


@query("c17_labels", f"WITH {RECORD_SQL} SELECT k AS o_orderkey, CASE WHEN label IS NULL THEN '' WHEN gap = 120 THEN label ELSE array_to_string(list_sort([label, 'PERSON']), ',') END AS labels FROM t")
def c17(spark, d):
    return personal.with_spans(records(spark, d)).select("o_orderkey", F.array_join(personal.labels(F.col("spans")), ",").alias("labels"))


@query("j11_persons_by_distance", f"WITH {RECORD_SQL} SELECT k AS o_orderkey, CASE WHEN label IS NOT NULL AND gap = 20 THEN 1 ELSE 0 END AS near, 1 AS about_people FROM t")
def j11(spark, d):
    persons = lambda c: F.size(F.filter(c, lambda s: s["kind"] == "PERSON"))
    near = personal.with_spans(records(spark, d)).select("o_orderkey", "text", persons(F.col("spans")).alias("near"))
    return personal.with_spans(near, about_people=F.lit(True)).select("o_orderkey", "near", persons(F.col("spans")).alias("about_people"))


_CARD_SQL = """list_sum(list_transform(range(0, 16), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(substr(reverse(c), i + 1, 1) AS BIGINT) * 2 > 9 THEN CAST(substr(reverse(c), i + 1, 1) AS BIGINT) * 2 - 9 ELSE CAST(substr(reverse(c), i + 1, 1) AS BIGINT) * 2 END
 ELSE CAST(substr(reverse(c), i + 1, 1) AS BIGINT) END)) % 10 = 0"""


@query("c17_cards_or_ids", rf"""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{{16}}\b')) AS c FROM documents)
SELECT doc_id, count(*) FILTER ({_CARD_SQL}) AS cards, count(*) FILTER (NOT ({_CARD_SQL})) AS ids FROM c GROUP BY doc_id""")
def c17_cards(spark, d):
    """Sixteen digits are a card's if its check digit is right, else an identity number.

    Whatever they begin with: the operator's cards begin as card issuers' do, so its identity numbers are checked too.
    """
    sixteen = F.filter("spans", lambda s: (s["end"] - s["start"] == 16) & s["kind"].isin("CREDIT_CARD", "ID_NIK"))
    right = F.transform(sixteen, lambda s: (s["kind"] == "CREDIT_CARD") | pii.luhn_valid(F.substring(F.col("text"), s["start"] + 1, F.lit(16))))
    found = personal.with_spans(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", right.alias("s")).where(F.size("s") > 0)
    return found.select("doc_id", F.size(F.filter("s", lambda x: x)).cast("long").alias("cards"), F.size(F.filter("s", lambda x: ~x)).cast("long").alias("ids"))


@query("f07_customer_records")
def f07(spark, d):
    """Documents that are somebody's record, by the kinds of personal data in them."""
    found = personal.with_spans(table(spark, d, "documents").select("doc_id", "text"))
    return found.where(personal.is_customer_record(F.col("spans"))).select("doc_id", personal.labels(F.col("spans")).alias("labels"))
