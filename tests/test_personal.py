"""Personal data against plain definitions."""

import itertools
import random

from pyspark.sql import functions as F

from quarry.operators import personal

CHECKED = "234123412346"  # a right check digit


def kinds(text, **kw):
    return [(text[s.start : s.end], s.kind) for s in personal.spans(text, **kw)]


def test_kinds():
    assert personal.verhoeff(CHECKED) and not any(personal.verhoeff(CHECKED[:-1] + str(d)) for d in range(10) if d != 6)
    assert kinds(f"uid {CHECKED[:4]} {CHECKED[4:8]} {CHECKED[8:]}.") == [("2341 2341 2346", "IN_AADHAAR")] and kinds("uid 2341 2341 2345.") == []
    assert kinds("4111 1111 1111 1111") == [("4111 1111 1111 1111", "CREDIT_CARD")]
    assert kinds("4111111111111111") == [("4111111111111111", "CREDIT_CARD")] and kinds("4111111111111112") == [("4111111111111112", "ID_NIK")]
    assert kinds("ABCPD1234F ABCDD1234F") == [("ABCPD1234F", "IN_PAN")]
    assert kinds("+91 98765 43210, +63 917 123 4567, +62 812 3456 7890, +1 (743) 555-3824") == [("+91 98765 43210", "IN_PHONE"), ("+63 917 123 4567", "PH_PHONE"), ("+62 812 3456 7890", "ID_PHONE"), ("+1 (743) 555-3824", "PHONE_NUMBER")]
    assert kinds("123-456-789 and 12.345.678.9-012.345") == [("123-456-789", "PH_TIN"), ("12.345.678.9-012.345", "ID_NPWP")]
    assert {personal.label(k.name) for k in personal.KINDS} == {"EMAIL", "CREDIT_CARD", "IN_AADHAAR", "IN_PAN", "PHONE", "PH_TIN", "ID_NIK", "ID_NPWP", "PERSON"}


def test_persons_need_something_near():
    far, near = "." * 101, "." * 99
    assert kinds("Name: Anil Verma") == [] and kinds("Name: Anil Verma", about_people=True) == [("Anil Verma", "PERSON")]
    assert len(kinds(f"Name: Anil Verma{near} a@b.com")) == 2 and len(kinds(f"Name: Anil Verma{far} a@b.com")) == 1
    assert len(kinds(f"a@b.com{'.' * 50} Name: Anil Verma")) == 2 and len(kinds(f"a@b.com{far} Name: Anil Verma")) == 1
    assert kinds("“Good.” — Ramesh Kumar, Pune; a@b.com") == [("Ramesh Kumar", "PERSON"), ("a@b.com", "EMAIL_ADDRESS")]
    assert kinds("write to help@ours.example", allowed=("help@ours.example",)) == []


def test_overlaps():
    rng = random.Random(2)
    for _ in range(300):
        found = [personal.Span(a, a + rng.randrange(1, 6), rng.choice("XYZ"), rng.choice([0.4, 0.7, 1.0])) for a in (rng.randrange(12) for _ in range(rng.randrange(7)))]
        kept = personal.without_overlaps(found)
        assert kept == sorted(kept) and all(x.end <= y.start for x, y in itertools.pairwise(kept))
        rank = lambda s: (-s.score, s.start - s.end, s.start, s.kind)
        plain = []
        for s in sorted(found, key=rank):
            if all(s.end <= t.start or t.end <= s.start for t in plain):
                plain.append(s)
        assert kept == sorted(plain)


def test_columns(spark):
    rows = [(1, "mail a@b.com or +91 98765 43210 now"), (2, None), (3, ""), (4, "PAN ABCPD1234F, a@b.com, +63 917 123 4567"), (5, "é🙂 a@b.com 🙂 4111111111111111")]
    df = personal.with_spans(spark.createDataFrame(rows, "id long, text string"))
    got = {r["id"]: (r["clean"], r["labels"], r["record"]) for r in df.select("id", personal.redacted(F.col("text"), F.col("spans")).alias("clean"), personal.labels(F.col("spans")).alias("labels"), personal.is_customer_record(F.col("spans")).alias("record")).collect()}
    assert got[1] == ("mail [REDACTED_EMAIL] or [REDACTED_PHONE] now", ["EMAIL", "PHONE"], False)
    assert got[2] == (None, [], False) and got[3] == ("", [], False) and got[4][2] and got[4][0] == "PAN [REDACTED_IN_PAN], [REDACTED_EMAIL], [REDACTED_PHONE]"
    assert got[5][0] == "é🙂 [REDACTED_EMAIL] 🙂 [REDACTED_CREDIT_CARD]"
