"""Periodic runs against a version that tries every period."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import periods


def plain_runs(words, least=12):
    """Every period: maximal stretches of words that equal the word one period on; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = plain_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for k, w in enumerate(words) if k not in gone))]
    return (doc_id, len(runs), s, n, q, n and 1000 * n // q, *sha)


def test_random_words():
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        k, ws = rng.choice([1, 2, 3, 9]), []
        while len(ws) < rng.randrange(1, 120):
            part = [rng.randrange(k) for _ in range(rng.randrange(1, 14))]
            ws += part * rng.choice([1, 1, 2, 3, 7])
        texts.append([b"w%d" % x for x in ws])
    for least in (2, 12):
        assert periods.runs_of_all(texts, least) == [plain_runs(ws, least) for ws in texts]


def test_trees_agree_as_texts_do():
    rng = np.random.RandomState(1)
    for k in (1, 2, 5):
        s = rng.randint(0, k, 80)
        tree = periods.SuffixTree(s, k)
        i, j = np.triu_indices(81, 1)
        plain = [next((d for d in range(80 - b) if s[a + d] != s[b + d]), 80 - b) for a, b in zip(i, j, strict=True)]
        assert tree.agree(i, j).tolist() == plain
        by_rank = sorted(range(80), key=lambda a: [*s[a:].tolist(), k])
        assert sorted(range(80), key=lambda a: tree.rank[a]) == by_rank


def test_documents(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = periods.op11_periodic_runs(spark, data)
    assert got.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert {t for _, t in got.dtypes[:6]} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(digest(r["doc_id"], r["text"]) for r in rows)


def test_odd_rows(spark):
    long = "a b c " * 40_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 12), (4, "x " * 12), (5, "x " * 11), (None, "y z " * 9), (6, long), (7, "\x1c\x85\xa0 " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    got = {r["doc_id"]: r for r in periods.word_runs(df).collect()}
    runs = {k: [tuple(x) for x in r["runs"]] for k, r in got.items()}
    assert runs == {1: [], 2: [], 3: [], 4: [(0, 12, 1)], 5: [], None: [(0, 18, 2)], 6: [(0, 120_000, 3)], 7: [(0, 20, 1)]}
    assert got[6]["collapsed"] == "a b c" and got[5]["collapsed"] == " ".join("x" * 11) and got[1]["collapsed"] == ""
    assert periods.run_digest(periods.word_runs(periods.with_planted_runs(df))).count() == len(rows)
    assert periods.word_runs(df.limit(0)).count() == 0
