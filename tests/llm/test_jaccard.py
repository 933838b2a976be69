"""Similar documents against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import jaccard


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """The rows of the query for (doc_id, text), doc_ids distinct."""
    sets = sorted((k, plain_set(t)) for k, t in rows)
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y), 1) and (both := len(x & y)) and 100 * both >= 80 * (len(x) + len(y) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((k, len(x), find(k)) for k, x in sets)


def test_documents(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = jaccard.op13_ngram_jaccard(spark, data)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


@pytest.mark.parametrize("frequent", [1, 3, 64])
def test_copies_at_any_share(spark, monkeypatch, frequent):
    """Edited copies near the limit, common passages and short texts, with shingles called frequent at several counts."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(frequent)
    word = lambda: f"w{rng.randrange(3000)}"
    passages, texts = [[word() for _ in range(30)] for _ in range(3)], []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([5, 8, 9, 12, 40, 90, 200]))]
        if rng.random() < 0.5:
            base += rng.choice(passages)
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy[rng.randrange(3) :]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.similar_components(df).collect())) == plain(rows)


def test_combinations_meet():
    """Sets that are similar enough share a combination, whatever the counts of their shingles are."""
    rng = np.random.RandomState(4)
    for _ in range(300):
        n = rng.randint(4, 60)
        tokens = np.unique(rng.randint(0, 1 << 60, n, dtype=np.int64))
        n = len(tokens)
        gone = rng.randint(0, n // 5 + 1)
        fresh = rng.randint(0, 1 << 60, rng.randint(0, n // 5 + 1), dtype=np.int64)
        other = np.unique(np.append(rng.permutation(tokens)[gone:], fresh))
        both = len(np.intersect1d(tokens, other))
        if 5 * both < 4 * (n + len(other) - both):
            continue
        most = rng.choice([2, 70, 255])
        count = {t: int(rng.choice([2, 64, 65, most])) for t in [*tokens, *other]}
        found = []
        for s in (tokens, other):
            own = np.array([count[t] if t in tokens and t in other else rng.choice([1, count[t]]) for t in s], np.uint8)
            count |= dict(zip(s, own.tolist(), strict=True))
            sig, _ = jaccard.combinations(np.array([len(s)]), s.astype(np.uint64), own, np.zeros(len(s), np.uint32))
            found.append(set(sig.tolist()))
        assert found[0] & found[1]


def test_levels():
    least = jaccard.levels(5000)
    level = np.searchsorted(least, np.arange(5000), "right")
    for n in range(4, 4000):
        assert level[n * 5 // 4] - level[n] <= 1


def test_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(5, text), (3, text.upper()), (3, text), (7, None), (8, ""), (9, " \t\n"), (None, text), (None, "alone"), (10, "x"), (12, "x"), (11, "word " * 50_000), (20, text + " more"), (21, "one thing"), (21, text + " other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(df).collect()), key=repr)
    want = [(3, 46, 3), (3, 46, 3), (5, 46, 3), (None, 46, 3), (None, 1, None), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (12, 1, 10), (11, 1, 11), (20, 47, 3), (21, 1, 3), (21, 47, 3)]
    assert got == sorted(want, key=repr)
    assert jaccard.similar_components(df.limit(0)).count() == 0
