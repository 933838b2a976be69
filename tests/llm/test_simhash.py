import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2):
            x, y = find(i), find(int(j))
            if ids[x] <= ids[y]:
                root[y] = x
            else:
                root[x] = y
    return [ids[find(i)] for i in range(len(a))]


def test_documents(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in simhash.op1_simhash(spark, data).collect()}
    fps = [plain_fingerprint(r["text"] or "") for r in rows]
    assert [got[r["doc_id"]]["fingerprint"] for r in rows] == [f"{x:016x}" for x in fps]
    assert [got[r["doc_id"]]["component_id"] for r in rows] == plain_components(fps, [r["doc_id"] for r in rows])


@pytest.mark.parametrize("split", [4, 1024])
def test_links_at_any_split(spark, split):
    """Chains and dense clusters, with groups dealt once and twice more."""
    rng = random.Random(split)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(12 if rng.random() < 0.7 else 64)
    fps = sorted(fps)
    reps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    label = {r["node"]: r["component"] for r in components(simhash.links(reps, split)).collect()}
    assert [label.get(i, i) for i in range(len(fps))] == plain_components(fps, list(range(len(fps))))


def test_odd_rows(spark):
    text = "alpha beta gamma delta epsilon"
    rows = [(5, text), (3, text.upper()), (3, text), (7, None), (8, ""), (9, " \t\n"), (None, text), (10, "x"), (11, "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1)).withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[5] == by[3] == by[None] == 3 and by[7] == by[8] == by[9] == 7 and by[10] == 10
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (True, 3), (True, 7), (True, 10), (True, 11)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(chain.limit(0)).count() == 0


def test_passed_blocks_are_abandoned():
    rng = np.random.RandomState(2)
    members = rng.randint(0, 1 << 63, 1000, dtype=np.int64).astype(np.uint64)
    queries = np.append(rng.randint(0, 1 << 63, 126, dtype=np.int64).astype(np.uint64), [members[5] ^ np.uint64(3), members[9]])
    near = simhash.neighbours(queries, members)
    plain = np.array([[bin(int(q) ^ int(m)).count("1") <= 2 for m in members] for q in queries])
    assert (near == plain).all() and near[126, 5] and near[127, 9]
    vertical = simhash.planes(members)
    asked = np.where(np.unpackbits(queries.astype(">u8").view(np.uint8)).reshape(-1, 64), 255, 0).astype(np.uint8)
    n = len(queries) * 125
    lanes, read = simhash.count_within(lambda j, at: asked[at // 125, j] ^ vertical[j, at % 125], 64, n, 2)
    assert (np.unpackbits(lanes.reshape(-1, 125), axis=1).astype(bool) == plain).all() and read < 0.5 * 64 * n
