"""Alignment of two tokenizers against the libraries on whole texts and sets of ends."""

import glob
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.functions.storage import shared_dir
from quarry.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """For texts: per document (groups of ids, links), by the libraries on whole texts."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    symbols = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [b for b in range(256) if b not in symbols.values()]
    symbols |= {chr(256 + k): b for k, b in enumerate(rest)}

    def ends(sizes):
        return np.cumsum(sizes).tolist()

    def one(text):
        if not text:
            return []
        a = tokenizer.encode(" " + text, add_special_tokens=False)
        a_bytes = [bytes(symbols[c] for c in t) for t in a.tokens]
        b = model.encode(text)
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(model.id_to_piece, b), strict=True)]
        if not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
            return []
        a_ends, b_ends = ends(list(map(len, a_bytes))), ends(list(map(len, b_bytes)))
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            x, y = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append((a.ids[i:x], b[j:y]))
            i, j = x, y
        return groups

    return one


def digests(rows, plain):
    """The rows of the query for (doc_id, text)."""
    groups = [(k, plain(text)) for k, text in rows]
    count = Counter((a[-1], b[-1]) for _, gs in groups for a, b in gs)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for k, gs in groups:
        ns = [(count[a[-1], b[-1]], most[b[-1]]) for a, b in gs]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        sha = hashlib.sha256(shown.encode()).hexdigest() if gs else ""
        out.append((k, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(gs), sum(n == m for n, m in ns), sum(n for n, _ in ns), sha))
    return sorted(out, key=repr)


ODD = ["", " ", "  ", " a", "a ", "a  b   c", "\ta \n b\r\n", "x<|endoftext|>y </s> <s>", "日本語 テキスト", "a▁b", "naïve café ﬁ", "é 🙂🙂 \x00", "ab" * 3000, "　 \xa0x", "don't  stop, 1234567"]


def test_parts_are_exact(plain):
    rng = random.Random(3)
    letters = "ab  \n\té日🙂.,'1<|endoftext|>"
    items = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    for lane in (1, 7, 512):
        got = alignment.align(items, A, B, lane)
        shown = alignment.groups_of(got, alignment.byte_vocabulary(A), alignment.piece_vocabulary(B))
        assert shown == [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(x)) for x in items]
    assert alignment.spaces_cut(B)


def test_documents(spark, data, plain):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = alignment.op12_token_alignment(spark, data)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == digests(rows, plain)


def test_odd_rows(spark, plain):
    rows = list(enumerate(ODD)) + [(50, None), (None, "no id here"), (51, "twice the same"), (51, "twice the same"), (52, "word and other words " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("pairs", F.lit(1))
    for most_sent in (alignment.SENT, 10):
        got = alignment.link_digest(df.repartition(5), A, B, most_sent)
        assert sorted(map(tuple, got.collect()), key=repr) == digests(rows, plain)
    assert alignment.link_digest(df.limit(0), A, B).count() == 0
    shown = {r["doc_id"]: r for r in alignment.token_groups(df, A, B).collect()}
    assert shown[3]["groups"] and shown[3]["ends"][-1] == 3 and shown[0]["ends"] == [] and shown[9]["groups"] == ""


def test_blocks_stay_small(spark, plain):
    """One task over short and long texts: blocks, and what is written and read of them at once, don't grow with what it has."""
    short, long, huge = "a few words", "word and other words " * 1000, "one text of some words " * 30_000
    many = {short: 3000, long: 800, huge: 1}
    rows = list(enumerate(x for x, n in many.items() for _ in range(n)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    there = set(glob.glob(f"{shared_dir(spark)}/alignment-*"))
    got = alignment.link_digest(df, A, B).collect()
    (folder,) = set(glob.glob(f"{shared_dir(spark)}/alignment-*")) - there
    files = [pq.ParquetFile(x) for x in glob.glob(f"{folder}/*.parquet")]
    assert max(f.metadata.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)) < 6 << 20
    held = [x for f in files for x in f.read(["doc_ids", "codes"]).to_pylist()]
    assert all(len(x["codes"]) <= 1 << 20 or len(x["doc_ids"]) == 1 for x in held)

    groups = {x: plain(x) for x in (short, long)}
    count = Counter()
    for x, gs in groups.items():
        count.update({k: n * many[x] for k, n in Counter((a[-1], b[-1]) for a, b in gs).items()})
    ids = alignment.align([huge], A, B)
    count.update(zip(ids.a[ids.link_a].tolist(), ids.b[ids.link_b].tolist(), strict=True))
    assert [r["doc_id"] for r in sorted(got)] == [k for k, _ in rows]
    for r in got:
        if rows[r["doc_id"]][1] != huge:
            gs = groups[rows[r["doc_id"]][1]]
            assert (r["n_links"], r["count_sum"]) == (len(gs), sum(count[a[-1], b[-1]] for a, b in gs))
    assert sum(r["count_sum"] for r in got) == sum(n * n for n in count.values())


def test_codes_and_slices():
    for n, kind in ((1, "<u2"), (1 << 16, "<u2"), ((1 << 16) + 1, "<u4")):
        assert alignment.code_type(n) == kind and int(np.array(n - 1).astype(kind)) == n - 1
    texts = ["", "abc", "é" * 4, "", "x" * 30, "y", "", "z" * 9, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    cut = [part.column(1).to_pylist() for part in alignment.slices(batch.slice(1), 10)]
    assert cut == [["abc"], ["é" * 4, ""], ["x" * 30], ["y", "", "z" * 9], ["z"]]
    assert list(alignment.slices(batch.slice(0, 0), 10)) == []
