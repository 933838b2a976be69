import hashlib
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, records, tokens

BPE = P.path(tokens.BYTE_BPE)
MULTI = P.path(tokens.MULTI_BPE)
SCHEMA = "doc_id long, text string, score double, ids string, n_tokens long"
ODD = ["", " ", "  a", "a  b", "a\n b", "a \nb", "tail ", "\t\tx", "it's we're I'M", "12 345²", "é中😀_ﬁ", "a\x1cb\x85c d", "<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>b<|endoftext|>", "x" * 3000, "ab " * 500, "!?!?" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def encoding():
    ranks = {w: i for i, w in enumerate(bpe.tiktoken_ranks(MULTI).tokens) if w}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0.5, "clash", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], None, None, None), (99, None, None, None, None), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts(docs, library):
    got = tokens.count_tokens(docs, BPE).collect()
    assert len(got) == docs.count()
    want = {(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()}
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)


def test_whole_tokens_are_proven(library):
    ranks = bpe.json_ranks(BPE)
    whole = tokens.prove_whole_tokens(ranks)
    some = sorted(whole)[::997]
    for t in some:
        try:
            text = t.decode()
        except UnicodeDecodeError:
            continue
        if bpe.SPLIT.findall(text) == [text]:
            assert library.encode(text, add_special_tokens=False).ids == [ranks.ids[t]]


def test_round_trip(docs, encoding):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in tokens.round_trip(docs, MULTI).collect()}
    want = set()
    for r in docs.collect():
        ids = encoding.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == want
    back = tokens.bpe_decode(tokens.bpe_encode(docs, MULTI), MULTI)
    assert {(r["doc_id"], bytes(r["decoded"]).decode()) for r in back.collect()} == {(r["doc_id"], r["text"] or "") for r in docs.collect()}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\tab1é.'s \x1c\x85😀中")), max_size=24))
def test_cut_texts_encode_alike(encoding, library, text):
    known = tokens.cache(("test", MULTI), tokens.id_maker(MULTI))
    many = [text, "plain words. said, again", text + "x"]
    assert [x.tolist() for x in tokens.ids_of(known, many)] == [encoding.encode_ordinary(x) for x in many]
    assert [x.tolist() for x in records.text_encoder(BPE, 2)()(many)] == [[*library.encode(x, add_special_tokens=False).ids, 2] for x in many]


@pytest.mark.parametrize("word", ["abcdefghij" * 4000, "a" * 700, "x" * 513, "ab" * 256, "".join("thequickéfox"[i * i % 11] for i in range(5000))])
def test_long_words(encoding, library, word):
    assert bpe.encode_words(bpe.tiktoken_ranks(MULTI), [word.encode()])[0].tolist() == encoding.encode_ordinary(word)
    if len(word) < 6000:
        assert bpe.encode_words(bpe.json_ranks(BPE), [word.encode()])[0].tolist() == library.encode(word, add_special_tokens=False).ids


def test_a_word_of_a_megabyte(spark):
    began = time.process_time()
    word = ("abcdefghi" * 3)[:26] * 40_000
    ids = bpe.merge_one(bpe.tiktoken_ranks(MULTI), word.encode())
    assert b"".join(bpe.tiktoken_ranks(MULTI).tokens[i] for i in ids.tolist()) == word.encode() and time.process_time() - began < 60


def test_records(docs, library):
    got = records.token_file_digest(docs, BPE).collect()
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    start, want = 0, []
    for known, doc_id, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want


def test_no_records(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert records.token_file_digest(empty, BPE).count() == tokens.count_tokens(empty, BPE).count() == tokens.round_trip(empty, MULTI).count() == 0


def test_checksums():
    assert records.crc32c([b"123456789", b"", b"abc"]) == [0xE3069283, 0, 0x364B3FB7]
    long = bytes(range(256)) * 9
    table, s = records.crc_tables()[0][0], 0xFFFFFFFF
    for b in long:
        s = s >> 8 ^ int(table[(s ^ b) & 255])
    assert records.crc32c([long]) == [s ^ 0xFFFFFFFF]
