"""Token counts with a whole-token shortcut, and byte-level BPE encoding and decoding.

Both split texts at single spaces first (an exact cut, see bpe.chunks) and look parts up in a bounded cache, so that the
costly pattern and the merges run only on parts not met lately. Work is per row: no shuffle, whole texts, bounded memory.

Null and empty texts have no tokens; repeated rows give repeated rows; an empty table gives no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import TwoGenerations, arrow_map, table, texts

BYTE_BPE = "byte_bpe_50k.json"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"
GROUP_CHARS, CHUNKS, PIECES = 4 << 20, 250_000, 60_000
#: Signs that a word of letters often ends with, each a pre-token of its own where white space or the text's end follows.
STOPS = frozenset(".,;:!?")


def keys(part: str) -> list:
    """Cache keys of a text: its first chunk as a 1-tuple, the others, which follow a space, as strings."""
    cut = bpe.chunks(part)
    cut[0] = (cut[0],)
    return cut


@functools.lru_cache(4)
def specials(path: str) -> dict[str, int]:
    """The special tokens of a tokenizers file: their strings, inside a text too, stand for their ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def text_keys(text: str, marks: Iterable[str] = ()) -> list:
    """Cache keys of a text; a special string in it has the key (string, True), and parts a text as a whole."""
    if not any(m in text for m in marks):
        return keys(text)
    out = []
    for i, part in enumerate(re.split(f"({'|'.join(map(re.escape, sorted(marks, key=len, reverse=True)))})", text)):
        out += keys(part) if i % 2 == 0 else [(part, True)]
    return out


def words(key) -> list[str]:
    """The pre-tokens of a cache key; none for a special string."""
    if isinstance(key, tuple):
        return bpe.SPLIT.findall(key[0]) if len(key) == 1 else []
    return [" " + key] if key.isalpha() else bpe.SPLIT.findall(" " + key)


class Run(NamedTuple):
    """A run of texts looked up together: which texts, the values of their distinct keys, each key's value by number, and where each text's keys begin."""

    places: list[int]
    values: list
    codes: np.ndarray
    bounds: np.ndarray


def runs(known: TwoGenerations, items: list[str], marks: Iterable[str] = ()) -> Iterator[Run]:
    """The texts in runs of about GROUP_CHARS characters, so that memory doesn't follow the size of an Arrow batch.

    Texts that single spaces cut are split and their parts numbered by Arrow, so that each distinct part is looked up once a run;
    the others (special strings, or other white space at a cut) are cut one by one.
    """
    for places in groups(items):
        plain = [i for i in places if not (bpe.odd(items[i]) or any(m in items[i] for m in marks))]
        if plain:
            parts = pc.split_pattern(pa.array([items[i] for i in plain], pa.large_string()), " ")
            coded, bounds = parts.flatten().dictionary_encode(), parts.offsets.to_numpy().astype(np.int64)
            codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            first = codes[bounds[:-1]]
            codes[bounds[:-1]] = len(distinct) + np.arange(len(plain))
            used = np.flatnonzero(np.bincount(codes, minlength=len(distinct))[: len(distinct)])
            named = strings(distinct.take(pa.array(used))) + [(x,) for x in strings(distinct.take(pa.array(first)))]
            number = np.zeros(len(distinct) + len(plain), np.int64)
            number[used] = np.arange(len(used))
            number[len(distinct) :] = len(used) + np.arange(len(plain))
            yield Run(plain, known.values_of_distinct(named), number[codes], bounds)
        rest = sorted(set(places).difference(plain))
        if rest:
            seen: dict = {}
            codes, bounds = [], [0]
            for i in rest:
                codes += [seen.setdefault(k, len(seen)) for k in text_keys(items[i], marks)]
                bounds.append(len(codes))
            yield Run(rest, known.values_of_distinct(list(seen)), np.array(codes, np.int64), np.array(bounds, np.int64))


def strings(values: pa.Array) -> list[str]:
    """An Arrow array of strings as a list, all at once."""
    return values.to_numpy(zero_copy_only=False).tolist()


def groups(items: list[str]) -> Iterator[list[int]]:
    """Places of texts in runs of about GROUP_CHARS characters."""
    run, size = [], 0
    for i, x in enumerate(items):
        run.append(i)
        size += len(x)
        if size >= GROUP_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def sums_of(known: TwoGenerations, items: list[str], marks: Iterable[str] = ()) -> list[int]:
    """For each text the sum of its keys' values, which are numbers."""
    out = [0] * len(items)
    for run in runs(known, items, marks):
        upto = np.append(0, np.cumsum(np.array(run.values, np.int64)[run.codes]))[run.bounds]
        for i, n in zip(run.places, np.diff(upto).tolist(), strict=True):
            out[i] = n
    return out


def joined(run: Run) -> Iterator[tuple[int, np.ndarray]]:
    """Each text of a run, by place, with the ids of its keys' values."""
    flat = np.frombuffer(b"".join(run.values), "<u4")
    sizes = np.fromiter(map(len, run.values), np.int64, len(run.values)) >> 2
    starts = np.cumsum(sizes) - sizes
    many = sizes[run.codes]
    ends = np.cumsum(many)
    ids = flat[np.arange(many.sum()) + np.repeat(starts[run.codes] - ends + many, many)]
    cuts = np.append(0, ends)[run.bounds].tolist()
    for i, a, b in zip(run.places, cuts, cuts[1:], strict=False):
        yield i, ids[a:b]


def ids_of(known: TwoGenerations, items: list[str], marks: Iterable[str] = ()) -> list[np.ndarray]:
    """For each text the ids of its keys' values, which are ids as little-endian 32-bit integers."""
    out: list = [None] * len(items)
    for run in runs(known, items, marks):
        for i, ids in joined(run):
            out[i] = ids
    return out


def prove_whole_tokens(ranks: bpe.Ranks) -> frozenset[bytes]:
    """The vocabulary strings whose merges end in one token, themselves: made once, on the driver, from the vocabulary alone."""
    known = [t for t in ranks.tokens if t]
    return frozenset(t for t, ids in zip(known, bpe.encode_words(ranks, known), strict=True) if len(ids) == 1 and ids[0] == ranks.ids[t])


def count_maker(path: str, whole: frozenset[bytes]) -> Callable[[list], list]:
    """For cache keys: 1 for each pre-token that is a whole token, and for a special string; only the rest is merged."""

    def make_rest(missing: list) -> list:
        return list(map(len, bpe.encode_words(bpe.json_ranks(path), missing)))

    rest = TwoGenerations(make_rest, PIECES)

    def make(missing: list) -> list:
        sizes, merged, owner = [0] * len(missing), [], []
        for i, key in enumerate(missing):
            if isinstance(key, tuple) and len(key) == 2:
                sizes[i] = 1
            for word in words(key):
                raw = word.encode()
                if raw in whole:
                    sizes[i] += 1
                else:
                    merged.append(raw)
                    owner.append(i)
        for i, n in zip(owner, rest.values_of(merged), strict=True):
            sizes[i] += n
        return sizes

    return make


_caches: dict = {}


def cache(name: tuple, make: Callable[[list], list], limit: int = CHUNKS) -> TwoGenerations:
    """One cache for each worker process and purpose, kept between tasks."""
    if name not in _caches:
        _caches[name] = TwoGenerations(make, limit)
    return _caches[name]


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) for the byte-level BPE of a tokenizers file.

    A special token's string inside a text counts as that one token, as the library's default has it.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(bpe.json_ranks(path)))

    def make():
        known, marks = cache(("count", path), count_maker(path, whole.value)), tuple(specials(path))

        def step(batch: dict) -> dict:
            out = {"doc_id": batch["doc_id"], "n_bytes": [len(x.encode()) for x in batch["text"]]}
            out["n_tokens"] = sums_of(known, batch["text"], marks)
            return out | {"over_limit": [n > limit for n in out["n_tokens"]]}

        return step

    return arrow_map(texts(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def id_maker(path: str) -> Callable[[list], list]:
    """For cache keys: the ids of their pre-tokens as little-endian 32-bit integers. A pre-token that is a token stays whole."""

    def make_pieces(missing: list) -> list:
        ranks = bpe.tiktoken_ranks(path)
        raw = [x.encode() for x in missing]
        found = [ranks.ids.get(x) for x in raw]
        merged = iter(bpe.encode_words(ranks, [x for x, i in zip(raw, found, strict=True) if i is None]))
        return [next(merged).astype("<u4").tobytes() if i is None else i.to_bytes(4, "little") for i in found]

    return pieces_joined(make_pieces, lambda words: make_pieces([" " + w for w in words]))


def pieces_joined(make_pieces: Callable[[list], list], make_words: Callable[[list], list], special: dict[str, int] | None = None) -> Callable[[list], list]:
    """For cache keys: the joined ids of their pre-tokens; a special string's own.

    A word of letters is one pre-token and made at once; with a stop behind it, it is made of the word and the stop. What else there
    is comes from a bounded cache of pre-tokens.
    """
    pieces = TwoGenerations(make_pieces, PIECES)

    def make(missing: list) -> list:
        plain: dict[str, int] = {}
        which, rest = [], []
        for i, k in enumerate(missing):
            if type(k) is str and k.isalpha():
                which.append(plain.setdefault(k, len(plain)))
            elif type(k) is str and k[-1:] in STOPS and k[:-1].isalpha():
                which.append(plain.setdefault(k[:-1], len(plain)))
            else:
                which.append(-1)
                rest.append(i)
        ids = [*make_words(list(plain)), b""]
        out = [ids[n] + stop(k[-1]) if n >= 0 and k[-1] in STOPS else ids[n] for n, k in zip(which, missing, strict=True)]
        cut = [words(missing[i]) for i in rest]
        values, at = pieces.values_of([w for x in cut for w in x]), 0
        for i, x in zip(rest, cut, strict=True):
            k = missing[i]
            out[i] = special[k[0]].to_bytes(4, "little") if type(k) is tuple and len(k) == 2 else b"".join(values[at : at + len(x)])
            at += len(x)
        return out

    @functools.cache
    def stop(sign: str) -> bytes:
        return make_pieces([sign])[0]

    return make


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function that gives the ids of texts, as little-endian 32-bit integers."""
    known = cache(("ids", path), id_maker(path))
    return lambda items: [x.tobytes() for x in ids_of(known, items)]


def decoder(path: str) -> Callable[[bytes], tuple[int, str, bytes]]:
    """A function that gives, for ids, their number, the hash of their decimal forms joined by commas, and the bytes they stand for."""
    tokens = bpe.tiktoken_ranks(path).tokens
    names = [str(i) for i in range(len(tokens))]

    def run(raw: bytes) -> tuple[int, str, bytes]:
        ids = np.frombuffer(raw, "<u4").tolist()
        return len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), b"".join(map(tokens.__getitem__, ids))

    return run


def bpe_encode(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """Rows (doc_id, *keep, ids binary): the ids of whole texts as little-endian 32-bit integers, as a tiktoken encoding has them."""

    def make():
        encode = encoder(path)
        return lambda batch: {k: v for k, v in batch.items() if k != "text"} | {"ids": encode(batch["text"])}

    rows = texts(docs, *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return arrow_map(rows, make, f"{kept}, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds (n_tokens, ids_sha256, decoded binary) to rows that hold ids."""

    def make():
        decode = decoder(path)

        def step(batch: dict) -> dict:
            n, sha, decoded = zip(*map(decode, batch["ids"]), strict=True)
            return batch | {"n_tokens": n, "ids_sha256": sha, "decoded": decoded}

        return step

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return arrow_map(encoded, make, f"{kept}, n_tokens long, ids_sha256 string, decoded binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of texts encoded and decoded again, in one pass over the workers."""

    def make():
        encode, decode = encoder(path), decoder(path)

        def step(batch: dict) -> dict:
            out = [(n, sha, hashlib.sha256(raw).hexdigest()) for n, sha, raw in map(decode, encode(batch["text"]))]
            return {"doc_id": batch["doc_id"]} | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*out, strict=True), strict=True))

        return step

    return arrow_map(texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_BPE))
