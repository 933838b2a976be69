"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how often ids are linked in a corpus.

Both encode a space and the text: a byte-level BPE (A) of its own, a sentencepiece BPE (B) by the space that it adds. Offsets are bytes, ascending
over all documents of a block, so that one NumPy state vector holds the A and B pointers of all of them: each step compares the two ends of
every lane, emits a link, and a cut of groups, where they are equal, and moves on whichever ends first, or both; finished lanes are compacted away.
A document is one lane, a long one a lane for each LANE bytes, whose pointers begin at the first ends beyond, so that no document makes the rest wait.

Texts are encoded by libraries: A whole, by tiktoken with the merges of the tokenizers file, B part by part, cut at spaces that follow another
character, which is exact where no piece holds a space after another character; that is read off the vocabulary, and texts are encoded whole if one does.

What is linked how often is counted over the corpus: each block, BLOCK_BYTES of a task's rows, is one row with its links as codes of its own
distinct pairs; only those pairs, with how often each stands in the block, are summed. The counts of up to SENT pairs of ids, a checked number that
the vocabularies bound, are sent to the blocks; more go back to them by a join, in which a hot pair is one row for each block. Blocks are small and
stand in row groups of ROWS, so that neither writing nor reading them holds more than a few in memory, whatever the size of a task's input.

Null and empty texts, and texts that either tokenizer doesn't give back byte for byte (one that holds U+2581), have no tokens: counts of zero and
the empty string for the hash. Repeated rows count as often as they stand; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bpe
from .common import arrow_map, checkpoint, shared_path, table, texts
from .records import library_ids
from .tokens import BYTE_BPE, Run, cache, ids_of, joined, strings

PIECE_BPE = "piece_bpe_32k.model"
LANE, BLOCK_BYTES, PARTS = 512, 1 << 19, 24_000
#: Blocks are written in row groups of so many rows and, looked at after each row, so many bytes as compressed; pairs are summed by so many.
ROWS, ROW_GROUP, PAIRS = 8, 4 << 20, 1 << 18
STORED = {
    "parquet.block.row.count.limit": ROWS,
    "parquet.block.size": ROW_GROUP,
    "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 1,
    "parquet.enable.dictionary": "false",
}
#: As many pairs of ids travel to tasks, 16 bytes each.
SENT = 1 << 21
#: Characters of a word beyond which tiktoken isn't asked.
LONGEST = 2000
#: After the ids of a part that sentencepiece doesn't give back byte for byte.
BAD = (1 << 32) - 1
SPACE = re.compile("(?<! ) ")
DIGEST = ("doc_ids", "n_a", "n_b", "n_groups", "sha")
#: A block is 18 bits in a task, a place in its pairs 26.
BLOCKS, PLACES = 18, 26


class Vocabulary(NamedTuple):
    """Token bytes by id, and their lengths."""

    tokens: list[bytes]
    sizes: np.ndarray


def vocabulary(tokens: list[bytes]) -> Vocabulary:
    return Vocabulary(tokens, np.array(list(map(len, tokens)), np.int64))


@functools.lru_cache(2)
def byte_vocabulary(path: str) -> Vocabulary:
    return vocabulary(bpe.json_ranks(path).tokens)


@functools.lru_cache(2)
def all_bytes(path: str) -> bool:
    """Whether each byte is a token, so that no text is lost on a byte-level BPE."""
    return len({t for t in byte_vocabulary(path).tokens if len(t) == 1}) == 256


@functools.lru_cache(2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(2)
def piece_vocabulary(path: str) -> Vocabulary:
    model = processor(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return vocabulary([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


@functools.lru_cache(2)
def spaces_cut(path: str) -> bool:
    """Whether no piece holds a space after another character, so that merges never reach over the beginning of a run of spaces."""
    return not any(re.search(b"[^ ] ", t) for t in piece_vocabulary(path).tokens)


def piece_parts(text: str, cuts: bool) -> list[str]:
    """Parts of a space and a text, each without the space that it begins with."""
    if not cuts:
        return [text]
    if "  " in text or text[:1] == " ":
        return SPACE.split(" " + text)[1:]
    return text.split(" ")


def piece_maker(path: str) -> Callable[[list], list]:
    """For parts of texts: the ids of a space and the part, as 32-bit integers, and BAD after them if they aren't its bytes."""
    model, tokens = processor(path), piece_vocabulary(path).tokens
    alone = [model.piece_to_id("▁")]

    def make(parts: list[str]) -> list[bytes]:
        found = [ids if part else alone for part, ids in zip(parts, model.encode(parts, num_threads=1), strict=True)]
        same = [b"".join(map(tokens.__getitem__, ids)) == b" " + part.encode() for part, ids in zip(parts, found, strict=True)]
        return [array("I", ids if good else [*ids, BAD]).tobytes() for ids, good in zip(found, same, strict=True)]

    return make


@functools.lru_cache(2)
def byte_encoding(path: str):
    """The byte-level BPE of a tokenizers file as a tiktoken encoding: its ids ascend with its merges, so they are ranks as well; None where they don't."""
    import tiktoken

    ranks = bpe.json_ranks(path)
    made = [made for _, made in sorted(ranks.pairs.values())]
    if made != sorted(set(made)) or not all_bytes(path):
        return None
    known = {*made, *ranks.byte_ids.tolist()}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for t, i in ranks.ids.items() if i in known}, special_tokens={})


def is_broken_up(text: str) -> bool:
    """Whether no word and no white space of a text is longer than LONGEST: tiktoken's time grows with the square of those."""
    if len(text) <= LONGEST:
        return True
    sizes = list(map(len, text.split()))
    return max(sizes, default=0) <= LONGEST and len(text) - sum(sizes) - len(sizes) <= LONGEST


def byte_ids(path: str, items: list[str]) -> list[np.ndarray]:
    """Ids of a space and each text; special strings are plain text. Texts with very long words go to the tokenizers library."""
    encoding = byte_encoding(path)
    quick = [encoding is not None and is_broken_up(x) for x in items]
    out = [encoding.encode_to_numpy(" " + x, disallowed_special=()) if q else np.zeros(0, np.uint32) for x, q in zip(items, quick, strict=True)]
    slow = [i for i, q in enumerate(quick) if not q]
    for i, ids in zip(slow, ids_of(cache(("library", path), library_ids(path), PARTS), [" " + items[i] for i in slow]) if slow else [], strict=True):
        out[i] = ids
    return out


def piece_ids(path: str, items: list[str]) -> list[np.ndarray]:
    """Ids of each text by the sentencepiece library, which puts a space before it; BAD after parts that it doesn't give back."""
    known, cuts, out = cache(("pieces", path), piece_maker(path), PARTS), spaces_cut(path), [np.zeros(0, np.uint32)] * len(items)
    plain = [i for i, x in enumerate(items) if cuts and "  " not in x and x[:1] != " "]
    if plain:
        parts = pc.split_pattern(pa.array([items[i] for i in plain], pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        values = known.values_of_distinct(strings(coded.dictionary))
        run = Run(plain, values, coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy().astype(np.int64))
        for i, ids in joined(run):
            out[i] = ids
    for i in set(range(len(items))).difference(plain):
        out[i] = np.frombuffer(b"".join(known.values_of(piece_parts(items[i], cuts))), "<u4")
    return out


def given_back(known: Vocabulary, ids: np.ndarray, raw: bytes) -> np.ndarray | None:
    """The ids without marks if their bytes are these, else None."""
    ids = ids[ids != BAD]
    return ids if b"".join(map(known.tokens.__getitem__, ids.tolist())) == raw else None


class Aligned(NamedTuple):
    """The tokens of a block of documents by two tokenizers, where each document's begin, and the places of links, in order."""

    a: np.ndarray
    b: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def lanes(ends: np.ndarray, bounds: np.ndarray, cuts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first token of each lane and the one after its last: lanes begin after the byte `cuts`, in the document `owner`."""
    first = np.searchsorted(ends, cuts, "right")
    last = np.append(first[1:], len(ends))
    return np.maximum(first, bounds[owner]), np.minimum(last, bounds[owner + 1])


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of tokens that end together. Ends ascend over all documents, each of which ends alike in a and b."""
    held = np.flatnonzero(np.diff(a_bounds))
    begin = np.append(0, a_ends)[a_bounds[held]]
    many = -(-(a_ends[a_bounds[held + 1] - 1] - begin) // lane)
    owner = np.repeat(held, many)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    cuts = np.repeat(begin, many) + lane * inside
    (i, i_end), (j, j_end) = lanes(a_ends, a_bounds, cuts, owner), lanes(b_ends, b_bounds, cuts, owner)
    found = []
    while True:
        alive = (i < i_end) & (j < j_end)
        if not alive.all():
            i, i_end, j, j_end = i[alive], i_end[alive], j[alive], j_end[alive]
        if not len(i):
            break
        x, y = a_ends[i], b_ends[j]
        met = x == y
        found.append((i[met], j[met]))
        i, j = i + (x <= y), j + (y <= x)
    link_a, link_b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return np.sort(link_a), np.sort(link_b)


def align(items: list[str], a_path: str, b_path: str, lane: int = LANE) -> Aligned:
    """Both tokenizers' tokens of texts, aligned. Texts that are empty or not given back by a tokenizer have none."""
    a_known, b_known = byte_vocabulary(a_path), piece_vocabulary(b_path)
    none, a_ids, b_ids = np.zeros(0, np.uint32), byte_ids(a_path, items), piece_ids(b_path, items)
    for i, (x, a, b) in enumerate(zip(items, a_ids, b_ids, strict=True)):
        if not all_bytes(a_path):
            a = given_back(a_known, a, b" " + x.encode())
        if (b == BAD).any():
            b = given_back(b_known, b, b" " + x.encode())
        a_ids[i], b_ids[i] = (a, b) if x and a is not None and b is not None else (none, none)
    a, b = (np.concatenate([none, *x]).astype(np.int64) for x in (a_ids, b_ids))
    a_bounds, b_bounds = (np.append(0, np.cumsum(list(map(len, x)), dtype=np.int64)) for x in (a_ids, b_ids))
    return Aligned(a, b, a_bounds, b_bounds, *lockstep(np.cumsum(a_known.sizes[a]), np.cumsum(b_known.sizes[b]), a_bounds, b_bounds, lane))


@functools.lru_cache(2)
def shown_ids(n: int, m: int) -> list[str]:
    """Ids of A inside and at the end of a group, then those of B, as text."""
    return [f"{i}{mark}" for size, marks in ((n, ",|"), (m, ",;")) for mark in marks for i in range(size)]


def groups_of(got: Aligned, a_known: Vocabulary, b_known: Vocabulary) -> list[str]:
    """For each document its groups in order, as `a1,a2|b1;a3|b2,b3` in ids."""
    n, m, shown = len(a_known.sizes), len(b_known.sizes), shown_ids(len(a_known.sizes), len(b_known.sizes))
    group = np.searchsorted(got.link_b, np.arange(len(got.b)))
    codes = np.empty(len(got.a) + len(got.b), np.int64)
    a_ends, b_ends = np.zeros(len(got.a), np.int64), np.zeros(len(got.b), np.int64)
    a_ends[got.link_a] = b_ends[got.link_b] = 1
    before = np.append(0, got.link_b + 1)[np.searchsorted(got.link_a, np.arange(len(got.a)))]
    codes[np.arange(len(got.a)) + before] = got.a + n * a_ends
    codes[np.arange(len(got.b)) + got.link_a[group] + 1] = 2 * n + got.b + m * b_ends
    cuts = (got.a_bounds + got.b_bounds).tolist()
    return ["".join(map(shown.__getitem__, codes[x:y].tolist()))[:-1] for x, y in zip(cuts, cuts[1:], strict=False)]


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows (doc_id, groups, ends): the groups of each text in ids, and the byte of a space and the text that each group ends before."""

    def make():
        a_known, b_known = byte_vocabulary(a_path), piece_vocabulary(b_path)

        def step(batch: dict) -> dict:
            got = align(batch["text"], a_path, b_path)
            ends = np.append(0, np.cumsum(a_known.sizes[got.a]))
            cuts = np.searchsorted(got.link_a, got.a_bounds).tolist()
            base = ends[got.a_bounds].tolist()
            own = [(ends[got.link_a[x:y] + 1] - at).tolist() for x, y, at in zip(cuts, cuts[1:], base, strict=False)]
            return {"doc_id": batch["doc_id"], "groups": groups_of(got, a_known, b_known), "ends": own}

        return step

    return arrow_map(texts(docs), make, "doc_id long, groups string, ends array<long>")


LONGS = T.ArrayType(T.LongType())
FIELDS = [("block", T.LongType()), *((x, LONGS) for x in DIGEST[:-1]), ("sha", T.ArrayType(T.StringType())), *((x, T.BinaryType()) for x in ("codes", "pairs", "times"))]
BLOCK = T.StructType([T.StructField(*f) for f in FIELDS])


def code_type(n: int) -> str:
    """The type of codes of n pairs."""
    return "<u2" if n <= 1 << 16 else "<u4"


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of up to `most` bytes of text, or of one row."""
    ends, at = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)), 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each BLOCK_BYTES of a task's texts: numbers and hashes by document, the links of all as codes, the pair of ids of each code and how often it is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, a_known, b_known = to_arrow_schema(BLOCK), byte_vocabulary(a_path), piece_vocabulary(b_path)
        first = TaskContext.get().partitionId() << BLOCKS
        parts = (part for batch in batches for part in slices(batch, BLOCK_BYTES))
        for block, part in enumerate(parts, first):
            got = align(part.column(1).to_pylist(), a_path, b_path)
            sha = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups_of(got, a_known, b_known)]
            numbers = [np.diff(got.a_bounds), np.diff(got.b_bounds), np.diff(np.searchsorted(got.link_a, got.a_bounds))]
            pairs, codes, times = np.unique(got.a[got.link_a] << 32 | got.b[got.link_b], return_inverse=True, return_counts=True)
            made = [block, part.column(0), *numbers, sha, codes.astype(code_type(len(pairs))).tobytes(), pairs.astype("<i8").tobytes(), times.astype("<u4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, out, strict=True)], schema=out)

    return texts(docs).mapInArrow(run, BLOCK)


def block_sums(held: DataFrame) -> DataFrame:
    """Rows (pair, times): the pairs of blocks and how often each stands in some of a task's."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, place, np.concatenate([n for _, n in parts]).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], names=["pair", "times"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, many = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                parts.append((np.frombuffer(batch.column(0)[k].as_py(), "<i8"), np.frombuffer(batch.column(1)[k].as_py(), "<u4")))
                many += len(parts[-1][0])
                if many >= PAIRS:
                    yield summed(parts)
                    parts, many = [], 0
        if many:
            yield summed(parts)

    return held.select("pairs", "times").mapInArrow(run, "pair long, times long")


def pair_counts(held: DataFrame) -> DataFrame:
    """Rows (pair, told): for each pair of ids twice the links of the corpus that it is, and one more if no pair of its b id is more."""
    total = block_sums(held).groupBy("pair").agg(F.sum("times").alias("n"))
    # a b id has as many pairs as there are a ids, at most
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return total.select("pair", (2 * F.col("n") + (F.col("n") == most).cast("int")).alias("told"))


def told_by_block(held: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (block, told): the counts of each block's pairs, in order, by a join."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pairs = np.frombuffer(raw.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array((block << PLACES) + np.arange(len(pairs))), pa.array(pairs)], names=["ref", "pair"])

    each = held.select("block", "pairs").mapInArrow(run, "ref long, pair long").join(counts, "pair")
    told = F.sort_array(F.collect_list(F.struct("ref", "told")))
    return each.groupBy(F.shiftrightunsigned("ref", PLACES).alias("block")).agg(told.alias("x")).select("block", F.col("x.told").alias("told"))


def link_digest(docs: DataFrame, a_path: str, b_path: str, most_sent: int = SENT) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256). See the module; tokens aren't empty, so each group ends in one link.

    A link's count is how many links of the corpus have its two ids. n_best: links whose count is the highest of their b id. Up to most_sent
    pairs of ids are sent to the blocks; more go to them by a join.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "alignment")
    blocks(docs, a_path, b_path).write.options(**STORED).parquet(folder)
    held = spark.read.schema(BLOCK).parquet(folder)
    counts = checkpoint(pair_counts(held))
    if counts.count() <= most_sent:
        table_ = counts.orderBy("pair").toArrow()
        sent = spark.sparkContext.broadcast(tuple(table_.column(c).to_numpy() for c in ("pair", "told")))
        rows = held.select(*DIGEST, "codes", "pairs")
    else:
        sent = None
        rows = held.join(told_by_block(held, counts), "block", "left").select(*DIGEST, "codes", "told")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([*(T.StructField(x, T.LongType()) for x in names), T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, n_a, n_b, links, sha, codes, last = (batch.column(i)[k] for i in range(7))
                codes = codes.as_py()
                sums = [np.zeros(1, np.int64)] * 2
                if codes:
                    if sent is not None:
                        pairs, counted = sent.value
                        told = counted[np.searchsorted(pairs, np.frombuffer(last.as_py(), "<i8"))]
                    else:
                        told = last.values.to_numpy()
                    codes = np.frombuffer(codes, code_type(len(told)))
                    sums = [np.zeros(len(codes) + 1, np.int64) for _ in range(2)]
                    np.cumsum((told & 1)[codes], out=sums[0][1:])
                    np.cumsum((told >> 1)[codes], out=sums[1][1:])
                cuts = np.append(0, np.cumsum(links.values.to_numpy()))
                made = [doc_ids.values, n_a.values, n_b.values, links.values, links.values, *(np.diff(x[cuts]) for x in sums), sha.values]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, out, strict=True)], schema=out)

    return rows.mapInArrow(run, schema)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))
