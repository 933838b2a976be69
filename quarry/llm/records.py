"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard is a run of frames in ascending doc_id order. A frame is: length of the data (unsigned 64-bit little-endian), masked
CRC-32C of those eight bytes, the data, masked CRC-32C of the data. The data are doc_id (signed 64-bit), bytes an id takes
(one byte: 2 or 4; 128 more for a null doc_id) and the ids. The index, a Parquet table beside the shards, has a row for each record: doc_id, shard,
file, offset, length, n_tokens, and how many ids the shard holds before it.

Each task writes a file under a name of its own; only files that the committed index names count. So a task that is run
again, or twice, leaves at most a file that nothing names.
"""

from __future__ import annotations

import functools
import struct
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from .bpe import byte_symbols
from .common import SLICE_BYTES, arrow_map, shared_path, table, texts
from .tokens import BYTE_BPE, cache, ids_of, pieces_joined, specials

POLY, MASK_DELTA, BLOCK = 0x82F63B78, 0xA282EAD8, 512
HEAD = "<QI"
DATA = "<qB"
NO_ID = 128
INDEX = T.StructType([T.StructField(n, k()) for n, k in (("doc_id", T.LongType), ("shard", T.IntegerType), ("file", T.StringType), ("offset", T.LongType), ("length", T.LongType), ("n_tokens", T.LongType), ("before", T.LongType))])


@functools.lru_cache(1)
def crc_tables() -> tuple[np.ndarray, list[list[int]]]:
    """Tables of CRC-32C: for eight bytes at a time, and for a state moved past BLOCK zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(POLY), one >> 1)
    slices = [one]
    for _ in range(7):
        slices.append(slices[-1] >> 8 ^ one[slices[-1] & 255])
    move = []
    for byte in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        for _ in range(BLOCK):
            state = state >> 8 ^ one[state & 255]
        move.append(state.tolist())
    return np.stack(slices), move


def crc32c(items: list[bytes]) -> list[int]:
    """CRC-32C of each byte string: all blocks of all strings at once, then the blocks of each string joined.

    The first four bytes are inverted instead of starting from ones; zeros before them change nothing, so blocks are filled up in front.
    """
    slices, move = crc_tables()
    padded, counts = [], []
    for x in items:
        x = x if len(x) >= 4 else None
        if x is None:
            counts.append(0)
            continue
        x = bytes(b ^ 255 for b in x[:4]) + x[4:]
        n = -(-len(x) // BLOCK)
        padded.append(x.rjust(n * BLOCK, b"\0"))
        counts.append(n)
    blocks = np.frombuffer(b"".join(padded), "<u4").reshape(-1, BLOCK // 8, 2)
    state = np.zeros(len(blocks), np.uint32)
    for k in range(BLOCK // 8):
        low, high = blocks[:, k, 0] ^ state, blocks[:, k, 1]
        state = slices[7][low & 255] ^ slices[6][low >> 8 & 255] ^ slices[5][low >> 16 & 255] ^ slices[4][low >> 24]
        state ^= slices[3][high & 255] ^ slices[2][high >> 8 & 255] ^ slices[1][high >> 16 & 255] ^ slices[0][high >> 24]
    states, at, out = state.tolist(), 0, []
    a, b, c, d = move
    for x, n in zip(items, counts, strict=True):
        if n:
            s = states[at]
            for other in states[at + 1 : at + n]:
                s = a[s & 255] ^ b[s >> 8 & 255] ^ c[s >> 16 & 255] ^ d[s >> 24] ^ other
            at += n
            out.append(s ^ 0xFFFFFFFF)
        else:
            s, one = 0xFFFFFFFF, slices[0]
            for byte in x:
                s = s >> 8 ^ int(one[(s ^ byte) & 255])
            out.append(s ^ 0xFFFFFFFF)
    return out


def masked(crc: int) -> int:
    """The rotated checksum that frames carry, so that checksums of data that hold checksums stay sound."""
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frames(items: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(x)) for x in items]
    return [n + struct.pack("<I", masked(a)) + x + struct.pack("<I", masked(b)) for n, a, x, b in zip(lengths, crc32c(lengths), items, crc32c(items), strict=True)]


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system that Spark finds it in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def open_shared(uri: str, mode: str):
    """A file of a qualified path in the shared folder: file: as a local file, other stores through Arrow."""
    if uri.startswith("file:"):
        return open("/" + uri[5:].lstrip("/"), mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path) if mode == "rb" else store.open_output_stream(path)


def write_records(rows: DataFrame, path: str, encoder: Callable[[], Callable[[list], list[np.ndarray]]]) -> DataFrame:
    """Writes rows (doc_id, value), ranged and sorted by doc_id, as shards under path; gives the index, lazily.

    encoder() runs once a task and gives the function that turns values into arrays of ids.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, encode = to_arrow_schema(INDEX), TaskContext.get().partitionId(), encoder()
        name, file, offset, before = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex}.rec", None, 0, 0
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                doc_ids, found = part.column(0).to_pylist(), encode(part.column(1).to_pylist())
                data = []
                for doc_id, ids in zip(doc_ids, found, strict=True):
                    width = 2 if not ids.size or ids.max() < 1 << 16 else 4
                    data.append(struct.pack(DATA, doc_id or 0, width | NO_ID * (doc_id is None)) + ids.astype(f"<u{width}").tobytes())
                file = file or open_shared(name, "wb")
                made, index = frames(data), []
                for doc_id, ids, x in zip(doc_ids, found, made, strict=True):
                    index.append((doc_id, shard, name, offset, len(x), len(ids), before))
                    offset += len(x)
                    before += len(ids)
                file.write(b"".join(made))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), out, strict=True)], schema=out)
        if file:
            file.close()

    return rows.mapInArrow(run, INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """Rows (doc_id, shard, before, n_tokens, ids) of the records that an index, or any selection of its rows, names; checksums are verified."""

    def make():
        opened = ["", None]

        def step(batch: dict) -> dict:
            raw = []
            for name, offset, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
                if opened[0] != name:
                    if opened[1]:
                        opened[1].close()
                    opened[:] = [name, open_shared(name, "rb")]
                opened[1].seek(offset)
                raw.append(opened[1].read(length))
            data = [x[12:-4] for x in raw]
            for x, a, b in zip(raw, crc32c([x[:8] for x in raw]), crc32c(data), strict=True):
                if struct.unpack_from(HEAD, x) != (len(x) - 16, masked(a)) or struct.unpack("<I", x[-4:])[0] != masked(b):
                    raise ValueError("a record's length or checksum is wrong")
            head = [struct.unpack_from(DATA, x) for x in data]
            ids = [np.frombuffer(x, f"<u{width & ~NO_ID}", offset=struct.calcsize(DATA)).astype("<u4").tobytes() for x, (_, width) in zip(data, head, strict=True)]
            return {"doc_id": [None if width & NO_ID else x for x, width in head], "shard": batch["shard"], "before": batch["before"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

        return step

    return arrow_map(index, make, "doc_id long, shard int, before long, n_tokens long, ids binary")


def library_ids(path: str) -> Callable[[list], list]:
    """For cache keys: the ids that the tokenizers library's model gives their pre-tokens, as 32-bit integers.

    The library's own pre-tokens are these, in its byte symbols; its model is asked for each once.
    """
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_file(path).model.tokenize
    symbols = {b: c for c, b in byte_symbols().items()}
    space = symbols[32]

    def make(shown: list[str]) -> list[bytes]:
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in shown]

    def pieces(missing: list) -> list:
        return make([w.encode().decode("latin-1").translate(symbols) for w in missing])

    def letters(missing: list) -> list:
        return make([space + (w if w.isascii() else w.encode().decode("latin-1").translate(symbols)) for w in missing])

    return pieces_joined(pieces, letters, specials(path))


def text_encoder(path: str, end_id: int) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """Makes the function that encodes texts as the tokenizers library does, with end_id after each.

    A text is cut at special strings and at single spaces, neither of which changes what the library gives.
    """

    def make():
        known, marks = cache(("library", path), library_ids(path)), tuple(specials(path))
        return lambda items: [np.append(x, np.uint32(end_id)) for x in ids_of(known, items, marks)]

    return make


def token_file_digest(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the tokens of docs, reads the files back, and gives (doc_id, start, n_tokens, ids_crc32, shard).

    start counts the ids of all documents before. An empty or null text is the end id alone; rows that share a doc_id follow each other,
    ordered by text; rows with a null doc_id come first.
    """
    spark = docs.sparkSession
    folder = qualified(spark, shared_path(spark, "token-records"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    ranged = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write_records(ranged, folder, text_encoder(path, end_id)).write.parquet(f"{folder}/index")
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    ends = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(ends), F.lit(0)).alias("base"))
    digest = read_records(index).select("doc_id", "shard", "before", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return digest.join(bases, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
