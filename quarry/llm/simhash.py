"""SimHash near-duplicates: fingerprints, exact links within a radius, and components.

A link is found by blocks: of four 16-bit blocks, two fingerprints that differ in at most two bits share two, so each distinct
fingerprint goes to six groups by 32 equal bits. Within a group, bit planes stand vertically, one lane for each member; carry-save
counters add the planes of differences to all lanes at once, and a block of lanes is abandoned once all have passed the radius.

A group with more than SPLIT members is dealt again by blocks of its other bits: of three blocks two linked members share one at
least. After two such deals 49 bits or more are equal, so a group can hold 32,768 distinct fingerprints at most, whatever the input.
Copies share a fingerprint and count once. Groups give spanning links only, as many as members at most, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, checkpoint, table, texts
from .components import components

SEED, RADIUS, SHINGLE = 42, 2, 3
SPLIT = 1024
#: After so many planes, blocks of lanes that have passed are looked for.
STRIDE = 8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint, as a signed integer. Bytes are split at ASCII white space, A-Z lower-cased; no words: zero."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = np.array(hashes[k : k + 65_536], ">u8")
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fp long) of whole texts; null and empty texts have the fingerprint zero."""

    def make():
        return lambda batch: {"doc_id": batch["doc_id"], "fp": [fingerprint(x) for x in batch["text"]]}

    return arrow_map(texts(docs, as_bytes=True), make, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit values: 64 rows of bytes, a bit for each value."""
    return np.packbits(np.unpackbits(values.astype(">u8").view(np.uint8)).reshape(-1, 64).T, axis=1)


def count_within(plane: Callable, n_planes: int, n_blocks: int, radius: int) -> tuple[np.ndarray, int]:
    """Packed lanes in which at most `radius` of n_planes planes are set, n_blocks blocks of eight lanes; and how many blocks of planes were read.

    plane(j, at) gives plane j at the blocks `at`. Counters are bit-sliced, with carries saved upwards; a lane that has passed the radius
    stays marked. Every STRIDE planes the blocks whose lanes have all passed are abandoned, and only the others are read on; counting
    ends when none is left.
    """
    bits = max(1, (radius + 1).bit_length())
    start = (1 << bits) - radius - 1
    at = np.arange(n_blocks)
    counters = [np.full(n_blocks, 255 if start >> b & 1 else 0, np.uint8) for b in range(bits)]
    passed, out, read = np.zeros(n_blocks, np.uint8), np.full(n_blocks, 255, np.uint8), 0
    for j in range(n_planes):
        carry = plane(j, at)
        read += len(at)
        for b in range(bits):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        passed |= carry
        if j % STRIDE == STRIDE - 1:
            alive = np.flatnonzero(passed != 255)
            if len(alive) < 0.75 * len(at):
                at, passed, counters = at[alive], passed[alive], [c[alive] for c in counters]
                if not len(at):
                    break
    out[at] = passed
    return ~out, read


def neighbours(queries: np.ndarray, members: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each query, a row of booleans: which members lie within the radius. A block is one query against eight members."""
    vertical, width = planes(members), -(-len(members) // 8)
    asked = np.where(np.unpackbits(queries.astype(">u8").view(np.uint8)).reshape(-1, 64), 255, 0).astype(np.uint8)
    ends = np.packbits(np.ones(len(members), bool))
    base = np.where(np.unpackbits(members[:1].astype(">u8").view(np.uint8)), 255, 0).astype(np.uint8)
    differ = ((vertical ^ base[:, None]) & ends).any(1) | (asked != base).any(0)  # planes alike in all queries and members add nothing
    used = np.flatnonzero(differ)

    def plane(j: int, at: np.ndarray) -> np.ndarray:
        k = used[j]
        if len(at) == len(queries) * width:
            return (asked[:, k, None] ^ vertical[k] | ~ends).ravel()
        q, b = np.divmod(at, width)
        return asked[q, k] ^ vertical[k, b] | ~ends[b]

    lanes, _ = count_within(plane, len(used), len(queries) * width, radius)
    lanes = lanes.reshape(len(queries), width) & ends
    return np.unpackbits(lanes, axis=1)[:, : len(members)].astype(bool)


def aligned_within(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether left[i] and right[i] lie within the radius, for all i at once."""
    vertical = planes(left ^ right)
    lanes, _ = count_within(lambda j, at: vertical[j] if len(at) == vertical.shape[1] else vertical[j, at], 64, vertical.shape[1], radius)
    return np.unpackbits(lanes)[: len(left)].astype(bool)


def spanning(members: np.ndarray) -> list[tuple[int, int]]:
    """Links (places) that join what lies within the radius in one group: a breadth-first forest, so fewer links than members."""
    free, links = np.ones(len(members), bool), []
    for seed in range(len(members)):
        if not free[seed]:
            continue
        free[seed] = False
        front = [seed]
        while front:
            asked, front = front[:128], front[128:]
            open_ = np.flatnonzero(free)
            if not open_.size:
                break
            near = neighbours(members[asked], members[open_])
            hit = np.flatnonzero(near.any(0))
            first = near[:, hit].argmax(0)
            links += [(asked[f], int(open_[h])) for f, h in zip(first.tolist(), hit.tolist(), strict=True)]
            free[open_[hit]] = False
            front += open_[hit].tolist()
    return links


def group_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (of rep) within runs of equal keys. Short runs are compared side by side, long ones by themselves."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    a, b = [], []
    small = np.repeat((sizes > 1) & (sizes <= 16), sizes)
    k, f, r = key[small], fp[small], rep[small]
    for gap in range(1, 16):
        at = np.flatnonzero(k[gap:] == k[:-gap]) if len(k) > gap else np.zeros(0, int)
        if not at.size:
            break
        at = at[aligned_within(f[at], f[at + gap])]
        a.append(r[at])
        b.append(r[at + gap])
    for s, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        links = spanning(fp[s : s + n])
        if links:
            x, y = np.array(links).T
            a.append(rep[s + x])
            b.append(rep[s + y])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def links_in_groups(rows: DataFrame) -> DataFrame:
    """Links (a, b) within groups of rows (key, fp, rep), streamed through tasks in order of key."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            cut = int(np.searchsorted(got[0], got[0][-1]))  # the last run may go on in the next batch
            held = [x[cut:] for x in got]
            if cut:
                yield _links(got[0][:cut], got[1][:cut], got[2][:cut])
        if len(held[0]):
            yield _links(*held)

    return rows.repartition("key").sortWithinPartitions("key").select("key", "fp", "rep").mapInArrow(run, schema)


def _links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    a, b = group_links(key, fp.view(np.uint64), rep)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def bits(fp: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1))


def first_groups(reps: DataFrame) -> DataFrame:
    """Six rows (table, key, fp, rep) for each fingerprint: the key is two of its four blocks, and which two."""
    blocks = [bits(F.col("fp"), 16 * i, 16) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = [F.struct(F.lit(t).alias("table"), (F.shiftleft(blocks[i], 16) + blocks[j] + F.lit(t << 32)).alias("key")) for t, (i, j) in enumerate(pairs)]
    return reps.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("k.table", "k.key", "fp", "rep")


def rest_of(fp: Column, table: Column) -> Column:
    """The 32 bits that the key of a first group leaves out, as a number."""
    blocks = [bits(fp, 16 * i, 16) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    out = F.lit(0).cast("long")
    for t, (i, j) in enumerate(pairs):
        x, y = sorted({0, 1, 2, 3} - {i, j})
        out = F.when(table == t, F.shiftleft(blocks[y], 16) + blocks[x]).otherwise(out)
    return out


def dealt_again(rows: DataFrame, rest: Column, width: int) -> DataFrame:
    """Three rows for each: its key joined with one of three blocks of the `width` bits that still differ, and the bits left."""
    cuts = [(0, width // 3), (width // 3, width // 3), (2 * (width // 3), width - 2 * (width // 3))]
    subs = []
    for s, (low, n) in enumerate(cuts):
        left = F.shiftleft(F.shiftrightunsigned(F.col("rest"), low + n), low) + F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
        subs.append(F.struct(F.xxhash64("key", F.lit(s), bits(F.col("rest"), low, n)).alias("key"), left.alias("rest")))
    return rows.withColumn("rest", rest).select("fp", "rep", F.explode(F.array(*subs)).alias("k")).select("k.key", "k.rest", "fp", "rep")


def links(reps: DataFrame, split: int = SPLIT) -> DataFrame:
    """Links (a, b) between rows (fp, rep) of distinct fingerprints: whatever lies within the radius is joined by them."""
    rows, found = first_groups(reps), None
    for level in range(3):
        if level < 2:
            large = checkpoint(rows.groupBy("key").count().where(F.col("count") > split).select("key"))
            more = not large.isEmpty()
        else:
            more = False
        here = links_in_groups(rows.join(large, "key", "left_anti") if more else rows)
        found = here if found is None else found.union(here)
        if not more:
            break
        hot = rows.join(large, "key", "left_semi")
        # 32 bits are left at first; a deal by three blocks leaves 22 at most. Equal hashes of two keys only add comparisons.
        rows = dealt_again(hot, rest_of(F.col("fp"), F.col("table")), 32) if level == 0 else dealt_again(hot, F.col("rest"), 22)
    return found.distinct()


def near_duplicates(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): fingerprints of at most RADIUS differing bits link; a component has its smallest doc_id.

    Rows with a null doc_id link nothing and get the smallest doc_id that shares their fingerprint's component, null if there is none.
    """
    fps = checkpoint(fingerprints(docs))
    reps = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = components(links(reps.where("rep is not null"), split))
    named = reps.join(labels, reps["rep"] == labels["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, all columns kept.

    Of rows that share that doc_id one stays. Rows with a null doc_id can't be told apart and stay.
    """
    near = near_duplicates(docs).where("doc_id is not null")
    gone = checkpoint(near.groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count("*").alias("n")).where("gone or n > 1"))
    left = docs.join(gone.where("gone").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    again = gone.where("not gone and n > 1").select("doc_id")
    if again.isEmpty():
        return left
    repeated = left.join(again, "doc_id", "left_semi").select(docs.columns)
    return left.join(again, "doc_id", "left_anti").select(docs.columns).union(repeated.dropDuplicates(["doc_id"]))
