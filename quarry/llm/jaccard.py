"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of SHARE or more, and their components. Exact.

Equal sets are one class first, by a 128-bit hash; the class's smallest doc_id stands for it. What follows is for representatives:

- How many documents hold a shingle is counted over all of them, for prefixes of its 64-bit hash that are long enough to hardly meet. Slices of a task's
  documents send their distinct hashes, packed by range of hashes, to where each range is counted, and get back one byte for each.
- A set's shingles are ordered by that count, the rarest first, then by hash. Any partner of a set of n lacks n - ceil(0.8 n) of them at most, so
  among one more than that at the head of the order some are shared. Shingles that no other document holds fill the head but index nothing.
- Those that FREQUENT sets hold or fewer are indexed alone. The others are dealt into classes by hash, and pairs of a class are indexed: k shingles
  of a class have k - 1 that are certain to make a shared pair, so the head is extended until certain ones suffice. The number of classes
  follows the length: partners' lengths lie in one or two neighbouring levels, so each set is indexed for both levels that it may meet in,
  and the pairs of a long head stay in proportion to it.
- Each indexed combination's sets are held first against one of them, its leader, the one with the smallest share of shingles of its own, so a group
  of thousands of near copies costs its size and not its square. Only combinations that still hold several components pair up sets of different
  ones. Lengths, how many shingles are a set's own, and bitmaps of the others
  (a bit that one set has and the other doesn't is a shingle that they don't share) bound what two sets can have in common; pairs that can't be
  similar enough are not formed.
- Candidates are verified on their whole sets. 64-bit hashes stand for shingles throughout.

Null and empty texts, and those without words, have an empty set and link with nothing. Rows that share a doc_id are one document, linked by whatever
links one of them. Rows without a doc_id link nothing; they get the component of their class, null if no row of it has a doc_id. An empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_BYTES, arrow_map, checkpoint, shared_path, table, texts
from .components import components
from .simhash import LOWER

SHINGLE, FREQUENT = 5, 64
#: Similarity of 80 in a hundred.
SHARE, WHOLE = 4, 5
#: Hashes counted in one group; bytes of text for each, about; the shingles of a class and length.
RANGE, SHINGLE_BYTES, CLASS = 1 << 22, 6, 8
WORDS, WORD_BYTES = 400_000, 48
SENT = 1 << 20
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: high bytes, which vary less, follow each other."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending 32-bit keys by their differences, which wrap around where a new range begins."""
    return packed(np.diff(keys, prepend=np.uint32(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint32), dtype=np.uint32)


class Hasher(dict):
    """64-bit hashes of words; short ones are remembered, as many as fit a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS:
                self.clear()
            self[word] = value
        return value


def shingle_set(text: bytes, known: Hasher) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending: A-Z lower-cased, split at ASCII white space; fewer words are one shingle, none give none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out + h[k : len(h) - size + 1 + k]) * A
    return np.unique(mixed(out))


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


LONG, BINARY, LONGS = T.LongType(), T.BinaryType(), T.ArrayType(T.LongType())
SLICE = fields(slice=LONG, doc_ids=LONGS, sizes=LONGS, sets=T.ArrayType(BINARY), starts=LONGS, keys=BINARY, owners=BINARY)
ASKED = fields(range=LONG, slice=LONG, keys=BINARY, times=BINARY)
TOLD = fields(range=LONG, slice=LONG, counts=BINARY)
BITS = [f"b{i}" for i in range(8)]
INDEX = fields(sig=LONG, rep=LONG, n=LONG, most=LONG, **dict.fromkeys(BITS, LONG))


def batch_of(schema: T.StructType, columns: list) -> pa.RecordBatch:
    out = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def slices(docs: DataFrame, bits: int) -> DataFrame:
    """One row for each slice of a task's documents: how many shingles each has and a hash of its set, and the shingles of all in order of hash.

    Of a shingle's hash 32 bits stand after the `bits` that name its range, and whose it is.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = Hasher(), TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                sets = [shingle_set(x, known) for x in part.column(1).to_pylist()]
                sizes = list(map(len, sets))
                kind = np.uint16 if len(sets) <= 1 << 16 else np.uint32
                h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=kind), sizes)
                order = np.argsort(h, kind="stable")
                h = h[order]
                starts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                keys = (h >> np.uint64(32 - bits)).astype(np.uint32)
                own = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                yield batch_of(SLICE, [[x] for x in (number, part.column(0).to_pylist(), sizes, own, starts, packed_keys(keys), packed(owner[order]))])
                number += 1

    return texts(docs, as_bytes=True).mapInArrow(run, SLICE)


def firsts(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where keys, ascending within ranges that begin at starts, differ from the one before, or a range begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[starts[starts < len(keys)]] = True
    return new


def set_counts(held: DataFrame) -> DataFrame:
    """Rows (slice, told): for the distinct keys of each slice, by range, how many documents hold them, copies too, 255 for more."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, starts, raw = batch.column(0)[k].as_py(), batch.column(1)[k].values.to_numpy(), batch.column(2)[k].as_py()
                keys = unpacked_keys(raw)
                at = np.flatnonzero(firsts(keys, starts))
                times = np.minimum(np.diff(np.append(at, len(keys))), 255).astype(np.uint8)
                cuts = np.searchsorted(at, starts)
                full = np.flatnonzero(np.diff(cuts))
                parts = [(packed_keys(keys[at[x:y]]), packed(times[x:y])) for x, y in zip(cuts[full].tolist(), cuts[full + 1].tolist(), strict=True)]
                yield batch_of(ASKED, [full, [number] * len(full), [x for x, _ in parts], [y for _, y in parts]])

    def count(rows: pa.Table) -> pa.Table:
        parts = [unpacked_keys(x) for x in rows.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        times = np.concatenate([unpacked(x, np.uint8) for x in rows.column("times").to_pylist()])
        order = np.argsort(keys)
        first = np.flatnonzero(firsts(keys[order], np.zeros(1, np.int64)))
        total = np.minimum(np.add.reduceat(times[order], first, dtype=np.int64), 255) if len(first) else np.zeros(0, np.int64)
        back = np.empty(len(keys), np.uint8)
        back[order] = np.repeat(total, np.diff(np.append(first, len(keys))))
        cuts = np.append(0, np.cumsum(list(map(len, parts)))).tolist()
        told = [packed(back[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        return pa.Table.from_batches([batch_of(TOLD, [rows.column("range").to_pylist(), rows.column("slice").to_pylist(), told])])

    asked = held.select("slice", "starts", "keys").mapInArrow(ask, ASKED)
    told = asked.groupBy("range").applyInArrow(count, TOLD)
    return told.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("range", "counts"))).alias("told"))


def levels(longest: int) -> np.ndarray:
    """The least length of each level; a set and its partners lie in one level or two neighbouring ones."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, -(-out[-1] * WHOLE // SHARE)))
    return np.array(out, np.int64)


def lacking(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set of n a partner can lack."""
    return n - -(-n * SHARE // WHOLE)


def combinations(sizes: np.ndarray, token: np.ndarray, count: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(combination, owner) of all that sets are indexed by. Tokens are ordered by hash; sizes are the sets' lengths."""
    need = lacking(sizes) + 1 - np.bincount(owner[count == 1], minlength=len(sizes))
    use = (count > 1) & (need[owner] > 0)
    token, count, owner = token[use], count[use].astype(np.int64), owner[use].astype(np.int64)
    order = np.argsort(owner << 8 | count, kind="stable")
    token, count, owner = token[order], count[order], owner[order]
    starts = np.searchsorted(owner, np.arange(len(sizes)))
    rare = count <= FREQUENT
    inside = np.arange(len(owner)) - starts[owner]
    single = rare & (inside < need[owner])
    found, whose = [mixed(token[single] * A)], [owner[single]]
    more = need - np.bincount(owner[rare], minlength=len(sizes))
    often = ~rare & (more[owner] > 0)
    token, owner, least = token[often], owner[often], levels(int(sizes.max(initial=1)))
    level = np.searchsorted(least, sizes, "right") - 1
    for label in (level - 1, level):
        many = np.maximum(least[np.maximum(label, 0)] // CLASS, 1)
        held = (mixed(token + B) % many[owner].astype(np.uint64)).astype(np.int64)
        place = owner * (int(many.max(initial=1)) + 1) + held
        by_class = np.argsort(place, kind="stable")
        again = np.zeros(len(place), bool)
        again[by_class[1:]] = place[by_class[1:]] == place[by_class[:-1]]
        certain = np.cumsum(again)
        begin = np.searchsorted(owner, owner)
        before = certain - again - np.append(0, certain)[begin]
        head = before < more[owner]
        x, t, o = place[head], token[head], owner[head]
        by_class = np.argsort(x, kind="stable")
        x, t, o = x[by_class], t[by_class], o[by_class]
        gap = 1
        while gap < len(x):
            at = np.flatnonzero(x[gap:] == x[:-gap])
            if not len(at):
                break
            low, high = np.minimum(t[at], t[at + gap]), np.maximum(t[at], t[at + gap])
            found.append(mixed(mixed(low + label[o[at]].astype(np.uint64) * C) * A + high))
            whose.append(o[at])
            gap += 1
    return np.concatenate(found), np.concatenate(whose)


def bitmaps_of(token: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A row of 64-bit numbers for each of n sets: a bit for each token, by hash."""
    width = 64 * len(BITS)
    bits = np.zeros(n * width, np.uint8)
    bits[owner.astype(np.int64) * width + (mixed(token + C) % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits).reshape(n, -1).view(np.int64)


def index(held: DataFrame, told: DataFrame, chosen: DataFrame, bits: int) -> DataFrame:
    """Rows (sig, rep, n, most, b0..): the combinations that each set is indexed by, chosen ones (slice, places in it) alone; most: how many of its shingles other sets hold too; their bitmap.

    Rows of a set follow each other, so that its bitmap takes little space in columns.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                reps, sizes, starts = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in range(3))
                kept = np.zeros(len(sizes), bool)
                kept[batch.column(6)[k].values.to_numpy()] = True
                keys, owner = unpacked_keys(batch.column(3)[k].as_py()), unpacked(batch.column(4)[k].as_py(), np.uint16 if len(sizes) <= 1 << 16 else np.uint32)
                counts = np.concatenate([unpacked(x["counts"], np.uint8) for x in batch.column(5)[k].as_py()])
                count = counts[np.cumsum(firsts(keys, starts)) - 1]
                token = np.repeat(np.arange(1 << bits, dtype=np.uint64), np.diff(starts)) << np.uint64(32) | keys
                mine = kept[owner]
                token, count, owner = token[mine], count[mine], owner[mine]
                sig, whose = combinations(sizes, token, count, owner)
                if len(sig):
                    whose, sig = np.unique(np.stack([whose, sig.view(np.int64)]), axis=1)
                    most = sizes - np.bincount(owner[count == 1], minlength=len(sizes))
                    bitmaps = bitmaps_of(token[count > 1], owner[count > 1], len(sizes))
                    yield batch_of(INDEX, [sig, reps[whose], sizes[whose], most[whose], *bitmaps[whose].T])

    return held.join(told, "slice").join(chosen, "slice").select("doc_ids", "sizes", "starts", "keys", "owners", "told", "places").mapInArrow(run, INDEX)


def fits(n: Column, m: Column, shared: Column) -> Column:
    """Whether sets of these lengths are partners if they share so many shingles."""
    return (SHARE + WHOLE) * F.least(shared, n, m) >= SHARE * (n + m)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents, by doc_id, that are similar enough. Only texts of documents in pairs are read into sets.

    Up to SENT ids are sent to where the texts are, so that those aren't shuffled; beyond that the texts go to the ids.
    """

    def make():
        known = Hasher()
        return lambda batch: {"id": batch["doc_id"], "tokens": [shingle_set(x, known).tobytes() for x in batch["text"]]}

    def similar():
        def one(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return WHOLE * both >= SHARE * (len(x) + len(y) - both)

        def step(batch: dict) -> dict:
            good = [one(x, y) for x, y in zip(batch["x"], batch["y"], strict=True)]
            return {k: [v for v, g in zip(batch[k], good, strict=True) if g] for k in ("a", "b")}

        return step

    ids = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= SENT else ids
    sets = checkpoint(arrow_map(texts(docs.join(ids, "doc_id", "left_semi"), as_bytes=True), make, "id long, tokens binary"))
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    return arrow_map(rows.select("a", "b", "x", "y"), similar, "a long, b long").distinct()


def leader_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b): each set with the leader that it shares most combinations with; a combination's leader is the set with the smallest share of shingles of its own."""
    lead = rows.groupBy("sig").agg(F.min(F.struct((1 - F.col("most") / F.col("n")).alias("at"), "rep", "n", "most")).alias("x"), F.count("*").alias("held")).where("held > 1")
    lead = lead.select("sig", F.col("x.rep").alias("b"), F.col("x.n").alias("m"), F.col("x.most").alias("most_other"))
    met = rows.join(lead, "sig").where(fits(F.col("n"), F.col("m"), F.least("most", "most_other")) & (F.col("rep") != F.col("b")))
    shared = met.groupBy("rep", "b").count()
    return shared.groupBy("rep").agg(F.max(F.struct("count", "b")).alias("x")).select(F.col("rep").alias("a"), F.col("x.b").alias("b"))


def open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of combinations that hold sets of several components, each with its component c."""
    named = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    still = named.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig")
    return named.join(still, "sig").select("sig", "rep", "n", "most", "c")


def pairs_between(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of sets of different components that share a combination. bitmaps: rows (rep, b0..)."""
    sides = rows.join(bitmaps, "rep")
    a, b = sides.alias("a"), sides.alias("b")

    def lacks(x: str, y: str) -> Column:
        """How many shingles of x, held by others too, are certainly not in y."""
        return reduce(add, [F.bit_count(F.col(f"{x}.{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{c}")))) for c in BITS])

    shared = F.least(F.col("a.most") - lacks("a", "b"), F.col("b.most") - lacks("b", "a"))
    apart = (F.col("a.rep") < F.col("b.rep")) & (F.col("a.c") != F.col("b.c"))
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & apart & fits(F.col("a.n"), F.col("b.n"), shared))
    return met.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def links(docs: DataFrame, held: DataFrame, chosen: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) between the chosen documents of slices: whatever is similar enough is joined by them. docs: the documents, by doc_id."""
    spark = docs.sparkSession
    folder = shared_path(spark, "jaccard-index")
    index(held, set_counts(held), chosen, bits).write.parquet(folder)
    indexed = spark.read.schema(INDEX).parquet(folder)
    # a set that has too many shingles of its own has no partner of any length
    rows = indexed.select("sig", "rep", "n", "most").where(fits(F.col("most"), F.col("n"), F.col("most")))
    found = checkpoint(verified(docs, checkpoint(leader_pairs(rows))))
    left = checkpoint(open_rows(rows, components(found)))
    if left.isEmpty():
        return found
    pairs = checkpoint(pairs_between(left, indexed.select("rep", *BITS).distinct()))
    return found.union(verified(docs, pairs))


def similar_components(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): the smallest doc_id that links lead to from a document, itself included."""
    docs, spark = texts(docs), docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(1, n_bytes / SHINGLE_BYTES / RANGE))))
    folder = shared_path(spark, "jaccard-sets")
    slices(docs, bits).write.parquet(folder)
    held = spark.read.schema(SLICE).parquet(folder)
    each = held.select("slice", F.posexplode(F.arrays_zip("doc_ids", "sizes", "sets")).alias("place", "x"))
    keyed = checkpoint(each.select("slice", "place", F.col("x.doc_ids").alias("doc_id"), F.col("x.sizes").alias("n"), F.col("x.sets").alias("key")))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "slice", "place"))).alias("x")
    classes = checkpoint(keyed.where("n > 0").groupBy("key").agg(first, F.max("n").alias("n")).select("key", "n", "x.slice", "x.place", F.col("x.doc_id").alias("rep")))
    # sets of fewer shingles equal all their partners
    chosen = classes.where("n >= 4 and rep is not null").groupBy("slice").agg(F.collect_list("place").alias("places"))
    of_rows = keyed.join(classes.select("key", "rep"), "key", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    # rows that share a doc_id but not a set
    spread = of_rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("all")).where("a <> b")
    same = spread.select("a", F.explode("all").alias("b"))
    labels = components(links(docs, held, chosen, bits).union(same))
    named = of_rows.join(labels, F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
