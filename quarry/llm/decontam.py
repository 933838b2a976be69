"""Benchmark decontamination: shared word pairs find candidate places, Smith-Waterman alignment scores them.

Test items of more than PASSAGE words are read through windows of that many, each begun half a window after the last or sooner, so that
what a document copies of a long item lies in one of them for the most part; equal passages are aligned once. Matches score 2, mismatches and gaps cost 1; the score is the best local
alignment's share of what a perfect copy has, so edits, insertions and losses lower it gradually.

Where to align follows from the least score s, and loses no alignment that reaches it. With m matches of the n words of a passage, such
an alignment has 2m - 2sn edits at most, so it spans (3 - 2s)n words of the text at most, and holds 2sn - m - 1 >= (2s - 1)n - 1 pairs of
neighbours that are neighbours in the passage too. So a passage is aligned where so many of its pairs of words lie within such a span,
and its words and pairs there number 2sn - 1 together. Passages so short that no pair is certain (5 words at 0.6) must share a run of
SEED words, or as many as they have.

The benchmark, the stated query set, is taken in blocks of at most BLOCK passages, a bound that does not grow; each block's pairs travel
to every task, all documents are read against it once, SLICE words at a time, and the block is let go of. Whatever the number of blocks,
each document and item have one row, the best.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, checkpoint, table, texts

SEED, PASSAGE, BLOCK, SLICE = 4, 128, 20_000, 4096
MATCH, MISS, GAP = 2, -1, -1
LEAST_SCORE = 0.6
BASE = np.uint64(0x9E3779B97F4A7C15)


#: Thai, Lao, Burmese, Khmer, kana and Chinese characters: written without spaces between words.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
ANY_UNSPACED, WORD = re.compile(f"[{UNSPACED}]"), re.compile(r"[^\W_]+")
WORD_OR_CHARACTER = re.compile(rf"(?![\W_])[{UNSPACED}]|[^\W_{UNSPACED}]+")


#: ASCII but letters and digits, as a space.
SPACED = {i: " " for i in range(128) if not chr(i).isalnum()}


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; in scripts without spaces each character is a word."""
    if text.isascii():
        return text.lower().translate(SPACED).split()
    return (WORD_OR_CHARACTER if ANY_UNSPACED.search(text) else WORD).findall(text.lower())


def windows(n: int, size: int) -> list[int]:
    """Where windows of `size` words begin in an item of n: evenly, half a window apart at most, the last at its end."""
    count = 1 if n <= size else -(-2 * (n - size) // size) + 1
    return [k * (n - size) // max(count - 1, 1) for k in range(count)] if n > size else [0]


def passages(benchmark: DataFrame, size: int = PASSAGE) -> DataFrame:
    """Rows (item_id, passage, words) of at most `size` words; items of null or empty text give none."""

    def make():
        def step(batch: dict) -> dict:
            out = {"item_id": [], "passage": [], "words": []}
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                found = words(text)
                for k, at in enumerate(windows(len(found), size) if found else []):
                    out["item_id"].append(item)
                    out["passage"].append(k)
                    out["words"].append(found[at : at + size])
            return out

        return step

    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(rows, make, "item_id long, passage int, words array<string>")


def grams(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the n-grams of word ids; zero where a word isn't known."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    n = len(ids) - size + 1
    out, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = ids[k : k + n]
        out = out * BASE + part.astype(np.uint64)
        whole &= part > 0
    out ^= out >> np.uint64(29)
    return np.where(whole, out, np.uint64(0))


class Block:
    """A bounded block of passages: their words as ids, and which passages hold an n-gram."""

    def __init__(self, rows: list, least: float):
        self.names = [r["pid"] for r in rows]
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for r in rows for w in r["words"]))}
        self.ids = [np.array([self.vocabulary[w] for w in r["words"]], np.int64) for r in rows]
        n = np.array([len(x) for x in self.ids], np.int64)
        pairs = np.ceil((2 * least - 1) * n - 1 - 1e-9).astype(np.int64)
        self.sizes = np.where(pairs >= 1, 2, np.minimum(n, SEED))
        self.needs, self.spans = np.maximum(pairs, 1), np.maximum(n, ((3 - 2 * least) * n + 1e-9).astype(np.int64))
        self.least = [2 * least * x - 1 - 1e-9 for x in n.tolist()]
        self.index = {k: self.postings(k) for k in np.unique(self.sizes).tolist()}

    def postings(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of the passages that are found by this size, sorted; where the passages of each start; the passages."""
        own = [(g, np.full(len(g), p)) for p in np.flatnonzero(self.sizes == size).tolist() for g in [np.unique(grams(self.ids[p], size))]]
        if not own:
            return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        found, held = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.argsort(found, kind="stable")
        keys, starts = np.unique(found[order], return_index=True)
        return keys, np.append(starts, len(found)), held[order]

    def of(self, text: str) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))

    def hits(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, place of a shared n-gram) for each n-gram of the words and each passage that holds it, sorted."""
        keys, starts, held = self.index[size]
        found = grams(ids, size) if len(keys) else keys
        at = np.flatnonzero(found)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(keys, found[at]), len(keys) - 1)
        hit = keys[near] == found[at]
        at, near = at[hit], near[hit]
        many = starts[near + 1] - starts[near]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        passage, place = held[np.repeat(starts[near], many) + inside], np.repeat(at, many)
        order = np.argsort(passage, kind="stable")
        return passage[order], place[order]

    def places(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each passage, the parts of the words that an alignment of the least score can lie in."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        overlap = int(self.spans.max(initial=0))
        for size in self.index:
            for begin in range(0, max(1, len(ids) - overlap), SLICE):
                passage, place = self.hits(ids[begin : begin + SLICE + overlap], size)
                last = np.arange(len(passage)) + self.needs[passage] - 1
                near = np.minimum(last, len(passage) - 1)
                span = self.spans[passage]
                good = np.flatnonzero((last < len(passage)) & (passage[near] == passage) & (place[near] - place + size <= span))
                lows, highs = begin + place[near[good]] + size - span[good], begin + place[good] + span[good]
                for p, low, high in zip(passage[good].tolist(), np.maximum(lows, 0).tolist(), np.minimum(highs, len(ids)).tolist(), strict=True):
                    if out[p] and low <= out[p][-1][1]:
                        out[p][-1] = (min(low, out[p][-1][0]), max(high, out[p][-1][1]))
                    else:
                        out[p].append((low, high))
        return out

    @functools.cached_property
    def own(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The distinct words and pairs of each passage, sorted."""
        return [(np.unique(x), np.unique(grams(x, 2))) for x in self.ids]

    def may_hold(self, p: int, ids: np.ndarray) -> bool:
        """Whether some span of the words holds enough words and pairs of a passage."""
        known, pairs = self.own[p]
        own = among(known, ids)
        both = own.astype(np.int64)
        if len(pairs):
            both[:-1] += among(pairs, grams(ids, 2)) & own[:-1] & own[1:]
        total = np.concatenate([[0], np.cumsum(both)])
        return bool((total[np.minimum(np.arange(len(ids)) + self.spans[p], len(ids))] - total[:-1]).max(initial=0) >= self.least[p])


def among(members: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are members, which are sorted."""
    return members[np.minimum(np.searchsorted(members, values), len(members) - 1)] == values


def align(item: np.ndarray, text: np.ndarray, least: float = 0.0) -> tuple[float, int]:
    """Smith-Waterman: the best local alignment's score, and where it ends in the text. A row at a time; a running maximum carries gaps along it.

    Where what is left of the item can't raise any alignment to the least score, none is given: (0, 0).
    """
    slope = -GAP * np.arange(len(text))
    row, best, end = np.zeros(len(text), np.int64), 0, 0
    for k, w in enumerate(item, 1):
        diagonal = np.where(text == w, MATCH, MISS)
        diagonal[1:] += row[:-1]
        fresh = np.maximum(diagonal, row + GAP)
        np.maximum(fresh, 0, out=fresh)
        fresh += slope
        np.maximum.accumulate(fresh, out=fresh)
        row = fresh - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        if max(best, int(row[top]) + MATCH * (len(item) - k)) < least * MATCH * len(item) - 1e-9:
            return 0.0, 0
    return best / (MATCH * len(item)), end


def matches_of(block: Block, text: str, least: float) -> list[tuple[int, float, int, int]]:
    """(passage, score, first word, last word) of the best alignment of each passage with a text, if it scores enough."""
    ids = block.of(text)
    best: dict[int, tuple[float, int, int]] = {}
    for p, parts in block.places(ids).items():
        for low, high in parts:
            if not block.may_hold(p, ids[low:high]):
                continue
            score, end = align(block.ids[p], ids[low:high], least)
            if score >= least and score > best.get(p, (0,))[0]:
                best[p] = (score, max(0, low + end + 1 - len(block.ids[p])), low + end)
    return [(block.names[p], *x) for p, x in best.items()]


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, block_size: int = BLOCK) -> DataFrame:
    """Rows (doc_id, item_id, score, first_word, last_word): one for each document that holds enough of a test item, of its best passage.

    Empty and null texts hold nothing; items under SEED words match where all their words follow each other; an empty benchmark gives
    no rows. Rows that share a doc_id (null is one too), and rows that share an item_id, count as one: the best of them is given.
    """
    spark, docs = docs.sparkSession, texts(docs)
    cut = checkpoint(passages(benchmark))
    distinct = checkpoint(cut.select("words").distinct().withColumn("pid", F.monotonically_increasing_id()))
    items = cut.join(distinct, "words").select("pid", "item_id").distinct()
    blocks = max(1, -(-distinct.count() // block_size))
    names, found = ("doc_id", "pid", "score", "first_word", "last_word"), None
    for b in range(blocks):
        sent = spark.sparkContext.broadcast(Block(distinct.where(F.pmod(F.xxhash64("pid"), F.lit(blocks)) == b).collect(), least))

        def make(sent=sent):
            def step(batch: dict) -> dict:
                got = [(d, *m) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for m in matches_of(sent.value, text, least)]
                return dict(zip(names, map(list, zip(*got, strict=True)), strict=True)) if got else {n: [] for n in names}

            return step

        part = checkpoint(arrow_map(docs, make, "doc_id long, pid long, score double, first_word long, last_word long"))
        sent.destroy()
        found = part if found is None else found.union(part)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("first"), (-F.col("last_word")).alias("last"))).alias("m")
    rows = found.join(items, "pid").groupBy("doc_id", "item_id").agg(best)
    return rows.select("doc_id", "item_id", "m.score", (-F.col("m.first")).alias("first_word"), (-F.col("m.last")).alias("last_word"))


def clean_of(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents that hold no test item, all columns kept. Rows without a doc_id stay."""
    dirty = checkpoint(contamination(docs, benchmark, least).select("doc_id").distinct())
    return docs.join(dirty, "doc_id", "left_anti").select(docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "first_word", "last_word")
