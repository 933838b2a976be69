"""Periodic runs of words: maximal stretches of consecutive words in which words a period apart are equal.

A run of period q is q words and more said at least twice over, and LEAST words long or longer. Every run repeats a Lyndon word, the
longest that begins at some place of it under one order of words or under the reverse. So for each place and order that word's length is a
candidate period: where it ends is where the next smaller (or greater) suffix begins. A candidate is extended to the right by how far the
suffixes at its two ends agree, and to the left by how far the prefixes before them do; it is a run if both together fill a second period.

Both lengths come from suffix trees by Ukkonen's method, one of the words and one of their reversal: of the Euler tour of a tree the lowest
node between neighbouring leaves is kept, and the lowest over a range of them, the depth of a lowest common ancestor, is read from a table of
powers of two, two look-ups whatever the length. Words that occur once in a stretch can be in no run: they cut it, and pieces under LEAST
words are let go of, until nothing changes; what is left, numbered by piece, is what the trees are made of, many pieces in one tree.

Null and empty texts have no words and no runs; repeated rows give repeated rows; an empty table gives none; other columns are not read.
Memory follows the longest piece, not the table: trees are made of TREE words or of one longer piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, texts

LEAST, TREE = 12, 1 << 16
WHITE = r"[\x20\x09-\x0D]+"


class SuffixTree:
    """Ukkonen's suffix tree of numbers from 0 to n_symbols - 1, and how long its suffixes agree."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.size = len(symbols) + 1
        depth, kids = grown([*symbols.tolist(), n_symbols], n_symbols + 1)
        depth = np.array(depth, np.int64)
        keys, kid = np.fromiter(kids.keys(), np.int64, len(kids)), np.fromiter(kids.values(), np.int64, len(kids))
        node, symbol = np.divmod(keys, n_symbols + 1)
        parent = np.zeros(len(depth), np.int64)
        parent[kid] = node
        order = np.lexsort((-symbol, node))
        many = np.bincount(node, minlength=len(depth))
        tour = np.array(walked(kid[order].tolist(), np.append(0, np.cumsum(many)).tolist()), np.int64)
        leaf = np.flatnonzero(many[tour] == 0)
        self.rank = np.empty(self.size, np.int64)
        self.rank[self.size - depth[tour[leaf]]] = np.arange(self.size)
        lowest = [depth[parent[tour[leaf[:-1] + 1]]].astype(np.int32)]
        while (step := 1 << (len(lowest) - 1)) < len(lowest[-1]):
            lowest.append(np.minimum(lowest[-1][:-step], lowest[-1][step:]))
        self.lowest = lowest

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and at j, two places that differ, have in common at their beginning."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            row = self.lowest[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def grown(s: list[int], span: int) -> tuple[list[int], dict[int, int]]:
    """Ukkonen's tree of s, whose last symbol occurs once: the depth of each node in symbols, and the child for node * span + symbol.

    The root is 0; a leaf's depth is the length of its suffix.
    """
    n = len(s)
    start, end, link, depth = [0], [0], [0], [0]
    kids: dict[int, int] = {}
    node = edge = length = open_ = 0
    for i, c in enumerate(s):
        open_ += 1
        last = 0
        while open_:
            if not length:
                edge = i
            key = node * span + s[edge]
            kid = kids.get(key)
            if kid is None:
                kids[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                depth.append(n - i + open_ - 1)
                if last:
                    link[last] = node
                last = node
            else:
                first = start[kid]
                whole = end[kid] - first
                if length >= whole:
                    node, edge, length = kid, edge + whole, length - whole
                    continue
                if s[first + length] == c:
                    if last:
                        link[last] = node
                    length += 1
                    break
                fork = len(start)
                start += (first, i)
                end += (first + length, n)
                link += (0, 0)
                depth += (open_ - 1, n - i + open_ - 1)
                kids[key] = fork
                kids[fork * span + c] = fork + 1
                start[kid] = first + length
                kids[fork * span + s[first + length]] = kid
                if last:
                    link[last] = fork
                last = fork
            open_ -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - open_ + 1
    return depth, kids


def walked(kids: list[int], bounds: list[int]) -> list[int]:
    """Nodes in depth-first order; kids holds each node's children, the last to be visited first."""
    stack, out = [0], []
    while stack:
        v = stack.pop()
        out.append(v)
        a, b = bounds[v], bounds[v + 1]
        if a < b:
            stack += kids[a:b]
    return out


def next_smaller(ranks: list[int]) -> np.ndarray:
    """For each place the next one of a smaller rank; len(ranks) if there is none."""
    out, waiting = [len(ranks)] * len(ranks), []
    for i, r in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > r:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: np.ndarray, n_symbols: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of each run of numbers from 0 to n_symbols - 1, by start, then period."""
    n = len(symbols)
    right, left = SuffixTree(symbols, n_symbols), SuffixTree(symbols[::-1], n_symbols)
    found = []
    for ranks in (right.rank, n - right.rank):
        begin, stop = np.arange(n), next_smaller(ranks.tolist())[:n]
        begin, stop = begin[stop <= n], stop[stop <= n]
        period = stop - begin
        more = right.agree(begin, stop)
        before = np.zeros(len(begin), np.int64)
        inner = begin > 0
        before[inner] = left.agree(n - begin[inner], n - stop[inner])
        length = before + period + more
        good = (length >= 2 * period) & (length >= least)
        found.append(np.stack([(begin - before)[good], period[good], length[good]], 1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def pieces(codes: np.ndarray, owner: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs can be: places in codes, the piece that each is in, and its word numbered by piece. owner: a number for each document, ascending."""
    place, piece, word = np.arange(len(codes)), owner, codes
    while True:
        n_words = int(word.max(initial=0)) + 1
        _, word, many = np.unique(piece * n_words + word, return_inverse=True, return_counts=True)
        stays = many[word] > 1
        place, piece, word = place[stays], piece[stays], word[stays]
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) > 1) | (np.diff(piece) > 0)
        again = np.cumsum(new) - 1
        long = (np.bincount(again) >= least)[again] if len(again) else np.zeros(0, bool)
        if stays.all() and long.all():
            return place, again, word
        place, piece, word = place[long], again[long], word[long]


def runs_of_all(words: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    codes, owner, begins, total = [], [], [], 0
    for i, ws in enumerate(words):
        numbers = {w: k for k, w in enumerate(dict.fromkeys(ws))}
        begins.append(total)
        total += len(ws)
        if 2 * len(numbers) <= 2 * len(ws) - least:  # a run of n words has n / 2 different ones at most
            codes.append(np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws)))
            owner.append(i)
    if not codes:
        return out
    where = np.concatenate([np.arange(begins[i], begins[i] + len(c)) for i, c in zip(owner, codes, strict=True)])
    owners = np.repeat(owner, list(map(len, codes)))
    place, piece, word = pieces(np.concatenate(codes), owners, least)
    for a, b in trees(piece):
        named, local = np.unique(word[a:b], return_inverse=True)
        for start, length, period in zip(*(x.tolist() for x in runs_of(local, len(named), least)), strict=True):
            at = place[a + start]
            out[owners[at]].append((int(where[at]) - begins[owners[at]], length, period))
    return out


def trees(piece: np.ndarray, size: int = TREE) -> Iterator[tuple[int, int]]:
    """Bounds of whole pieces together, about `size` places or one longer piece."""
    ends = np.append(np.flatnonzero(np.diff(piece)) + 1, len(piece)) if len(piece) else np.zeros(0, np.int64)
    a, before = 0, 0
    for end in ends.tolist():
        if end - a > size and before > a:
            yield a, before
            a = before
        before = end
    if before > a:
        yield a, before


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(runs).T
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    gone = np.cumsum(change)[:-1] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def word_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (doc_id, runs, collapsed): the runs of each text's words (start, length, period; by start, then period), and the text's words without their repeats."""

    def make():
        def step(batch: dict) -> dict:
            words = [x.split() for x in batch["text"]]
            found = runs_of_all(words, least)
            runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found]
            return {"doc_id": batch["doc_id"], "runs": runs, "collapsed": [collapsed(w, r).decode() for w, r in zip(words, found, strict=True)]}

        return step

    return arrow_map(texts(docs, as_bytes=True), make, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): by the checksum of its doc_id one text in ten repeats a part of itself from some word on. Rows without a doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    ws = F.filter(F.split("text", WHITE), lambda w: w != "")
    rows = texts(docs).select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, ws).alias("ws"))
    n, a, p = F.size("ws"), F.col("a"), F.col("p")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - a) / (3 + F.col("g") % 8)))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("ws", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return rows.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def run_digest(rows: DataFrame) -> DataFrame:
    """The longest run (ties: the first, then the shorter period) of rows of word_runs, how many there are, and hashes of runs and text."""
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), line.alias("line"), "collapsed")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    milli = F.floor(1000 * length / period)
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"),
        F.sha2(F.col("line").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(word_runs(with_planted_runs(table(spark, sf_dir, "documents"))))
