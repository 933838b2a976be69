"""Toxicity scores of texts whose words may be disguised: noisy-channel restoration, then evidence from restored words.

A token that is more than plain letters becomes a lattice: leet signs stand for letters, separators may be dropped, repeated letters
shortened. Viterbi decoding under a character trigram model picks the likeliest word. A token of plain letters has one path and stays.
Spaces are part of the lattice too: each may be dropped, at a cost, or end a word, and the words that the likeliest path joins count
beside the tokens. As the model looks two characters back, a space between longer words is decided by the two letters on either side of
it, and a run of single characters together with the two letters on either side of the run. Evidence is words and word beginnings that are nearly always toxic, beyond what chance among so
many words explains; near copies count as one document, so that they don't make a document's rare words look toxic. A text's score is
the chance that at least one of its pieces of evidence holds.

The character model is counted over all documents in Spark; evidence is learned from a bounded sample of labelled rows (FIT_DOCS, about).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, TwoGenerations, arrow_map, checkpoint, keep_rows, table, texts
from .language import bounded_sample, fold

FIT_DOCS = 20_000
#: Pairs of letters that the table of spaces holds.
MOST_PAIRS = 8192
#: Signs behind a word that stand for no letter.
STOPS = frozenset(".,;:?")
LEAST_PRECISION, LEAST_DOCS, THRESHOLD = 0.85, 4, 0.3
STEMS = (4, 5, 6, 7, 8)
#: Letters that signs commonly stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c"}
SWAP, DROP, DROP_SIGN, SHORTEN, DROP_SPACE = 1.0, 1.0, 4.0, 0.5, 1.0
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
LETTERS = re.compile(r"[^\W\d_]+")
REPEATED = re.compile(r"([^\W\d_])\1\1")
SIGN_RUN = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")


class CharacterModel:
    """An interpolated character trigram model of words; ^ and $ mark their ends."""

    def __init__(self, trigrams: dict[str, int]):
        self.three, self.two, self.one, self.context = dict(trigrams), Counter(), Counter(), Counter()
        for g, n in trigrams.items():
            self.two[g[1:]] += n
            self.one[g[2]] += n
            self.context[g[:2]] += n
        self.middle = Counter()
        for g, n in self.two.items():
            self.middle[g[0]] += n
        self.total = sum(self.one.values())
        self.known: dict[str, float] = {}

    def cost(self, before: str, c: str) -> float:
        """Minus the log probability of a character after two others."""
        g = before + c
        got = self.known.get(g)
        if got is None:
            p1 = (self.one[c] + 0.1) / (self.total + 30)
            p2 = (self.two[g[1:]] + 4 * p1) / (self.middle[g[1]] + 4)
            got = -math.log((self.three.get(g, 0) + 4 * p2) / (self.context[g[:2]] + 4))
            if len(self.known) < 1_000_000:
                self.known[g] = got
        return got


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, what it may stand for and at what cost."""
    out, i = [], 0
    while i < len(token):
        c, n = token[i], 1
        while i + n < len(token) and token[i + n] == c:
            n += 1
        i += n
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c, SHORTEN), (c + c, 0.0)])
        elif c in LEET:
            out.append([(x, SWAP) for x in LEET[c]] + [("", DROP_SIGN)] + ([(x + x, SWAP) for x in LEET[c]] if n > 1 else []))
        else:
            out.append([("", DROP)])
    return out


def decode(model: CharacterModel, token: str) -> str:
    """The likeliest word of a token's lattice: Viterbi over states of the last two characters."""
    states = {"^^": (0.0, None)}
    for options in lattice(token):
        fresh: dict[str, tuple] = {}
        for state, (cost, path) in states.items():
            for text, extra in options:
                total, here = cost + extra, state
                for c in text:
                    total += model.cost(here, c)
                    here = here[1] + c
                if here not in fresh or total < fresh[here][0]:
                    fresh[here] = (total, (path, text))
        states = fresh
    path = min((cost + model.cost(state, "$"), state) for state, (cost, _) in states.items())[1]
    path = states[path][1]
    parts = []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


def restored(model: CharacterModel, token: str) -> set[str]:
    """The words of a lower-cased token: its letters as they stand, and the decoded word if signs or repetition may hide one."""
    core = EDGES.sub("", token)
    if core.isalpha() and not REPEATED.search(core) and not any(c in LEET for c in token):
        return {core}
    out = set(LETTERS.findall(core))
    bare = SIGN_RUN.sub("", token)
    if sum(map(str.isalpha, bare)) >= 2:
        out.add(decode(model, bare))
        if bare != core and core:
            out.add(decode(model, core))
    return out


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)] if len(word) > 2 else []


def word_of(model: CharacterModel, token: str) -> str:
    """What a lower-cased token says to the tokens beside it: its letters, decoded if need be; a single character as it stands; nothing for numbers."""
    if len(token) == 1:
        return token
    core = EDGES.sub("", token)
    if core.isalpha():
        return core
    return decode(model, core) if any(map(str.isalpha, core)) else core if len(core) == 1 else ""


class Spaces(dict):
    """For (two letters before, single characters, two letters after), a tuple: what the characters stand for, and which spaces to drop.

    Viterbi over the last two characters and the choices so far. Nothing before or after: a word ends there.
    """

    def __init__(self, model: CharacterModel, limit: int = 200_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, key: tuple[str, tuple[str, ...], str]) -> tuple[tuple[str, ...], tuple[bool, ...]]:
        before, singles, after = key
        states = {before or "^^": (0.0, None)}
        for k, c in enumerate((*singles, after)):
            last = k == len(singles)
            if last and not after:
                states = {"": min(((cost + self.model.cost(state, "$"), (path, "", False)) for state, (cost, path) in states.items()), key=lambda x: x[0])}
                break
            options = [(c, 0.0)] if last or c.isalpha() else lattice(c)[0]
            fresh: dict[str, tuple] = {}
            for state, (cost, path) in states.items():
                ways = [(cost + self.model.cost(state, "$"), "^^", False)] if k or before else [(cost, state, False)]
                if k or before:
                    ways.append((cost + DROP_SPACE, state, True))
                for total, here, dropped in ways:
                    for text, extra in options:
                        sum_, end = total + extra, here
                        for x in text:
                            sum_ += self.model.cost(end, x)
                            end = end[1] + x
                        if end not in fresh or sum_ < fresh[end][0]:
                            fresh[end] = (sum_, (path, text, dropped))
            states = fresh
        path = min(states.values(), key=lambda x: x[0])[1]
        texts_, drops = [], []
        while path:
            path, text, dropped = path
            texts_.append(text)
            drops.append(dropped)
        if len(self) >= self.limit:
            self.clear()
        self[key] = got = (tuple(reversed(texts_[1:])), tuple(reversed(drops)))
        return got


def slices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about SLICE_BYTES characters."""
    part = pdf["text"].str.len().cumsum() // SLICE_BYTES
    for _, rows in pdf.groupby(part, sort=True):
        yield rows


def likeness(text: str) -> int:
    """The least hash of a text's 3-word shingles: near copies mostly share it, so that a group of them counts as a few documents."""
    tokens = text.split()
    shingles = [" ".join(x) for x in zip(tokens, tokens[1:], tokens[2:], strict=False)] or [text]
    return min(map(xxhash.xxh64_intdigest, shingles)) >> 1


def trigram_model(docs: DataFrame) -> CharacterModel:
    """The character model of the plain words of all documents, each task counting its own. All trigrams are kept: their number follows from the scripts."""

    def run(batches):
        counts: Counter = Counter()
        seen: Counter = Counter()

        def settle():
            for token, n in seen.items():
                word = EDGES.sub("", token)
                if word.isalpha():
                    marked = f"^^{word}$"
                    for k in range(len(marked) - 2):
                        counts[marked[k : k + 3]] += n
            seen.clear()

        for pdf in batches:
            for text in pdf["text"]:
                seen.update(text.lower().split())
                if len(seen) > 100_000:
                    settle()
        settle()
        yield pd.DataFrame({"gram": list(counts), "n": list(counts.values())}).astype({"gram": object, "n": np.int64})

    summed = docs.where("text is not null").select("text").mapInPandas(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return CharacterModel(dict(zip(summed["gram"].to_pylist(), summed["n"].to_pylist(), strict=True)))


class Evidence:
    """A character model, and the words and beginnings of words that speak for toxicity, each with its precision."""

    def __init__(self, model: CharacterModel, weights: dict[str, float], base: float):
        self.model, self.weights, self.base = model, weights, base
        self.known = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"} | {"known": None}

    def found(self, texts_: list[str]) -> list[set[str]]:
        if self.known is None:
            self.known = Features(self.model, self.weights)
        return self.known.of(texts_)

    def scores(self, texts_: list[str]) -> list[float]:
        """For each text the chance that the base rate or a piece of evidence holds."""
        return [1 - (1 - self.base) * math.prod(1 - self.weights[f] for f in sorted(found)) for found in self.found(texts_)]

    def score(self, text: str) -> float:
        return self.scores([text])[0]


class Features:
    """The features of texts, or those of them that are wanted. Texts are cut and numbered together, so that each distinct token is looked at once.

    A space between two longer words is decided by two letters on either side: such pairs of letters are numbered, and what was decided
    stands in a table; letters beyond MOST_PAIRS are asked for each time. What tokens, joined words and runs of single characters say is
    kept in bounded caches.
    """

    def __init__(self, model: CharacterModel, wanted=None):
        self.model, self.wanted = model, wanted
        self.heads = {f[:4] for f in wanted or ()}
        self.tokens, self.joins, self.spaces = TwoGenerations(self.make), TwoGenerations(self.make_joined), Spaces(model)
        self.pairs: dict[str, int] = {}
        self.letters: list[str] = []
        self.table = np.full((256, 256), -1, np.int8)

    def pair(self, letters: str) -> int:
        """The number of two letters; -1 if the table is full."""
        n = self.pairs.get(letters)
        if n is None:
            n = len(self.letters)
            if n >= MOST_PAIRS:
                return -1
            self.pairs[letters] = n
            self.letters.append(letters)
            if n >= len(self.table):
                wider = np.full((2 * len(self.table),) * 2, -1, np.int8)
                wider[: len(self.table), : len(self.table)] = self.table
                self.table = wider
        return n

    def make(self, tokens: list[str]) -> list[tuple]:
        out = []
        for t in tokens:
            word = t if t[-1:] not in STOPS else t[:-1]
            if word.isalpha() and len(word) > 1 and not REPEATED.search(word):  # letters, perhaps with a stop, have one path
                found = tuple(self.pick({word})) if self.may_tell(word) else ()
            else:
                word = word_of(self.model, t)
                found = tuple(self.pick(restored(self.model, t)))
            out.append((found, word, self.pair(word[-2:]), self.pair(word[:2])))
        return out

    def may_tell(self, word: str) -> bool:
        """Whether a word, or one that begins with it, can have a feature that is wanted: their first letters must be a wanted one's."""
        return self.wanted is None or word[:4] in self.heads if len(word) >= 4 else True

    def make_joined(self, words: list[str]) -> list[tuple]:
        return [tuple(self.pick({w})) for w in words]

    def pick(self, words: set[str]) -> set[str]:
        got = {f for w in words for f in features(w)}
        return got if self.wanted is None else {f for f in got if f in self.wanted}

    def dropped(self, before: str, after: str) -> bool:
        return self.spaces[before, (), after][1][0]

    def between_words(self, last: np.ndarray, first: np.ndarray, words: Callable[[int], tuple[str, str]]) -> np.ndarray:
        """Whether the space between two longer words is dropped, by the numbers of the letters beside it; words(i) gives the i-th pair."""
        out = np.zeros(len(last), bool)
        known = np.flatnonzero((last >= 0) & (first >= 0))
        open_ = known[self.table[last[known], first[known]] < 0]
        for key in np.unique(last[open_] * MOST_PAIRS + first[open_]).tolist():
            a, b = divmod(key, MOST_PAIRS)
            self.table[a, b] = self.dropped(self.letters[a], self.letters[b])
        out[known] = self.table[last[known], first[known]] == 1
        for i in np.flatnonzero((last < 0) | (first < 0)).tolist():
            a, b = words(i)
            out[i] = self.dropped(a[-2:], b[:2])
        return out

    def of(self, texts_: list[str]) -> list[set[str]]:
        """The features of each text: of its tokens, and of the words that come of dropping spaces between what they say."""
        out: list[set[str]] = [set() for _ in texts_]
        parts = pc.utf8_split_whitespace(pa.array([x.lower() for x in texts_], pa.large_string()))
        coded, bounds = parts.flatten().dictionary_encode(), parts.offsets.to_numpy().astype(np.int64)
        codes, text_of = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts_)), np.diff(bounds))
        if not len(codes):
            return out
        found, words, last, first = zip(*self.tokens.values_of_distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), strict=True)
        telling = np.fromiter(map(bool, found), bool, len(found))
        at = np.flatnonzero(telling[codes])
        for key in np.unique(text_of[at] * len(found) + codes[at]).tolist():
            text, code = divmod(key, len(found))
            out[text].update(found[code])
        size = np.fromiter(map(len, words), np.int64, len(words))[codes]
        said = lambda i: words[codes[i]]
        beside = text_of[1:] == text_of[:-1]
        at = np.flatnonzero(beside & (size[1:] > 1) & (size[:-1] > 1))
        drop = np.zeros(len(codes), bool)  # drop[i]: the space behind token i
        drop[at] = self.between_words(np.array(last, np.int64)[codes[at]], np.array(first, np.int64)[codes[at + 1]], lambda k: (said(at[k]), said(at[k] + 1)))
        single, meant = size == 1, {}
        opens = np.flatnonzero(single & np.r_[True, ~single[:-1] | ~beside])
        closes = np.flatnonzero(single & np.r_[~single[1:] | ~beside, True]) + 1
        for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
            before = said(a - 1)[-2:] if a and beside[a - 1] else ""
            after = said(b)[:2] if b < len(codes) and beside[b - 1] else ""
            letters, drops = self.spaces[before, tuple(said(i) for i in range(a, b)), after]
            meant.update(zip(range(a, b), letters, strict=True))
            for k, gone in enumerate(drops, a - 1):
                if gone and 0 <= k < len(beside) and beside[k]:
                    drop[k] = True
        edges = np.flatnonzero(np.diff(np.r_[False, drop, False]))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        if self.wanted is not None:
            spans = [(a, b) for a, b in spans if a in meant or self.may_tell(said(a))]
        joined = ["".join(meant[i] if i in meant else said(i) for i in range(a, b + 1)) for a, b in spans]
        for (a, _), got in zip(spans, self.joins.values_of(joined), strict=True):
            out[text_of[a]].update(got)
        return out


def fit(labelled: DataFrame, most: int = FIT_DOCS, corpus: DataFrame | None = None) -> Evidence:
    """Evidence from rows (doc_id, text, toxic), a bounded sample of them. Without toxic rows nothing is evidence.

    The character model is that of all rows of the corpus (text), labelled or not; without one, that of all labelled rows.

    A feature is evidence if its precision reaches LEAST_PRECISION and its likelihood ratio against the base rate outweighs the
    number of features tried, those of toxic documents. Toxic documents count once for each group of near copies; clean ones are
    searched only for what LEAST_DOCS groups have.
    """
    sample = checkpoint(bounded_sample(labelled.where("text is not null and toxic is not null"), most).select("text", F.col("toxic").cast("int").alias("toxic")))
    model = trigram_model(labelled if corpus is None else corpus)
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def hold(batches):
        known = Features(sent.value)
        for pdf in (part for pdf in batches for part in slices(pdf)):
            rows = {(h, f) for h, found in zip(map(likeness, pdf["text"]), known.of(pdf["text"].tolist()), strict=True) for f in ["", *found]}
            yield pd.DataFrame(rows, columns=["h", "feature"]).astype({"h": np.int64, "feature": object})

    groups = checkpoint(sample.where("toxic = 1").select("text").mapInPandas(hold, "h long, feature string").distinct())
    tried = groups.groupBy("feature").agg(F.count("*").alias("p"))
    often = {r["feature"]: r["p"] for r in tried.where((F.col("p") >= LEAST_DOCS) & (F.col("feature") != "")).collect()}
    n_tried, n_toxic, clean = tried.count(), groups.where("feature = ''").count(), sample.where("toxic <> 1").count()
    candidates = sample.sparkSession.sparkContext.broadcast(frozenset(often))

    def count(batches):
        counts: Counter = Counter()
        known = Features(sent.value, candidates.value)
        for pdf in (part for pdf in batches for part in slices(pdf)):
            for found in known.of(pdf["text"].tolist()):
                counts.update(found)
        yield pd.DataFrame({"feature": list(counts), "n": list(counts.values())}).astype({"feature": object, "n": np.int64})

    counted = sample.where("toxic <> 1").select("text").mapInPandas(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    seen = {r["feature"]: r["n"] for r in counted.collect()}
    rate = (n_toxic + 0.5) / (clean + n_toxic + 1)
    found = {}
    for f, p in often.items():
        n = seen.get(f, 0)
        precision = (p + 0.5) / (p + n + 1)
        ratio = p * math.log(precision / rate) + n * math.log((1 - precision) / (1 - rate))
        if precision >= LEAST_PRECISION and ratio >= math.log(n_tried + 1) + 1:
            found[f] = precision
    held: dict[str, set[int]] = defaultdict(set)
    for r in groups.where(F.col("feature").isin("", *found)).collect():
        held[r["feature"]].add(r["h"])
    toxic = held.pop("", set())
    weights, explained = {}, set()
    for f in sorted(found, key=lambda f: (-found[f], f)):  # one with false cases must explain what better ones don't
        if f not in seen or len(held[f] - explained) >= max(LEAST_DOCS, 5 * seen[f]):
            weights[f] = found[f]
            explained |= held[f]
    missed = len(toxic.difference(*(held[f] for f in weights)))
    return Evidence(model, weights, (missed + 0.5) / (clean + missed + 10))


def score(docs: DataFrame, evidence: Evidence, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, predicted) of whole texts. Null and empty texts have the base score."""
    sent = docs.sparkSession.sparkContext.broadcast(evidence)

    def make():
        def step(batch: dict) -> dict:
            got = sent.value.scores(batch["text"])
            return {"doc_id": batch["doc_id"], "score": got, "predicted": [int(x >= threshold) for x in got]}

        return step

    return arrow_map(texts(docs), make, "doc_id long, score double, predicted int")


def learned(docs: DataFrame, labels: DataFrame) -> Evidence:
    """Evidence from the labelled documents whose fold isn't held out; a document with several labels is toxic if one says so."""
    marks = labels.where((fold(of=4) != 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(docs.select("doc_id", "text").join(marks, "doc_id"), corpus=docs)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learned(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(of=4) == 2).alias("held_out"), "score", "predicted")


def clean_only(docs: DataFrame, evidence: Evidence, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is under the threshold, all columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast(evidence)

    def make():
        return lambda items: [x < threshold for x in sent.value.scores(items)]

    return keep_rows(docs, make)
