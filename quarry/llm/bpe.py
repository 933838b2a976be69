"""Byte-level byte-pair encoding: ranks, exact splitting of texts, and merges on forests of segment trees.

A segment tree over the byte positions of a pre-token keeps, at its root, the leftmost of the lowest pair ranks. A merge
reads the root, joins two live neighbours, and updates three leaves and their ancestors. The trees of many short pre-tokens of
like length lie side by side in one array, so that each round makes one merge in each of them; a long one has a tree of its own.
"""

from __future__ import annotations

import base64
import functools
import json
from array import array

import numpy as np
import public_tokenizers
import regex

NONE = np.int64(1) << 60
#: Words of more bytes have a tree each, with so many children a node.
LONG, FAN = 512, 16
#: The splitting pattern with white space as Unicode defines it, as the tokenizer libraries read \s.
SPLIT = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: White space beyond ASCII, as Unicode defines it.
FAR_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = regex.compile(r" (?=\P{White_Space})")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins for bytes that .json vocabularies use: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ranks:
    """The merges of a vocabulary: sorted keys of pairs of ids, each with its rank and the id that it makes."""

    def __init__(self, tokens: list[bytes], pairs: dict[tuple[int, int], tuple[int, int]]):
        self.tokens, self.size = tokens, len(tokens)
        ids = {t: i for i, t in enumerate(tokens)}
        self.ids = ids
        self.byte_ids = np.array([ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        keys = np.fromiter((a * self.size + b for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        rank = np.fromiter((r for r, _ in pairs.values()), np.int64, len(pairs))
        made = np.fromiter((m for _, m in pairs.values()), np.int64, len(pairs))
        self.rank = np.append(rank[order], NONE)
        self.made = np.zeros(int(rank.max(initial=0)) + 1, np.int64)
        self.made[rank] = made
        self.pairs = pairs

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where the pair isn't merged."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NONE)


@functools.lru_cache(4)
def json_ranks(path: str) -> Ranks:
    """Merges of a tokenizers file: the rank is the place in its list of merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    symbols, vocab = byte_symbols(), model["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for word, i in vocab.items():
        tokens[i] = bytes(symbols[c] for c in word) if all(c in symbols for c in word) else word.encode()
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return Ranks(tokens, pairs)


@functools.lru_cache(4)
def tiktoken_ranks(path: str) -> Ranks:
    """Merges of a rank file: any two tokens whose bytes together are a token merge at that token's rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for word, i in ranks.items():
        tokens[i] = word
    pairs = {}
    for word, i in ranks.items():
        for cut in range(1, len(word)):
            a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
            if a is not None and b is not None:
                pairs[a, b] = (i, i)
    return Ranks(tokens, pairs)


def merge_forest(ranks: Ranks, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of at most width bytes, width a power of two: one flat array and the count of each word."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    byte = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
    place = np.arange(width)
    live = place < size[:, None]
    ids = np.where(live, ranks.byte_ids[byte], -1)
    after = np.broadcast_to(place + 1, (n, width)).copy()
    after[after >= size[:, None]] = width
    before = np.broadcast_to(place - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NONE, np.int64)
    pair = ranks.of(ids[:, :-1], ids[:, 1:])
    pair[ids[:, 1:] < 0] = NONE
    tree[:, width : 2 * width - 1] = np.where(pair < NONE, pair * width + place[:-1], NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
    row = np.flatnonzero(tree[1 :: 2 * width] < NONE)
    while row.size:
        best = tree[row * 2 * width + 1]
        at, made = best % width, ranks.made[best // width]
        base = row * width
        right = after[base + at]
        far = after[base + right]
        near = before[base + at]
        ids[base + at] = made
        ids[base + right] = -1
        after[base + at] = far
        has_far, has_near = far < width, near >= 0
        before[(base + far)[has_far]] = at[has_far]
        left_id = np.where(has_near, ids[base + np.maximum(near, 0)], 0)
        right_id = np.where(has_far, ids[np.minimum(base + far, ids.size - 1)], 0)
        found = ranks.of(np.concatenate([made, left_id]), np.concatenate([right_id, made]))
        own, other = found[: row.size], found[row.size :]
        own = np.where(has_far & (own < NONE), own * width + at, NONE)
        other = np.where(has_near & (other < NONE), other * width + near, NONE)
        root = row * 2 * width
        tree[root + width + right] = NONE
        tree[root + width + at] = own
        tree[(root + width + near)[has_near]] = other[has_near]
        node = np.concatenate([width + right, width + at, width + np.where(has_near, near, at)]) >> 1
        roots = np.concatenate([root, root, root])
        while node[0]:
            tree[roots + node] = np.minimum(tree[roots + 2 * node], tree[roots + 2 * node + 1])
            node = node >> 1
        row = row[tree[root + 1] < NONE]
    ids = ids.reshape(n, width)
    kept = ids >= 0
    return ids[kept], kept.sum(1)


def merge_one(ranks: Ranks, word: bytes) -> np.ndarray:
    """Ids of one long word: the same tree, FAN children a node, in flat arrays. A merge costs a few steps for each level, whatever the length."""
    n, none, pairs = len(word), int(NONE), ranks.pairs
    ids = array("q", ranks.byte_ids[np.frombuffer(word, np.uint8)].tobytes())
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    first = np.frombuffer(ids, np.int64)
    pair = ranks.of(first[:-1], first[1:])
    leaves = np.where(pair < NONE, pair * n + np.arange(n - 1), NONE)
    levels = []
    while True:
        padded = np.full(-(-max(len(leaves), 1) // FAN) * FAN, NONE, np.int64)
        padded[: len(leaves)] = leaves
        levels.append(array("q", padded.tobytes()))
        if len(padded) == FAN:
            break
        leaves = padded.reshape(-1, FAN).min(1)
    del first, pair, leaves
    low, top = levels[0], levels[-1]
    while (best := min(top)) < none:
        rank, at = divmod(best, n)
        right = after[at]
        far, near = after[right], before[at]
        made = ids[at] = int(ranks.made[rank])
        ids[right] = -1
        after[at] = far
        own = none
        if far < n:
            before[far] = at
            own = pairs.get((made, ids[far]), (none,))[0]
        low[at] = own if own == none else own * n + at
        if right < n - 1:
            low[right] = none
        touched = {at // FAN, right // FAN}
        if near >= 0:
            own = pairs.get((ids[near], made), (none,))[0]
            low[near] = own if own == none else own * n + near
            touched.add(near // FAN)
        for level, above in zip(levels, levels[1:], strict=False):
            for node in touched:
                above[node] = min(level[node * FAN : node * FAN + FAN])
            touched = {node // FAN for node in touched}
    kept = np.frombuffer(ids, np.int64)
    return kept[kept >= 0]


def encode_words(ranks: Ranks, words: list[bytes], cells: int = 1 << 19) -> list[np.ndarray]:
    """Ids of each word, a non-empty byte string, by merges alone. At most about `cells` tree leaves are held at once, or one word's."""
    out: list[np.ndarray | None] = [None] * len(words)
    by_width: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if len(word) == 1:
            out[i] = ranks.byte_ids[word[0] : word[0] + 1]
        elif len(word) > LONG:
            out[i] = merge_one(ranks, word)
        else:
            by_width.setdefault(1 << (len(word) - 1).bit_length(), []).append(i)
    for width, places in by_width.items():
        step = max(1, cells // width)
        for k in range(0, len(places), step):
            part = places[k : k + step]
            flat, count = merge_forest(ranks, [words[i] for i in part], width)
            for i, ids in zip(part, np.split(flat, np.cumsum(count)[:-1]), strict=True):
                out[i] = ids
    return out


def odd(text: str) -> bool:
    """Whether white space stands beside a space, or a space at either end, so that not every space cuts."""
    if "  " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or any(" " + c in text for c in "\t\r\x0b\x0c"):
        return True
    return not text.isascii() and any(c in text for c in FAR_SPACES)


def chunks(text: str) -> list[str]:
    """Parts of a text that the splitting pattern never joins; all but the first have lost a leading space.

    A space before a character that isn't white space always starts a pre-token. So single spaces cut a text exactly;
    where white space stands beside a space, only the last space of the run cuts.
    """
    return CUT.split(text) if odd(text) else text.split(" ")
