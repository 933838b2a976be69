"""Language identification by bit-sliced Bloom filters of byte n-grams.

All languages share one table of bit masks: a place holds a bit for each language, in as many 64-bit words as the languages need. An
n-gram is looked up at PROBES places; what the masks have in common names, at once, every language that holds it. Per language, hits are
counted over the whole text and corrected for those that a filter of its fill gives by chance; the language with the largest corrected
share decides.

The filters are learned from a bounded sample of labelled documents: FIT_DOCS of each language, about, in order of a hash of doc_id, so
that a rare language is learned from all it has, however large the corpus. Spark counts their n-grams.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, keep_rows, table, texts

FIT_DOCS, LEAST_RATE, SHARE = 5_000, 3e-7, 0.2
COUNT_CHARS = 1 << 20
GRAM, PROBES, BITS_PER_GRAM = 4, 3, 16
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
SPACE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def byte_grams(text: str) -> np.ndarray:
    """4-byte n-grams of lower-cased text in which everything but letters is a single space."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(SPACE).split()) + b" ", np.uint8).astype(np.uint32)
    return raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:] if len(raw) >= GRAM else np.zeros(0, np.uint32)


def fold(doc_id="doc_id", of: int = 3):
    """crc32 of doc_id as text, modulo a number: the split into learning and held-out rows. A null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of doc_id: the same rows in any order or partitioning."""
    n = rows.count()
    share = min(1.0, most / max(n, 1))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows


def sample_by_language(rows: DataFrame, most: int) -> DataFrame:
    """About `most` rows of each language at most, chosen by a hash of doc_id: the same rows in any order or partitioning."""
    sizes = rows.groupBy("lang").agg(F.count("*").alias("_rows"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    return rows.join(sizes, "lang").where(place * F.col("_rows") < most).select(rows.columns)


def gram_counts(rows: DataFrame) -> DataFrame:
    """Rows (lang, gram, n) over rows (lang, text): counted in tasks, texts of COUNT_CHARS or a little more together, then summed."""

    def counted(lang: str, grams: list[np.ndarray]) -> pd.DataFrame:
        values, n = np.unique(np.concatenate(grams), return_counts=True)
        return pd.DataFrame({"lang": lang, "gram": values.astype(np.int64), "n": n})

    def run(batches):
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                held, size = [], 0
                for text in part["text"]:
                    held.append(byte_grams(text))
                    size += len(held[-1])
                    if size >= COUNT_CHARS:
                        yield counted(lang, held)
                        held, size = [], 0
                if held:
                    yield counted(lang, held)

    return rows.select("lang", "text").mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def has_letters(text: str) -> bool:
    return bool(LETTER.search(text))


class Filters:
    """Bit-sliced Bloom filters of n-grams by language, for any number of languages."""

    def __init__(self, members: dict[str, np.ndarray]):
        self.languages = sorted(members)
        total = sum(map(len, members.values()))
        self.shift = 64 - max(10, (BITS_PER_GRAM * max(total, 1) // max(len(members), 1)).bit_length())
        words = max(1, -(-len(self.languages) // 64))
        self.masks = np.zeros((words, 1 << 64 - self.shift), np.uint64)
        for i, lang in enumerate(self.languages):
            for place in self.places(members[lang].astype(np.uint32)):
                np.bitwise_or.at(self.masks[i // 64], place, np.uint64(1 << i % 64))
        fill = self.popcounts(self.masks) / self.masks.shape[1]
        self.chance = fill**PROBES

    def places(self, grams: np.ndarray) -> list[np.ndarray]:
        wide = grams.astype(np.uint64) + np.uint64(1)
        return [(wide * np.uint64(m) ^ (wide * np.uint64(m) >> np.uint64(31))) * np.uint64(m) >> np.uint64(self.shift) for m in MULTIPLIERS[:PROBES]]

    def popcounts(self, masks: np.ndarray) -> np.ndarray:
        """How many masks (words, places) have each language's bit."""
        out: list[int] = []
        for lane in range(-(-len(self.languages) // 8)):
            seen = np.bincount((masks[lane // 8] >> np.uint64(8 * (lane % 8)) & np.uint64(255)).astype(np.int64), minlength=256)
            out += [int(seen[np.arange(256) >> b & 1 == 1].sum()) for b in range(8)]
        return np.array(out[: len(self.languages)], np.float64)

    def shares(self, text: str) -> np.ndarray:
        """For each language, the share of the text's n-grams that it holds, corrected for chance."""
        grams = byte_grams(text)
        if not grams.size or not self.languages:
            return np.zeros(len(self.languages))
        a, b, c = self.places(grams)
        hits = self.popcounts(np.stack([m[a] & m[b] & m[c] for m in self.masks]))
        return np.maximum(0.0, (hits / len(grams) - self.chance) / np.maximum(1e-9, 1 - self.chance))

    def predict(self, text: str) -> tuple[str, float]:
        """(language, score): the score is the leading language's part of all corrected shares. Without letters: und, 0."""
        if not self.languages or not has_letters(text):
            return UNKNOWN, 0.0
        shares = self.shares(text)
        top = int(shares.argmax())
        return self.languages[top], float(shares[top] / shares.sum()) if shares.sum() > 0 else 0.0


def fit(labelled: DataFrame, most: int = FIT_DOCS) -> Filters:
    """Filters from rows (doc_id, text, lang), `most` of each language. A language holds an n-gram whose rate there is SHARE of the highest rate at least.

    N-grams of a rate below LEAST_RATE are left out, whatever the size of the sample.
    """
    sample = sample_by_language(labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang"), most)
    counts = gram_counts(sample)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rated.join(top, "gram").where((F.col("rate") >= LEAST_RATE) & (F.col("rate") >= SHARE * F.col("top"))).select("lang", "gram").toArrow()
    langs, grams = kept["lang"].to_numpy(), kept["gram"].to_numpy()
    order = np.argsort(langs, kind="stable")
    names, starts = np.unique(langs[order], return_index=True) if len(langs) else ([], [])
    return Filters({str(name): part for name, part in zip(names, np.split(grams[order], starts[1:]) if len(langs) else [], strict=True)})


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Rows (doc_id, lang_pred, score) of whole texts; null texts and texts without letters are und, with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        def step(batch: dict) -> dict:
            got = [sent.value.predict(x) for x in batch["text"]]
            return {"doc_id": batch["doc_id"], "lang_pred": [x for x, _ in got], "score": [x for _, x in got]}

        return step

    return arrow_map(texts(docs), make, "doc_id long, lang_pred string, score double")


def learned(docs: DataFrame) -> Filters:
    return fit(docs.where(fold() != 1).select("doc_id", "text", "lang"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learned(docs)).select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")


def with_language_only(docs: DataFrame, filters: Filters) -> DataFrame:
    """The documents that have a language, all columns kept: texts that are und (null, or without letters) go, and no others.

    That the filters know few of a text's n-grams, or none, is the sample's lack and no reason to drop it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        return lambda items: [has_letters(x) if not sent.value.languages else sent.value.predict(x)[0] != UNKNOWN for x in items]

    return keep_rows(docs, make)
