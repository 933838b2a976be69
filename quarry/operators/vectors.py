"""Exact nearest vectors: a stated set of queries, in blocks of a fixed size, against all rows.

Each task keeps the best k of its rows for each query of a block; those meet in one aggregation. Blocks bound what is sent to tasks;
a query's candidates are k for each task, whatever the number of rows. Scores are made in tiles of fixed size, whatever an Arrow batch holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
#: A tile of scores: so many queries by so many rows.
TILE, ROWS = 512, 1024


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


class _Best:
    """The best k rows for each of some queries, by score and then by smaller id; what lies behind the k-th is not looked at again."""

    def __init__(self, asked: np.ndarray, k: int, digits: int):
        self.asked, self.k, self.digits = asked, k, digits
        self.scores, self.ids = np.full((len(asked), k), -np.inf), np.full((len(asked), k), np.iinfo(np.int64).max)

    def add(self, own: np.ndarray, found: np.ndarray) -> None:
        for a in range(0, len(self.asked), TILE):
            score = np.round(self.asked[a : a + TILE] @ found.T, self.digits)
            last, last_id = self.scores[a : a + TILE, -1:], self.ids[a : a + TILE, -1:]
            query, row = np.nonzero((score > last) | ((score == last) & (own < last_id)))
            if len(query):
                self.merge(a, query, own[row], score[query, row])

    def merge(self, a: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """The queries that have a new candidate get the best of what they had and of the new ones."""
        touched = np.unique(query)
        at = np.concatenate([np.repeat(touched, self.k), query])
        ids = np.concatenate([self.ids[a + touched].ravel(), ids])
        scores = np.concatenate([self.scores[a + touched].ravel(), scores])
        order = np.lexsort((ids, -scores, at))
        begins = np.searchsorted(at[order], touched)
        best = order[(begins[:, None] + np.arange(self.k)).ravel()].reshape(-1, self.k)
        self.ids[a + touched], self.scores[a + touched] = ids[best], scores[best]


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """Rows (query, id, score, rank from 0) of the k best cosines, rounded, ties to the smaller id; rows (id, vector)."""
    spark = rows.sparkSession
    n = queries.count()
    blocks, out = max(1, -(-n // block)), None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vector").toPandas()
        if not len(part):
            continue
        sent = spark.sparkContext.broadcast((part["id"].to_numpy(), _unit(np.stack(part["vector"].to_numpy()).astype(np.float64))))

        def run(batches, sent=sent):
            ids, asked = sent.value
            best = _Best(asked, k, digits)
            for pdf in batches:
                for i in range(0, len(pdf), ROWS):
                    some = pdf.iloc[i : i + ROWS]
                    best.add(some["id"].to_numpy(), _unit(np.stack(some["vector"].to_numpy()).astype(np.float64)))
            for i in range(0, len(ids), TILE):
                kept = np.isfinite(best.scores[i : i + TILE]).ravel()
                yield pd.DataFrame({"query": np.repeat(ids[i : i + TILE], k)[kept], "id": best.ids[i : i + TILE].ravel()[kept], "score": best.scores[i : i + TILE].ravel()[kept]})

        near = rows.select("id", "vector").mapInPandas(run, "query long, id long, score double")
        out = near if out is None else out.union(near)
    if out is None:
        return spark.createDataFrame([], "query long, id long, score double, rank int")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", place - 1).where(F.col("rank") < k)
