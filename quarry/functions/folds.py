"""Ordered folds over groups of rows that stream through a task: a group is never held, only its state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Fold(Protocol):
    """What a group is folded into, row by row."""

    def row(self, row) -> list[tuple]:
        """Rows that come of the group's next row."""

    def end(self) -> list[tuple]:
        """Rows that come of the group's end."""


def in_order(rows: DataFrame, keys: list[str], order: list[str], begin: Callable[[tuple], Fold], schema: str, move: bool = True) -> DataFrame:
    """Rows of each group, sorted by Spark, run through a fold of its own.

    One group is one task's work, sequential by its nature; what a task holds is an Arrow batch and one group's state. Rows of null
    keys are a group too. Without `move` a window brings groups together and leaves rows that stand together by some of the keys in
    their place; its number `nth` comes with the rows.
    """

    def plain(key: tuple) -> tuple:
        return tuple(None if pd.isna(k) else k for k in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, None
        for pdf in batches:
            at, out = [pdf.columns.get_loc(k) for k in keys], []
            for row in pdf.itertuples(index=False):
                here = plain(tuple(row[i] for i in at))
                if fold is None or here != key:
                    out += fold.end() if fold is not None else []
                    key, fold = here, begin(here)
                out += fold.row(row)
            yield pd.DataFrame(out, columns=columns, dtype=object)
        if fold is not None:
            yield pd.DataFrame(fold.end(), columns=columns, dtype=object)

    from pyspark.sql.types import _parse_datatype_string

    columns = _parse_datatype_string(schema).names
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    dealt = rows.repartition(*keys) if move else rows.withColumn("nth", nth)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
