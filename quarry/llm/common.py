"""What the operators of this subpackage share: table access, Arrow maps and shared-folder checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.storage import checkpoint, shared_dir, shared_path  # noqa: F401

SLICE_BYTES = 4 << 20
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over columns as Python lists. make() runs once a task and gives the function that maps a slice of a batch.

    Slices hold about SLICE_BYTES, however long the rows are; results leave slice by slice.
    """
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(struct)
        step = make()
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = step({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, struct)


def texts(docs: DataFrame, *keep: str, as_bytes: bool = False) -> DataFrame:
    """doc_id, the columns kept and text (null: empty), without what else the table holds."""
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else F.lit("")
    return docs.select("doc_id", *keep, (text.cast("binary") if as_bytes else text).alias("text"))


#: Bytes of an entry beside its key's and value's own.
ENTRY = 100


def size_of(x) -> int:
    """Bytes or characters of a key or value, about."""
    if isinstance(x, (str, bytes)):
        return len(x)
    return sum(map(size_of, x)) if isinstance(x, tuple) else 8


class TwoGenerations(dict):
    """A cache bounded in entries and in bytes: what was not used since the last change of generations goes.

    `make(keys)` gives the values of keys that are not known; None is no value.
    """

    def __init__(self, make: Callable[[list], list], limit: int = 200_000, most_bytes: int = 64 << 20):
        super().__init__()
        self.make, self.limit, self.most_bytes, self.held, self.old = make, limit, most_bytes, 0, {}

    def values_of(self, keys: list) -> list:
        """The value of each key, in order."""
        distinct = list(dict.fromkeys(keys))
        known = dict(zip(distinct, self.values_of_distinct(distinct), strict=True))
        return list(map(known.__getitem__, keys))

    def values_of_distinct(self, keys: list) -> list:
        """The value of each key, in order; no key stands twice."""
        if len(self) > self.limit or self.held > self.most_bytes:
            self.old, self.held = dict(self) if self.held <= 2 * self.most_bytes else {}, 0
            self.clear()
        got = list(map(self.get, keys))
        missing = []
        for i in [i for i, v in enumerate(got) if v is None]:
            value = self.old.get(keys[i])
            if value is None:
                missing.append(i)
            else:
                got[i] = self[keys[i]] = value
        if missing:
            fresh = [keys[i] for i in missing]
            made = self.make(fresh)
            self.update(zip(fresh, made, strict=True))
            self.held += ENTRY * len(fresh) + sum(map(size_of, fresh)) + sum(map(size_of, made))
            for i, value in zip(missing, made, strict=True):
                got[i] = value
        return got


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of docs whose text (null: empty) passes; all columns stay, no shuffle. make() runs once a task and gives a function of texts."""
    place = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield part.filter(pa.array(passes([x or "" for x in part.column(place).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
