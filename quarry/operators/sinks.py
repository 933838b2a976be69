"""Where results go: versioned tables, append-only logs, upserted state, JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, order: str = "record_id") -> None:
    """Records as JSON lines, ranged and sorted by id, so that files follow each other in order."""
    records.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").json(path)


def write_version(records: DataFrame, path: str, version: str) -> None:
    """Active records of a version, in a partition of their own that is made anew; other versions stay."""
    rows = records.where("status = 'active'").withColumn("kb_version", F.lit(version))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb_version").parquet(path)


def append_changes(changes: DataFrame, path: str, version: str) -> bool:
    """Appends added, updated and removed keys to a changelog; nothing if nothing changed."""
    changed = changes.where("change <> 'unchanged'").withColumn("kb_version", F.lit(version))
    if changed.isEmpty():
        return False
    changed.write.mode("append").parquet(path)
    return True


def with_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nested columns as JSON text, for stores that hold text."""
    return rows.withColumns({c: F.to_json(c) for c in columns})


def log_batches(stream: DataFrame, path: str, checkpoint: str):
    """A stream's batches appended to a JSON log, each once: a batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
