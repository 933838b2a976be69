"""What a hub keeps of rooms: every event once, the state of nudges that updates add up to, and the last events for who joins.

A stream's batches are folders by number, written over if a batch runs again, so events count once whatever fails in between. State and history
are read from them: both are aggregations, so nothing is held between batches, and a hot room is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY, SNAPSHOT = 1000, 300


def publish(events: DataFrame, path: str, checkpoint: str):
    """Starts a job that keeps a stream's events, stamped with when they came in, and ends when all that is there has been taken."""

    def put(batch: DataFrame, number: int) -> None:
        put_batch(batch, number, path)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def put_batch(batch: DataFrame, number: int, path: str) -> None:
    """One batch's events; the same number again takes their place."""
    batch.withColumn("received_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def latest_fields(updates: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The state that updates add up to: for each key each field's last value that isn't null."""
    place = F.struct(*order)
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields]
    return updates.groupBy(*keys).agg(*last)


def recent(events_: DataFrame, room: str, order: list[str], most: int = HISTORY) -> DataFrame:
    """The last `most` events of each room, with nth from 1, the newest. Ranks over `most` are dropped before rows are shuffled."""
    nth = F.row_number().over(Window.partitionBy(room).orderBy(*[F.col(o).desc() for o in order]))
    return events_.withColumn("nth", nth).where(F.col("nth") <= most)


def snapshot(events_: DataFrame, room: str, order: list[str], most: int = SNAPSHOT) -> DataFrame:
    """Rows (room, n, events) for who joins: the last events of each room, oldest first; at most `most` come together."""
    kept = recent(events_, room, order, most)
    body = F.struct("nth", F.to_json(F.struct(*[c for c in events_.columns if c != room])).alias("event"))
    ordered = F.transform(F.sort_array(F.collect_list(body), asc=False), lambda x: x["event"])
    return kept.groupBy(room).agg(F.count("*").alias("n"), ordered.alias("events"))
