"""Keyed machines on event time: a small state for each key, moved on by rows and by its own timers, over stored rows and over a stream.

A machine's state is a dictionary that JSON can hold. Before a row is taken, every timer that is due by its time goes off, in order, at the time
that it was set for; so what a key comes to doesn't depend on how its rows fall into batches, as long as they come in order of time.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.folds import in_order


class Machine(Protocol):
    """What a key's rows are run through. Rows have the columns at (seconds) and seq beside the machine's own."""

    state: dict

    def row(self, x) -> list[tuple]:
        """What comes of a row."""

    def due(self) -> float | None:
        """When the next timer goes off."""

    def fire(self) -> list[tuple]:
        """What comes of that timer, which is then gone or set later."""


def caught_up(machine: Machine, now: float) -> list[tuple]:
    """What comes of all timers up to now."""
    out: list[tuple] = []
    while (due := machine.due()) is not None and due <= now:
        out += machine.fire()
    return out


class _Replay:
    """The fold of one key's stored rows."""

    def __init__(self, key, machine: Machine):
        self.key, self.machine = key, machine

    def row(self, x) -> list[tuple]:
        return [(self.key, *r) for r in caught_up(self.machine, float(x.at)) + self.machine.row(x)]

    def end(self) -> list[tuple]:
        return [(self.key, *r) for r in caught_up(self.machine, math.inf)]


def replayed(rows: DataFrame, key: str, make: Callable[[], Machine], schema: str) -> DataFrame:
    """Stored rows, key by key in order of (at, seq); timers that outlast a key's rows go off at its end. schema begins with the key."""
    return in_order(rows, [key], ["at", "seq"], lambda k: _Replay(k[0], make()), schema)


class _Kept(StatefulProcessor):
    """A machine whose state is kept between batches, with one timer at its next due time."""

    def __init__(self, make: Callable[[], Machine], names: list[str]):
        self.make, self.names = make, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("machine", "text string")

    def load(self) -> Machine:
        machine = self.make()
        if self.held.exists():
            machine.state = json.loads(self.held.get()[0])
        return machine

    def save(self, machine: Machine) -> None:
        self.held.update((json.dumps(machine.state),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (due := machine.due()) is not None:
            self.handle.registerTimer(math.ceil(due * 1000))

    def frame(self, key, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in found], columns=self.names, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine, found = self.load(), []
        for x in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples(index=False):
            found += caught_up(machine, float(x.at)) + machine.row(x)
        self.save(machine)
        yield self.frame(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self.load()
        found = caught_up(machine, expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self.save(machine)
        yield self.frame(key, found)

    def close(self) -> None:
        pass


def streamed(rows: DataFrame, key: str, make: Callable[[], Machine], schema: str, late: str = "10 seconds") -> DataFrame:
    """The same over a stream, rows later than the watermark dropped; a timer goes off when the watermark passes it, or at the key's next row.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass), as every transformWithState job does.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    timed = rows.withColumn("event_time", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("event_time", late)
    return timed.groupBy(key).transformWithStateInPandas(_Kept(make, names), schema, "append", "eventTime")
