"""Answers of a slow extractor, on time, late or lost.

A turn's extraction is waited for TIMEOUT_S; then the call goes on without it. What comes within LATE_S after that is merged into the call's
fields, but what it takes the customer to intend is past and let go of. What comes later still is lost, and counted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .machines import replayed, streamed

TIMEOUT_S, LATE_S = 1.5, 8.0
COLUMNS = ["call", "seq", "at", "kind", "turn", "intent", "updates"]
OUT = "call long, seq long, at double, turn long, path string, intent string, updates string, fields string, lost long"


class Extraction:
    """One call's fields, and the turns whose answers may still come: when each was asked, and whether the call has gone on."""

    def __init__(self, timeout: float, late: float):
        self.timeout, self.late = timeout, late
        self.state: dict = {"waiting": {}, "fields": {}, "lost": 0, "seq": 0}

    def told(self, at: float, turn: str, path: str, intent: str | None = None, updates: str | None = None) -> tuple:
        s = self.state
        return s["seq"], at, int(turn), path, intent, updates, json.dumps(s["fields"], sort_keys=True, ensure_ascii=False, separators=(",", ":")), s["lost"]

    def row(self, x) -> list[tuple]:
        s, at, turn = self.state, float(x.at), str(int(x.turn))
        s["seq"] = int(x.seq)
        if x.kind == "asked":
            s["waiting"][turn] = [at, False]
            return []
        asked = s["waiting"].pop(turn, None)
        if asked is None:
            return [self.told(at, turn, "unasked")]
        s["fields"] |= {k: v for k, v in json.loads(x.updates or "{}").items() if v is not None}
        return [self.told(at, turn, "late" if asked[1] else "on_time", None if asked[1] else x.intent, x.updates)]

    def ends(self, asked: list) -> float:
        return asked[0] + self.timeout + (self.late if asked[1] else 0.0)

    def due(self) -> float | None:
        return min(map(self.ends, self.state["waiting"].values()), default=None)

    def fire(self) -> list[tuple]:
        s = self.state
        turn = min(s["waiting"], key=lambda t: (self.ends(s["waiting"][t]), int(t)))
        at = self.ends(s["waiting"][turn])
        if s["waiting"][turn][1]:
            del s["waiting"][turn]
            s["lost"] += 1
            return [self.told(at, turn, "lost")]
        s["waiting"][turn][1] = True
        return [self.told(at, turn, "timeout")]


def extracted(rows: DataFrame, timeout: float = TIMEOUT_S, late: float = LATE_S) -> DataFrame:
    """Paths (on_time, timeout, late, lost, unasked) of stored rows (COLUMNS): kind is asked or result, updates a JSON object of fields.

    A result that comes after its turn is lost is unasked, as is one that no turn asked for: it changes nothing.
    """
    return replayed(rows.select(*COLUMNS), "call", lambda: Extraction(timeout, late), OUT)


def stream(rows: DataFrame, timeout: float = TIMEOUT_S, late: float = LATE_S, watermark: str = "10 seconds") -> DataFrame:
    """The same over a stream: timers end the wait for an answer, and the time in which it may still be merged."""
    return streamed(rows.select(*COLUMNS), "call", lambda: Extraction(timeout, late), OUT, watermark)


def merged_fields(paths: DataFrame) -> DataFrame:
    """Rows (call, field, value): the fields of each call after all that came in time to be merged."""
    last = paths.where("path in ('on_time', 'late')").groupBy("call").agg(F.max_by("fields", F.struct("at", "seq")).alias("fields"))
    return last.select("call", F.explode(F.from_json("fields", "map<string,string>")).alias("field", "value"))
