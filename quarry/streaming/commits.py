"""When a caller's turn is over: each pause is held open for a time that depends on how their words end, and new speech cancels it.

What was last heard counts, for WINDOW_S. A pause without words waits for the recognizer once. A short agreement is discarded while the
agent speaks, and otherwise is an answer: at once if a yes or no was asked for, later if more may follow. Whole words of a turn that
come again as the recognizer's final, within AGAIN_S of its commitment, are not another turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import turns
from .machines import replayed, streamed

WINDOW_S, AGAIN_S = 5.0, 3.0
#: Seconds of silence after the voice detector's own, by what was heard.
HOLDS = {"empty": 0.6, "yes_no": 0.4, "incomplete": 0.8, "backchannel": 0.8, "unknown": 1.0, "complete": 0.0}
COLUMNS = ["call", "seq", "at", "kind", "text", "agent_speaking", "yes_no", "paused"]
OUT = "call long, seq long, at double, decision string, text string"


class Turns:
    """One call's pending decision, what was last heard and what was last committed."""

    def __init__(self):
        self.state: dict = {"heard": None, "speaking": False, "pending": None, "done": None, "agent": False, "yes_no": False, "paused": False, "seq": 0}

    def row(self, x) -> list[tuple]:
        s, at, out = self.state, float(x.at), []
        s["seq"] = int(x.seq)
        for name, value in (("agent", x.agent_speaking), ("yes_no", x.yes_no), ("paused", x.paused)):
            s[name] = bool(value)
        if x.kind in ("start", "end"):
            s["speaking"] = x.kind == "start"
            if s["pending"]:
                out.append((s["seq"], at, "cancelled", self.words(at)))
            s["pending"] = None
            return out if s["speaking"] else out + self.decide(at)
        final = x.kind == "final"
        if final and s["done"] and at - s["done"][0] < AGAIN_S and f" {x.plain} " in f" {s['done'][1]} ":
            return []
        s["heard"] = [at, x.text, x.ending, x.plain]
        return self.decide(at) if final and x.plain and not s["speaking"] and not s["pending"] else []

    def words(self, now: float) -> str:
        heard = self.state["heard"]
        return heard[1].strip() if heard and heard[0] >= now - WINDOW_S else ""

    def wait(self, now: float, why: str) -> list[tuple]:
        self.state["pending"] = [now + HOLDS[why], why]
        return []

    def decide(self, now: float) -> list[tuple]:
        return self.settle(now) if self.words(now) else self.wait(now, "empty")

    def settle(self, now: float) -> list[tuple]:
        s, ending = self.state, self.state["heard"][2]
        agrees = ending == "backchannel"
        if s["paused"] or agrees and s["agent"]:
            said, s["heard"] = self.words(now), None
            return [(s["seq"], now, "discarded", said)]
        why = "yes_no" if agrees and s["yes_no"] else ending
        return self.wait(now, why) if HOLDS[why] else self.commit(now)

    def commit(self, now: float) -> list[tuple]:
        s = self.state
        said, s["done"] = self.words(now), [now, s["heard"][3]]
        s["heard"] = None
        return [(s["seq"], now, "committed", said)]

    def due(self) -> float | None:
        return self.state["pending"][0] if self.state["pending"] else None

    def fire(self) -> list[tuple]:
        now, why = self.state["pending"]
        self.state["pending"] = None
        if why != "empty":
            return self.commit(now) if self.words(now) else []
        return self.settle(now) if self.words(now) else []


def prepared(heard: DataFrame) -> DataFrame:
    """Adds how a text ends and its plain words. kind is start, end (of speech), interim or final (of a transcript)."""
    text = F.coalesce("text", F.lit(""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+", " "))
    return heard.select(*[F.col(c) for c in COLUMNS if c != "text"], text.alias("text"), turns.fast_class(F.trim(text)).alias("ending"), plain.alias("plain"))


def committed(heard: DataFrame) -> DataFrame:
    """Decisions (committed, discarded, cancelled) over stored events (COLUMNS)."""
    return replayed(prepared(heard), "call", Turns, OUT)


def stream(heard: DataFrame, late: str = "10 seconds") -> DataFrame:
    """The same over a stream: a timer stands at the end of the pause that is held open, and new speech takes it away."""
    return streamed(prepared(heard), "call", Turns, OUT, late)
