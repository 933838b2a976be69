"""Recognizer events as utterances: interim guesses are replaced in place, and only a final moves a speaker on to the next utterance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .machines import replayed, streamed

COLUMNS = ["call", "seq", "at", "speaker", "text", "final", "confidence"]
OUT = "call long, seq long, at double, utterance_id string, speaker string, text string, final boolean, confidence double"


class Numbering:
    """How many finals each speaker of a call has had."""

    def __init__(self):
        self.state: dict = {}

    def row(self, x) -> list[tuple]:
        text = (x.text or "").strip()
        if not text:
            return []
        n = self.state.get(x.speaker, 0)
        self.state[x.speaker] = n + bool(x.final)
        return [(int(x.seq), float(x.at), f"{x.speaker}-{n}", x.speaker, text, bool(x.final), float(x.confidence or 1.0))]

    def due(self) -> None:
        return None

    def fire(self) -> list[tuple]:
        return []


def numbered(events: DataFrame) -> DataFrame:
    """Utterances of stored recognizer events (COLUMNS). Events without words are passed over; a confidence of zero or null is 1."""
    return replayed(events.select(*COLUMNS), "call", Numbering, OUT)


def stream(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    return streamed(events.select(*COLUMNS), "call", Numbering, OUT, late)


def transcript(utterances: DataFrame) -> DataFrame:
    """The latest of each utterance: its final, or the last guess while there is none."""
    latest = F.max_by(F.struct("text", "final", "confidence", "at"), F.struct("final", "at", "seq")).alias("u")
    return utterances.groupBy("call", "utterance_id", "speaker").agg(latest).select("call", "utterance_id", "speaker", "u.text", "u.final", "u.confidence", "u.at")
