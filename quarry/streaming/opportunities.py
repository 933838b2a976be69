"""Openings that a customer gives and the agent takes up or misses, by call.

A customer's remark opens an opportunity of its kind unless the agent has covered that kind before, or one is open. What the agent says later
resolves it; each turn of theirs that doesn't, counts, however many utterances the turn has. After TURNS such turns or SECONDS it is
escalated, once. Where controls hold the coach's nudge back for being too soon or too many, it is tried again RETRY_S later.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame

from .machines import replayed, streamed
from .nudges import Controls, Room, consider

TURNS, SECONDS, RETRY_S = 2, 25.0, 9.0
COLUMNS = ["room", "seq", "at", "speaker", "raised", "addressed"]
OUT = "room long, seq long, at double, key string, event string, opened double, turns long"
#: Reasons of the controls that hold a nudge back only for now.
FOR_NOW = ("global_rate_limit", "max_active")
MISSED = "missed_opportunity"


class Opportunities:
    """The openings of one call: what is open of each kind, what has been covered, and who spoke last."""

    def __init__(self, turns: int, seconds: float, templates: dict | None, controls: Controls):
        self.turns, self.seconds, self.templates, self.controls = turns, seconds, templates, controls
        self.state: dict = {"open": {}, "covered": [], "last": None, "seq": 0, "coach": Room().text()}

    def row(self, x) -> list[tuple]:
        s, out, at = self.state, [], float(x.at)
        s["seq"] = int(x.seq)
        raised, addressed = (list(v) if v is not None else [] for v in (x.raised, x.addressed))
        if x.speaker == "agent":
            for key, o in list(s["open"].items()):
                if key in addressed:
                    out.append(self.told(key, at, "resolved"))
                    del s["open"][key]
                elif s["last"] != "agent":
                    o["turns"] += 1
            s["covered"] += [k for k in addressed if k not in s["covered"]]
            if self.templates:
                self.coach(lambda room: room.resolve([*addressed, MISSED] if out else addressed, "agent_addressed", at))
        else:
            for key in raised:
                if key not in s["covered"] and key not in s["open"]:
                    s["open"][key] = {"at": at, "turns": 0, "done": False, "retry": at}
                    out.append(self.told(key, at, "opened"))
        s["last"] = x.speaker
        return out + self.escalate(at)

    def told(self, key: str, at: float, event: str) -> tuple:
        o = self.state["open"][key]
        return self.state["seq"], at, key, event, o["at"], o["turns"]

    def ripe(self, o: dict) -> float:
        """When an open opportunity is to be escalated."""
        return max(o["retry"], o["at"] if o["turns"] >= self.turns else o["at"] + self.seconds)

    def escalate(self, now: float) -> list[tuple]:
        out = []
        for key, o in self.state["open"].items():
            if o["done"] or self.ripe(o) > now:
                continue
            o["done"] = True
            if self.templates and self.held(now):
                o["done"], o["retry"] = False, now + RETRY_S
            out.append(self.told(key, now, "escalated" if o["done"] else "held"))
        return out

    def coach(self, act):
        room = Room.of(self.state["coach"])
        found = act(room)
        self.state["coach"] = room.text()
        return found

    def held(self, now: float) -> bool:
        """Whether the controls hold the nudge back for now."""
        signal = SimpleNamespace(key=MISSED, at=now, seq=self.state["seq"], speaker="customer", source="rules", confidence=0.8, asr_confidence=1.0, words=99, noisy=False)
        return any(r[4] in FOR_NOW for r in self.coach(lambda room: room.expire(now) + consider(room, signal, self.templates, self.controls)))

    def due(self) -> float | None:
        return min((self.ripe(o) for o in self.state["open"].values() if not o["done"]), default=None)

    def fire(self) -> list[tuple]:
        return self.escalate(self.due())


def tracked(said: DataFrame, turns: int = TURNS, seconds: float = SECONDS, templates: dict | None = None, controls: Controls = Controls()) -> DataFrame:
    """Events (opened, resolved, escalated, held) over stored utterances (COLUMNS: the kinds that a customer raises, those that the agent addresses).

    With templates, escalations go through the controls of nudges, in the call's own state, and are held and tried again.
    """
    return replayed(said.select(*COLUMNS), "room", lambda: Opportunities(turns, seconds, templates, controls), OUT)


def stream(said: DataFrame, turns: int = TURNS, seconds: float = SECONDS, templates: dict | None = None, controls: Controls = Controls(), late: str = "10 seconds") -> DataFrame:
    """The same over a stream: a timer stands at the next escalation or retry, so a call that has fallen silent escalates too."""
    return streamed(said.select(*COLUMNS), "room", lambda: Opportunities(turns, seconds, templates, controls), OUT, late)
