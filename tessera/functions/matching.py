"""The action matcher as a fold over the events of one session in the order of their sequence.

Batch and stream share it, so they agree whatever the clocks do. An event is taken if its sequence is
above that of the last one taken; its time only moves the window. What the window has left behind is
dropped from the head of each queue, and only there: an event behind a younger one stays until that one
goes. Each queue holds ``kept`` events at most, the oldest leave first.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

FIELDS = ["sequence", "event_id", "time", "is_action", "target", "frame", "path", "method", "kind", "trusted", "gesture"]
#: Actions and requests that a session keeps at most. Fixed value.
KEPT = 4096


@dataclass(frozen=True)
class Timing:
    """Window and score steps in seconds. The defaults are fixed values of the matcher."""

    window: float = 2.0
    near: float = 0.150
    close: float = 0.500
    late: float = 1.500

    def scaled(self, window: float) -> Timing:
        f = window / self.window
        return Timing(window, self.near * f, self.close * f, self.late * f)


def score(a: dict, r: dict, t: Timing) -> tuple[float, str | None, float]:
    """Score, status and distance in seconds of an action and a request; the status is None for pairs that can't be linked."""
    gap = abs(r["time"] - a["time"])
    frames = bool(a["frame"]) and bool(r["frame"])
    if not a["target"] or a["target"] != r["target"] or (frames and a["frame"] != r["frame"]) or gap > t.window:
        return 0.0, None, gap
    path = bool(a["path"]) and a["path"] == r["path"]
    method = bool(a["method"]) and bool(r["method"]) and a["method"].upper() == r["method"].upper()
    step = 0.30 if gap <= t.near else 0.22 if gap <= t.close else 0.10 if gap <= t.late else 0.0
    total = (0.25 if frames else 0.0) + step + (0.25 if path else 0.0) + (0.15 if method else 0.0) + (0.10 if r["gesture"] else 0.0)
    total = min(1.0, total + (0.05 if a["trusted"] else 0.0) + (0.05 if a["kind"] == "submit" and path and method else 0.0))
    if (path or r["gesture"]) and total >= 0.60:
        return total, "strong" if total >= 0.80 else "probable", gap
    return total, "temporal-only" if total >= 0.40 else None, gap


class _Queue:
    """Events in the order in which they came, also by target, so that only events of one target are compared."""

    def __init__(self, events: list[dict] = ()) -> None:
        self.all: deque[dict] = deque()
        self.ids: set[str] = set()
        self.of: dict[str, deque[dict]] = {}
        for e in events:
            self.add(e)

    def add(self, e: dict) -> bool:
        if e["event_id"] in self.ids:
            return False
        self.all.append(e)
        self.ids.add(e["event_id"])
        self.of.setdefault(e["target"], deque()).append(e)
        while len(self.all) > KEPT:
            self.drop_first()
        return True

    def drop_first(self) -> None:
        e = self.all.popleft()
        self.ids.discard(e["event_id"])
        own = self.of[e["target"]]
        own.popleft()
        if not own:
            del self.of[e["target"]]

    def prune(self, before: float) -> None:
        while self.all and self.all[0]["time"] < before:
            self.drop_first()

    def remove(self, event_id: str) -> None:
        """Take out the event with this id, if there is one."""
        if event_id not in self.ids:
            return
        e = next(x for x in self.all if x["event_id"] == event_id)
        self.all.remove(e)
        self.ids.discard(event_id)
        self.of[e["target"]].remove(e)


class Matcher:
    """Links of one session as its events come: (action id, request id, status, score, milliseconds).

    A request is linked to the best action that is known when it comes (higher score, then nearer, then
    higher id); one without goes to the first action after it that qualifies. An action can serve many requests.
    """

    def __init__(self, timing: Timing, actions: list[dict] = (), waiting: list[dict] = (), last: int = -1, newest: float = -math.inf) -> None:
        self.timing, self.last, self.newest = timing, last, newest
        self.actions, self.waiting = _Queue(actions), _Queue(waiting)

    def observe(self, e: dict) -> list[tuple]:
        time, sequence = e["time"], e["sequence"]
        if not e["event_id"] or sequence is None or sequence != sequence or time is None or not math.isfinite(time) or time < 0 or sequence <= self.last:
            return []
        self.last, self.newest = int(sequence), max(self.newest, time)
        for queue in (self.actions, self.waiting):
            queue.prune(self.newest - self.timing.window)
        found = []
        if e["is_action"]:
            if self.actions.add(e):
                for r in list(self.waiting.of.get(e["target"], ())):
                    total, status, gap = score(e, r, self.timing)
                    if status:
                        self.waiting.remove(r["event_id"])
                        found.append((e["event_id"], r["event_id"], status, round(total, 4), round(gap * 1000, 3)))
            return found
        known = [(total, -gap, a["event_id"], status) for a in self.actions.of.get(e["target"], ()) for total, status, gap in [score(a, e, self.timing)] if status]
        if not known:
            self.waiting.add(e)
            return []
        self.waiting.remove(e["event_id"])
        total, gap, action, status = max(known)
        return [(action, e["event_id"], status, round(total, 4), round(-gap * 1000, 3))]
