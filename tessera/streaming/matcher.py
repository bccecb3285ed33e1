"""The action matcher as a stream: state per session, links emitted as soon as they are known."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.matching import FIELDS, Matcher, Timing
from tessera.streaming.state import rows_in_order

LINKS = "session_id string, action_event_id string, network_event_id string, status string, score double, delta_ms double"
_EVENT = "sequence long, event_id string, time double, is_action boolean, target string, frame string, path string, method string, kind string, trusted boolean, gesture boolean"
_NAMES = [c.split()[0] for c in LINKS.split(", ")]


class _Follow(StatefulProcessor):
    """Queues of a session as list states, in the order in which their events came."""

    def __init__(self, timing: Timing, idle_ms: int) -> None:
        self.timing, self.idle_ms = timing, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.actions = handle.getListState("actions", _EVENT)
        self.waiting = handle.getListState("waiting", _EVENT)
        self.place = handle.getValueState("place", "last long, newest double, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queues = [[dict(zip(FIELDS, e)) for e in state.get()] if state.exists() else [] for state in (self.actions, self.waiting)]
        last, newest, timer = self.place.get() if self.place.exists() else (-1, -math.inf, -1)
        matcher = Matcher(self.timing, *queues, last=last, newest=newest)
        found, seen = [], timer - self.idle_ms
        for e in rows_in_order(rows, [*FIELDS, "at_ms"], ["sequence", "event_id"]):
            seen = max(seen, e.pop("at_ms"))
            found += [(key[0], *link) for link in matcher.observe(e)]
        for state, queue in ((self.actions, matcher.actions), (self.waiting, matcher.waiting)):
            if queue.all:
                state.put([tuple(e[c] for c in FIELDS) for e in queue.all])
            elif state.exists():
                state.clear()
        due = max(seen + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if timer >= 0:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.place.update((matcher.last, matcher.newest, due))
        yield pd.DataFrame(found, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A session without events for so long is over: its state goes."""
        for state in (self.actions, self.waiting, self.place):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def match_stream(events: DataFrame, timing: Timing | None = None, *, late: str = "10 minutes", idle: float = 86400.0) -> DataFrame:
    """Links from a stream of events (session_id, at, and FIELDS: sequence, event_id, time, is_action, target, frame,
    path, method, kind, trusted, gesture); at is the event time of the watermark.

    Events of a session are taken in the order of their sequence; one that is not above the last one
    taken is a repetition or late and is left out. A session whose last event is ``idle`` seconds behind the watermark
    leaves the state. Needs the RocksDB state store (``state.keyed_state`` sets it for a query).
    """
    ms = F.floor(F.unix_micros("at") / 1000).alias("at_ms")
    timed = events.withWatermark("at", late).select("session_id", "at", ms, *FIELDS)
    follow = _Follow(timing or Timing(), int(idle * 1000))
    return timed.groupBy("session_id").transformWithStateInPandas(follow, LINKS, "Append", "EventTime")
