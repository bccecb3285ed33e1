"""Session manifests from a stream of events: a session is closed once, by its end or by silence."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.state import keyed_state

#: Most warnings of a session. Fixed value.
WARNINGS = 1000
#: How a session can end. Fixed values.
ENDED = ("completed", "cancelled", "failed")
MANIFEST = """schema_version string, session_id string, started_at string, ended_at string, status string, event_files array<string>,
  artifact_count bigint, event_count bigint, warnings array<string>"""
_NAMES = ["schema_version", "session_id", "started_at", "ended_at", "status", "event_files", "artifact_count", "event_count", "warnings"]
_ROW = Row(*_NAMES)
#: Artifacts of a session that are kept in its value.
INLINE = 256


class _Close(StatefulProcessor):
    """Keeps of an open session its first and last event, its files, artifacts and warnings; of a closed one that it is closed.

    A session is one value, which is read and written once a batch; only artifacts beyond INLINE lie beside it, key by key.
    """

    def __init__(self, idle_ms: int, silent: str) -> None:
        self.idle_ms, self.silent = idle_ms, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "first long, last long, last_sequence long, events long, artifacts long, timer long, closed boolean, files array<string>, refs array<string>, warnings array<string>")
        self.more = handle.getMapState("more", "ref string", "sequence long")

    def _manifest(self, session: str, status: str, first: int, last: int, events: int, artifacts: int, files: list, warnings: list) -> Row:
        shown = [(datetime.fromtimestamp(ms // 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z") for ms in (first, last)]
        return _ROW("1.0", session, *shown, status, sorted(files), artifacts, events, list(warnings))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, last, last_sequence, events, artifacts, timer, closed, files, refs, warnings = self.place.get() or (-1, -1, -1, 0, 0, -1, False, [], [], [])
        files, refs, warnings = list(files), list(refs), list(warnings)
        seen = set(refs)
        for e in sorted((r for r in rows if r["sequence"] is not None), key=lambda r: r["sequence"]):
            if closed:  # a closed session takes no more events
                break
            if e["sequence"] <= last_sequence:
                continue
            last_sequence, events = e["sequence"], events + 1
            first = e["at_ms"] if first < 0 else min(first, e["at_ms"])
            last = max(last, e["at_ms"])
            if e["file"] is not None and e["file"] not in files:
                files.append(e["file"])
            for ref in e["refs"] or ():
                if ref is None or not ref.startswith("sha256:") or ref in seen:
                    continue
                seen.add(ref)
                if len(refs) < INLINE:
                    refs.append(ref)
                elif self.more.containsKey((ref,)):
                    continue
                else:
                    self.more.updateValue((ref,), (last_sequence,))
                artifacts += 1
            if e["warning"] is not None and len(warnings) < WARNINGS and e["warning"] not in warnings:
                warnings.append(e["warning"])
            if e["ended"] in ENDED:
                closed = True
                yield self._manifest(key[0], e["ended"], first, last, events, artifacts, files, warnings)
                self._forget(artifacts)
                files, refs, warnings, artifacts = [], [], [], 0
        due = max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.place.update((first, last, last_sequence, events, artifacts, due, closed, files, refs, warnings))

    def _forget(self, artifacts: int) -> None:
        if artifacts > INLINE:
            self.more.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, _, events, artifacts, _, closed, files, _, warnings = self.place.get()
        if not closed:
            yield self._manifest(key[0], self.silent, first, last, events, artifacts, files, warnings)
        self._forget(artifacts)
        self.place.clear()

    def close(self) -> None:
        pass


def session_manifests(events: DataFrame, *, late: str = "10 minutes", idle: float = 1800.0, silent: str = "failed") -> DataFrame:
    """A manifest of each session of a stream, when it ends: MANIFEST.

    ``events``: session_id, sequence, at (timestamp), file (where the event is written), refs (its artifacts), warning
    (or null), ended (completed, cancelled or failed in the event that ends the session, else null).

    A session ends with the first such event, in the order of sequences, and takes no more events; or it is
    closed as ``silent`` when the watermark is ``idle`` seconds behind its last event. Events of an earlier
    sequence than those taken are repetitions and not counted. Warnings are kept once each, the first WARNINGS.
    State of a session: its files, its artifacts' refs and its warnings, until it is closed; that it is closed,
    until it would have gone silent. Needs the RocksDB state store (``write_manifests`` sets it).
    """
    ms = F.floor(F.unix_micros("at") / 1000).alias("at_ms")
    timed = events.withWatermark("at", late).select("session_id", "at", "sequence", ms, "file", "refs", "warning", "ended")
    close = _Close(int(idle * 1000), silent)
    return timed.groupBy("session_id").transformWithState(close, MANIFEST, "Append", "EventTime")


def write_manifests(events: DataFrame, path: str, checkpoint: str, *, available_now: bool = True, **options) -> StreamingQuery:
    """Write the manifests of a stream of events as JSON lines by day of start, each session once.

    The files of a batch become visible together, and a restart from ``checkpoint`` goes on where the query was.
    """
    found = session_manifests(events, **options).withColumn("day", F.substring("started_at", 1, 10))
    sink = found.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append")
    with keyed_state(events.sparkSession):
        return (sink.trigger(availableNow=True) if available_now else sink).start()
