"""Events as they come: appended once each to dated files, with open requests as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.state import use_keyed_state


def read_event_files(spark: SparkSession, path: str, schema: str, *, files: int = 64, kind: str = "json") -> DataFrame:
    """A stream of the event files under ``path``; a batch takes ``files`` of them at most, so a backlog is worked off in steps."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def append_events(events: DataFrame, path: str, checkpoint: str, *, late: str = "10 minutes", available_now: bool = True) -> StreamingQuery:
    """Write a stream of events (event_id, observed_at, ..) as JSON by day; a repeated event_id within ``late`` is dropped."""
    timed = events.withColumn("_at", F.to_timestamp("observed_at")).withWatermark("_at", late)
    once = timed.dropDuplicatesWithinWatermark(["event_id"]).withColumn("day", F.date_format("_at", "yyyy-MM-dd")).drop("_at")
    sink = once.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append")
    return (sink.trigger(availableNow=True) if available_now else sink).start()


_OUT = "session_id string, request_id string, method string, url_path string, status_code int, hops int, outcome string, seconds double"
_ROW = Row(*[c.split()[0] for c in _OUT.split(", ")])
_FIELDS = ["sequence", "at_ms", "event_type", "method", "url_path", "status_code", "monotonic_time"]
_OPEN = "requests array<struct<session_id string, request_id string, method string, url_path string, status_code int, hops int, started double, last double, due long>>"
#: Groups of requests that share a value of state and a timer. Fixed: a checkpoint holds the groups.
BUCKETS = 1024


def _first(requests: dict[tuple, tuple]) -> int | None:
    """When the first of the requests is given up."""
    return min((r[-1] for r in requests.values()), default=None)


class _Follow(StatefulProcessor):
    """Open requests of a bucket: what each asks for, its status so far, its hops, its start, and when it is given up.

    A batch reads and writes a bucket's requests as one value, however many of them it has frames of. The timer is the
    first one's time.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def _load(self) -> dict[tuple, tuple]:
        found = self.open.get()
        return {tuple(r)[:2]: tuple(r)[2:] for r in found[0]} if found else {}

    def _keep(self, requests: dict[tuple, tuple], before: int | None) -> None:
        """Put ``requests`` into the state and the timer at the first of them, instead of the one ``before``."""
        first = _first(requests)
        if before is not None and before != first:
            self.handle.deleteTimer(before)
        if first is not None and before != first:
            self.handle.registerTimer(first)
        if requests:
            self.open.update(([(*name, *r) for name, r in requests.items()],))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        requests = self._load()
        before = _first(requests)
        done, seen, frames = [], {}, []  # seen: the last time of each request that the batch names, its state's included
        for row in rows:
            name = row["session_id"], row["request_id"]
            if name not in seen:
                seen[name] = (requests[name][-1] if name in requests else -1) - self.idle_ms
            if row["sequence"] is not None:
                frames.append((name, *(row[c] for c in _FIELDS)))
        for name, _, at_ms, kind, verb, path, code, now in sorted(frames, key=lambda f: f[1]):
            method, url_path, status, hops, started, _, due = requests.get(name) or (None,) * 7
            seen[name] = max(seen[name], at_ms)
            if kind == "http.request":
                hops, started = (0, now) if due is None else (hops + 1, started)
                requests[name] = (verb, path, None, hops, started, now, 0)  # its time is known after the last frame
            elif due is not None and kind == "http.response":
                requests[name] = (method, url_path, code, hops, started, now, due)
            elif due is not None and kind in ("http.finished", "http.failed"):
                done.append(_ROW(*name, method, url_path, status, hops, kind[5:], now - started))
                del requests[name]
        least = timerValues.getCurrentWatermarkInMs() + 1
        for name, at_ms in seen.items():
            if name in requests:
                requests[name] = (*requests[name][:-1], max(at_ms + self.idle_ms, least))
        if requests or before is not None:
            self._keep(requests, before)
        return iter(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Gives up all requests of the bucket whose time is over."""
        requests, now = self._load(), timerValues.getCurrentWatermarkInMs()
        over = [(name, requests.pop(name)) for name in [n for n, r in requests.items() if r[-1] <= now]]
        self._keep(requests, None)  # the timer that expired goes by itself
        return iter([_ROW(*name, method, path, status, hops, "open", last - started) for name, (method, path, status, hops, started, last, _) in over])

    def close(self) -> None:
        pass


def finished_requests(events: DataFrame, *, late: str = "10 minutes", idle: float = 3600.0) -> DataFrame:
    """A row for each request of a stream of network events when it finishes, fails, or is given up.

    ``events``: session_id, request_id, sequence, at (timestamp; without it the monotonic time is taken), event_type, method, url_path,
    status_code, monotonic_time.
    A request is remembered from its first frame to its last; a redirect is a further hop of it. One whose last frame
    is ``idle`` seconds behind the watermark is given up, with outcome "open". Frames of a request that isn't open say
    nothing. State lies in BUCKETS by hash of the request, so a batch costs a few calls of the state a bucket and not
    a request; a task holds the frames that a batch has of a bucket. The session's queries keep their state in RocksDB from here on.
    """
    use_keyed_state(events.sparkSession)
    events = events if "at" in events.columns else events.withColumn("at", F.timestamp_seconds("monotonic_time"))
    ms = F.floor(F.unix_micros("at") / 1000).alias("at_ms")
    bucket = F.pmod(F.xxhash64("session_id", "request_id"), F.lit(BUCKETS)).alias("bucket")
    timed = events.withWatermark("at", late).select(bucket, "session_id", "request_id", "at", ms, *[c for c in _FIELDS if c != "at_ms"])
    return timed.groupBy("bucket").transformWithState(_Follow(int(idle * 1000)), _OUT, "Append", "EventTime")
