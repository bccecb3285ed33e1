"""Recorded protocol frames of a browser as normalised network events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import artifacts, text
from tessera.functions import normalise as N

#: Event type of each frame. Fixed values of the protocol.
TYPES = {
    "Network.requestWillBeSent": "http.request", "Network.responseReceived": "http.response", "Network.loadingFinished": "http.finished", "Network.loadingFailed": "http.failed",
    "Network.webSocketCreated": "websocket.created", "Network.webSocketFrameReceived": "websocket.frame.received", "Network.webSocketFrameSent": "websocket.frame.sent", "Network.webSocketClosed": "websocket.closed",
}
#: Headers that never leave the capture. Fixed values of the redaction policy.
DROP_HEADERS = (
    "authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "x-csrf-token", "x-xsrf-token", "sec-websocket-key", "sec-websocket-accept",
    "sec-websocket-protocol", "referer", "referrer", "location", "content-location", "link", "refresh",
)


def redact_headers(headers: Column, drop: tuple[str, ...] = DROP_HEADERS, fields: tuple[str, ...] = N.DROP_FIELDS) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*drop) & ~k.rlike("(?i)" + "|".join(fields)))


def value_lists(pairs: Column) -> Column:
    """Map of each key of an array of (key, value) to its values in their order."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"])))


def body_keys(body: Column, content_type: Column) -> Column:
    """Top-level names of a request body, sorted: of a JSON object, of all objects of a JSON list, or of a form.

    Null for no body, another type, or a body that can't be read: unknown is not empty.
    """
    of_list = F.from_json(body, "array<map<string,string>>")
    form = F.transform(N.query_pairs(body), lambda p: p["key"])
    is_json, is_list = content_type == "application/json", F.ltrim(body).startswith("[")
    raw = F.when(is_json & is_list, F.flatten(F.transform(of_list, F.map_keys))).when(is_json, F.json_object_keys(body)).when(content_type == "application/x-www-form-urlencoded", form)
    return N.key_set(raw)


def _open_sockets(rows: DataFrame) -> DataFrame:
    """Of the frames of sockets those between a first-party socket's creation and its end, with its URL.

    The state of a socket is what was last said of its id before the frame: an id that a socket of
    another party takes over is no longer known.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("session_id", "request_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    made, ended = F.col("event_type") == "websocket.created", F.col("event_type") == "websocket.closed"
    said = F.when(made | ended, F.struct((made & F.col("_own")).alias("open"), F.col("url").alias("url")))
    stated = rows.withColumn("_state", F.last(said, ignorenulls=True).over(before))
    kept = stated.where((made & F.col("_own")) | (~made & F.coalesce("_state.open", F.lit(False))))
    return kept.withColumn("url", F.coalesce("url", "_state.url")).drop("_state")


def network_events(frames: DataFrame, *hosts: str, policy: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Events of frames (session_id, sequence, frame as JSON text) of first-party requests and sockets.

    Frames after the first of a request carry only its id; they are first-party if its request was, so
    they meet it by an equality join. A redirect is the next request of the same id: hops are numbered.
    ``policy``: what is redacted, as registry.load_policy gives it. observed_at is the frame's wall time, or
    received_at where frames have that column and no wall time.
    """
    from pyspark.sql import Window

    drop_headers, drop = (policy["headers"], policy["fields"]) if policy else (DROP_HEADERS, N.DROP_FIELDS)
    get = lambda p: F.get_json_object("frame", p)
    kinds = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))])
    url = F.coalesce(get("$.params.request.url"), get("$.params.url"))
    wall = F.date_format(F.timestamp_micros((get("$.params.wallTime").try_cast("double") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    at = F.coalesce(wall, F.col("received_at")) if "received_at" in frames.columns else wall
    clock = get("$.params.timestamp").try_cast("double")
    raw = frames.select(
        "session_id", "sequence", kinds[get("$.method")].alias("event_type"), get("$.params.requestId").alias("request_id"), url.alias("url"), get("$.params.request.method").alias("verb"), at.alias("observed_at"),
        get("$.params.response.status").try_cast("int").alias("status_code"), F.when(clock >= 0, clock).alias("monotonic_time"), get("$.params.frameId").alias("frame_id"),
        F.from_json(F.coalesce(get("$.params.request.headers"), get("$.params.response.headers")), "map<string,string>").alias("headers"), get("$.params.request.postData").alias("body"),
        (get("$.params.hasUserGesture") == "true").alias("has_user_gesture"), get("$.params.errorText").alias("error_text"), N.content_type(get("$.params.response.mimeType")).alias("mime_type"),
        get("$.params.encodedDataLength").try_cast("double").alias("encoded_length"), get("$.params.response.opcode").try_cast("int").alias("websocket_opcode"),
        F.coalesce(N.first_party(N.url_host(url), *hosts), F.lit(False)).alias("_own"),
    ).where(F.col("event_type").isNotNull())
    http = raw.where(F.col("event_type").startswith("http."))
    known = http.where((F.col("event_type") == "http.request") & F.col("_own")).select("session_id", "request_id").distinct()
    mine = http.join(known, ["session_id", "request_id"], "left_semi").unionByName(_open_sockets(raw.where(F.col("event_type").startswith("websocket."))))
    hop = Window.partitionBy("session_id", "request_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = N.content_type(F.element_at(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == "content-type")), 1))
    return mine.select(
        "session_id", "sequence", F.lit("cdp.network").alias("source"), "event_type", "request_id", F.greatest(F.count_if(F.col("event_type") == "http.request").over(hop) - 1, F.lit(0)).alias("redirect_index"),
        N.method(F.col("verb")).alias("method"), F.when(F.col("url").isNotNull(), N.url_path(F.col("url"))).alias("url_path"), N.query_pairs(N.url_query(F.col("url")), drop=drop).alias("query"), "observed_at",
        "status_code", "monotonic_time", "frame_id", redact_headers(F.col("headers"), drop_headers, drop).alias("headers"), body_keys(F.col("body"), kind).alias("body_keys"),
        artifacts.ref(text.sanitised_body(F.col("body"), kind, drop)).alias("request_body_ref"), "has_user_gesture", "error_text", "mime_type", "encoded_length", "websocket_opcode",
    )
