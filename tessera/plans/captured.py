"""Registered queries of captures, recorded sessions, pages and artifacts, over files that Spark makes of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import actions, artifacts, normalise, probes, recognise, text, wiki
from tessera.operators import datasets, market_pages, project
from tessera.plans import adapters as A
from tessera.plans.queries import _SITE, _event_stream, _route_sql, query
from tessera.sources import bodies, evidence, frames, har, parts
from tessera.sources.registry import translate_refs
from tessera.sources.shared import materialise, new_folder

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# Captures


def _captured(spark, d):
    """The pages as captures, one file a host, read back. Every second entry has no size, every third a zone in its time."""
    where = new_folder(spark, "captures")
    n = F.col("page_id")
    at = F.when(n % 3 == 0, F.lit("2024-01-01T03:00:00.1239+03:00")).otherwise(F.lit("2024-01-01T00:00:00.000Z"))
    coded = n % 5 == 0
    content = F.struct(
        F.lit("text/html; charset=utf-8").alias("mimeType"), F.when((n % 2 == 0) | coded, F.octet_length("html").cast("long")).alias("size"), F.when(coded, F.lit("base64")).alias("encoding"),
        F.when(coded, F.base64(F.col("html").cast("binary"))).otherwise(F.col("html")).alias("text"),
    )
    entry = F.struct(
        at.alias("startedDateTime"), F.lit("document").alias("_resourceType"), F.struct(F.lit("get").alias("method"), F.col("url").alias("url")).alias("request"),
        F.struct((F.lit(200) + n % 2).cast("int").alias("status"), content.alias("content")).alias("response"),
    )
    p = A.table(spark, d, "pages").select(normalise.url_host(F.col("url")).alias("host"), "page_id", entry.alias("entry"))
    listed = p.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "entry"))), lambda x: x["entry"]).alias("entries"))
    listed.select("host", F.to_json(F.struct(F.struct("entries").alias("log"))).alias("value")).write.partitionBy("host").text(where)
    return har.read_har(spark, f"{where}/*/*.txt", hosts=("example.org", "example.com"))


_P = r"""WITH p AS (SELECT *, regexp_replace(html, '\s', '', 'g') AS squeezed, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS raw FROM pages)"""


@query(_P + """
SELECT url, 'GET' AS method, CASE WHEN path = '' THEN '/' ELSE path END AS path, raw AS raw_query, 200 + page_id % 2 AS status, 'text/html' AS mime_type, CASE WHEN page_id % 3 = 0 THEN '2024-01-01T00:00:00.123Z' ELSE '2024-01-01T00:00:00.000Z' END AS started_at,
  strlen(html) AS response_size, sha256(html) AS body_sha256, regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '(^|\\.)example\\.(com|org)$') AS first_party FROM p
""")
def har_entries(spark, d):
    rows = _captured(spark, d)
    return rows.select("url", "method", "path", "raw_query", "status", "mime_type", "started_at", "response_size", F.sha2("body", 256).alias("body_sha256"), "first_party")


@query(_P + """, q AS (SELECT page_id, unnest(list_filter(string_split(raw, '&'), lambda x: x <> '')) AS pair, generate_subscripts(list_filter(string_split(raw, '&'), lambda x: x <> ''), 1) AS k FROM p)
SELECT page_id, split_part(pair, '=', 1) AS key, CASE WHEN contains(pair, '=') THEN url_decode(replace(substr(pair, length(split_part(pair, '=', 1)) + 2), '+', ' ')) ELSE '' END AS value FROM q QUALIFY row_number() OVER (PARTITION BY page_id, split_part(pair, '=', 1) ORDER BY k) = 1
""")
def query_first_values(spark, d):
    pairs = normalise.first_values(normalise.query_pairs(normalise.url_query(F.col("url"))))
    return A.table(spark, d, "pages").select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.key", "p.value")


@query(_P + r""", t AS (SELECT page_id, unnest([path, '/' || path, path || '?' || raw, substr(path, 2)]) AS token FROM p)
SELECT page_id, token, regexp_matches(token, '^/([^/?#\x00-\x1f\x7f][^?#\x00-\x1f\x7f]*)?$') AS valid FROM t
""")
def path_validate(spark, d):
    path = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    every = F.array(path, F.concat(F.lit("/"), path), F.concat(path, F.lit("?"), normalise.url_query(F.col("url"))), F.substring(path, 2, 1 << 20))
    return A.table(spark, d, "pages").select("page_id", F.explode(every).alias("token")).withColumn("valid", normalise.is_origin_path(F.col("token")))


@query(f"WITH {A.ENTRIES} SELECT capture, entry, path, sha256(html) AS html_sha256 FROM en WHERE first_party AND status = 200 AND NOT starts_with(path, '/wikihelp')")
def page_dataset(spark, d):
    e = A.entries(spark, d).withColumn("body", F.col("html").cast("binary")).withColumn("response_text_sha256", F.sha2("html", 256)).withColumn("started_at", F.lit("2024-01-01T00:00:00.000Z"))
    return datasets.build("pages", e, _SITE).select("capture", "entry", "path", "html_sha256")


@query("SELECT event_type AS capture, event_id AS entry, props AS data, sha256(props) AS sha256, event_id % 3 <> 0 AS is_json FROM (SELECT event_type, event_id, CASE WHEN event_id % 3 = 0 THEN props || '}' ELSE props END AS props FROM events)")
def json_dataset(spark, d):
    shown = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    e = A.table(spark, d, "events").select(F.col("event_type").alias("capture"), F.col("event_id").alias("entry"), F.lit("/api").alias("path"), F.create_map().cast("map<string,string>").alias("query"), F.lit(True).alias("first_party"), F.lit("application/json").alias("mime_type"), shown.alias("t"))
    rows = datasets.build("json-responses", e.withColumn("body", F.col("t").cast("binary")).withColumn("response_text_sha256", F.sha2("t", 256)), _SITE)
    return rows.select("capture", "entry", "data", "sha256", "is_json")


@query("""
SELECT p_name AS topic, p_brand AS capture, p_partkey AS entry, p_type || chr(10) || p_brand AS text, array_to_string(CASE WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand] END, ',') AS related
FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) = 1
""")
def wiki_topics(spark, d):
    link = lambda c: F.concat(F.lit('<a href="/wikihelp/topic/'), F.replace(F.col(c), F.lit("#"), F.lit("%23")), F.lit('">x</a>'))
    html = F.concat(F.lit('<font class="text"> '), "p_type", F.lit("<br>"), "p_brand", F.lit("<script>no()</script></font> " + wiki.MARKER + " "), link("p_type"), link("p_brand"), link("p_type"), F.lit('</table><a href="/wikihelp/topic/no">n</a>'))
    path = F.concat(F.lit("/wikihelp/topic/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("%20")))
    e = A.table(spark, d, "part").select(
        F.col("p_brand").alias("capture"), F.col("p_partkey").alias("entry"), F.concat(F.lit("https://x.example.org"), path).alias("url"), path.alias("path"), F.lit(True).alias("first_party"), F.lit("text/html").alias("mime_type"),
        F.lit(200).alias("status"), html.cast("binary").alias("body"), F.sha2(html, 256).alias("response_text_sha256"),
    )
    rows = datasets.build("wiki-topics", e, _SITE)
    return rows.select("topic", "capture", "entry", "text", F.array_join("related_topics", ",").alias("related"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_brand END AS topic FROM part")
def wiki_topic(spark, d):
    n, name = F.col("p_partkey") % 4, F.replace(F.col("p_name"), F.lit(" "), F.lit("%20"))
    of_query = F.concat(F.lit("https://x.example.org/wikihelp?x=1&topic="), F.url_encode(F.concat("p_name", F.lit(" "), "p_brand")))
    href = F.when(n == 0, F.concat(F.lit("/wikihelp/topic/"), name)).when(n == 1, of_query).when(n == 2, F.concat(F.lit("/help/topic/"), name)).otherwise(F.lit("/wikihelp?topic="))
    return A.table(spark, d, "part").select("p_partkey", wiki.topic(href).alias("topic"))


@query("SELECT s_suppkey, lower(trim(split_part(' ' || s_name || ' ; charset=utf-8', ';', 1))) AS content_type FROM supplier")
def content_types(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", normalise.content_type(F.concat(F.lit(" "), "s_name", F.lit(" ; charset=utf-8"))).alias("content_type"))


@query(r"SELECT page_id, pattern, count(*) AS n FROM (SELECT page_id, " + _route_sql("token") + r""" AS pattern FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs'), '<a [^>]*?href="(/(?:[^/"][^"]*)?)"', 1)) AS token FROM pages)) GROUP BY ALL""")
def link_inventory(spark, d):
    return probes.link_inventory(A.table(spark, d, "pages").select("page_id", "html"))


# Recorded sessions


@query(f"WITH {A.EVENTS} SELECT session_id, event_id, sequence, event_type FROM ev")
def recorded_events(spark, d):
    """Events written as JSON lines and read back after a look at files, sequences and ids."""
    where = new_folder(spark, "events")
    e = A.events(spark, d).select(
        "session_id", "event_id", "sequence", S("ts").alias("observed_at"), F.col("time").alias("monotonic_time"), "source", "event_type", F.lit("observed").alias("confidence"), F.lit("1.0").alias("schema_version")
    )
    e.write.json(where)
    files = f"{where}/*.json"
    return evidence.verified_events(spark, files, expected=evidence.snapshot_identity(spark, files)).select("session_id", "event_id", "sequence", "event_type")


@query(f"WITH {A.EVENTS}, m AS (SELECT session_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS started_at, CASE count(*) % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'cancelled' ELSE 'failed' END AS status, count(*) AS artifact_count FROM ev GROUP BY 1) SELECT * FROM m WHERE status <> 'failed'")
def finalised_sessions(spark, d):
    """Manifests of the sessions, written and read back, of those that ended well or were cancelled."""
    where = new_folder(spark, "manifests")
    kind = F.element_at(F.array(*map(F.lit, ("completed", "cancelled", "failed"))), (F.count("*") % 3 + 1).cast("int"))
    m = A.events(spark, d).groupBy("session_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"), kind.alias("status"), F.count("*").alias("artifact_count"))
    one = materialise(m.select("session_id", F.to_json(F.struct("session_id", "started_at", "status", "artifact_count")).alias("t")))
    # A file is a JSON list of some hundred manifests: a file for each session would cost more than what it says.
    listed = one.groupBy(F.pmod(F.xxhash64("session_id"), F.lit(one.count() // 500 + 1)).alias("of")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("t"), ","), F.lit("]")).alias("value"))
    listed.write.partitionBy("of").text(where)
    return evidence.read_manifests(spark, f"{where}/*/*.txt", finalised=True).select("session_id", "started_at", "status", "artifact_count")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row, (row_number() OVER (ORDER BY o_orderkey) - 1) // 60 AS part FROM orders")
def parts_read_back(spark, d):
    """Orders written in parts with a manifest and read back against it."""
    where = new_folder(spark, "parts")
    parts.write_parts(A.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), where, ["o_orderkey"])
    return parts.read_parts(spark, where, "o_orderkey bigint, o_orderpriority string").select("o_orderkey", "row", "part")


@query("SELECT DISTINCT 'sha256:' || sha256(coalesce(text, '')) AS ref FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE lang = 'en')")
def artifacts_to_put(spark, d):
    """Texts that a store of all English texts lacks."""
    docs = A.table(spark, d, "documents").select("lang", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    known = docs.where("lang = 'en'").select(artifacts.ref(F.col("content")).alias("ref"))
    return evidence.put_artifacts(known, docs.select("content")).select("ref")


@query("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS ref, strlen(coalesce(text, '')) AS size FROM documents")
def artifact_lookup(spark, d):
    """Every document's text by its digest, from the store of distinct texts."""
    docs = A.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    store = evidence.put_artifacts(spark.createDataFrame([], "ref string"), docs).withColumn("size", F.octet_length("content").cast("long"))
    return evidence.verified_artifacts(docs.select("doc_id", artifacts.ref(F.col("content")).alias("ref")), store, limit=1 << 30).select("doc_id", "ref", "size")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'src-' || l_suppkey || '#entry-' || l_linenumber ELSE 's' || l_orderkey || '#seq-' || l_linenumber END AS ref FROM lineitem")
def evidence_refs(spark, d):
    li, done = A.table(spark, d, "lineitem"), F.col("l_linestatus") == "F"
    rows = li.select("l_orderkey", "l_linenumber", F.when(done, S("l_suppkey")).alias("capture"), F.col("l_linenumber").alias("entry"), F.concat(F.lit("s"), S("l_orderkey")).alias("session_id"), F.col("l_linenumber").alias("sequence"))
    known = A.table(spark, d, "supplier").select(S("s_suppkey").alias("capture"), F.concat(F.lit("src-"), S("s_suppkey")).alias("source_id"))
    return translate_refs(rows, known).select("l_orderkey", "l_linenumber", "ref")


# Frames

_FRAMES = """fr AS (SELECT user_id::VARCHAR AS session_id, event_id AS sequence, 'r' || (json_extract_string(props, '$.k')::INTEGER % 7) AS request_id, event_id AS n,
  CASE event_type WHEN 'view' THEN 'http.request' WHEN 'click' THEN 'http.response' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'http.finished' ELSE 'websocket.frame.received' END
    WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'http.failed' ELSE 'websocket.closed' END ELSE 'websocket.created' END AS event_type, event_id % 3 <> 0 AS own FROM events)"""


def _frames(spark, d):
    n, kind = F.col("event_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    method = (
        F.when(kind == "view", "Network.requestWillBeSent").when(kind == "click", "Network.responseReceived")
        .when(kind == "purchase", F.when(n % 2 == 0, "Network.loadingFinished").otherwise("Network.webSocketFrameReceived"))
        .when(kind == "error", F.when(n % 2 == 0, "Network.loadingFailed").otherwise("Network.webSocketClosed")).otherwise("Network.webSocketCreated")
    )
    host = F.when(n % 3 != 0, F.lit("https://x.test/p/")).otherwise(F.lit("https://y.test/p/"))
    url = F.concat(host, S(n), F.lit("?q=1&token=2"))
    params = F.struct(
        F.concat(F.lit("r"), S(k % 7)).alias("requestId"), F.when(kind == "signup", url).alias("url"),
        F.when(kind == "view", F.struct(url.alias("url"), F.lit("post").alias("method"), F.create_map(F.lit("Content-Type"), F.lit("application/json"), F.lit("Cookie"), F.lit("c"), F.lit("X-K"), S(k), F.lit("authToken"), F.lit("t")).alias("headers"), F.col("props").alias("postData"))).alias("request"),
        F.when(kind == "click", F.struct((F.lit(200) + n % 4).alias("status"), F.lit("text/html; x").alias("mimeType"))).alias("response"),
        F.when(n % 2 == 0, F.unix_seconds(F.col("ts").cast("timestamp"))).alias("wallTime"),
    )
    return A.table(spark, d, "events").select(S("user_id").alias("session_id"), n.alias("sequence"), F.to_json(F.struct(method.alias("method"), params.alias("params"))).alias("frame"))


@query(f"""WITH {_FRAMES}, http AS (SELECT * FROM fr f WHERE starts_with(event_type, 'http.') AND EXISTS (SELECT 1 FROM fr g WHERE g.session_id = f.session_id AND g.request_id = f.request_id AND g.event_type = 'http.request' AND g.own)),
ws AS (SELECT *, last_value(CASE WHEN event_type = 'websocket.created' THEN CASE WHEN own THEN n::VARCHAR ELSE 'shut' END WHEN event_type = 'websocket.closed' THEN 'shut' END IGNORE NULLS) OVER (PARTITION BY session_id, request_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM fr WHERE starts_with(event_type, 'websocket.')),
every AS (SELECT session_id, sequence, request_id, event_type, CASE WHEN event_type = 'http.request' THEN '/p/' || n END AS url_path FROM http
  UNION ALL SELECT session_id, sequence, request_id, event_type, CASE WHEN event_type = 'websocket.created' THEN '/p/' || n ELSE '/p/' || state END FROM ws WHERE (event_type = 'websocket.created' AND own) OR (event_type <> 'websocket.created' AND coalesce(state, 'shut') <> 'shut'))
SELECT e.session_id, e.sequence, e.request_id, e.event_type, e.url_path, greatest(count(*) FILTER (e.event_type = 'http.request') OVER (PARTITION BY e.session_id, e.request_id ORDER BY e.sequence) - 1, 0) AS redirect_index,
  CASE WHEN e.event_type = 'http.request' THEN 'POST' END AS method, CASE WHEN e.event_type = 'http.response' THEN 200 + e.sequence % 4 END AS status_code, CASE WHEN e.event_type = 'http.request' THEN 'Content-Type,X-K' END AS headers,
  CASE WHEN e.event_type = 'http.request' THEN 'k' END AS body_keys, CASE WHEN e.event_type = 'http.request' THEN 'sha256:' || sha256('{{"k":' || json_extract_string(v.props, '$.k') || '}}') END AS request_body_ref,
  CASE WHEN e.event_type = 'http.response' THEN 'text/html' END AS mime_type, CASE WHEN e.sequence % 2 = 0 THEN strftime(date_trunc('second', v.ts), '%Y-%m-%dT%H:%M:%S.000Z') END AS observed_at FROM every e JOIN events v ON v.event_id = e.sequence""")
def network_events(spark, d):
    """The given events as protocol frames of requests and sockets, of two hosts of which one counts."""
    rows = frames.network_events(_frames(spark, d), "x.test")
    return rows.select(
        "session_id", "sequence", "request_id", "event_type", "url_path", "redirect_index", "method", "status_code", F.array_join(F.array_sort(F.map_keys("headers")), ",").alias("headers"),
        F.array_join("body_keys", ",").alias("body_keys"), "request_body_ref", "mime_type", "observed_at",
    )


@query(r"""
WITH b AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"k":' || k || '}' WHEN 1 THEN '[{"a":1,"k":' || k || '}]' WHEN 2 THEN 'x=' || k || '&x=3&y=a+b' END AS body FROM b
""")
def request_bodies(spark, d):
    n, k = F.col("event_id") % 5, F.get_json_object("props", "$.k")
    body = (
        F.when(n == 0, F.concat(F.lit('{"k": '), k, F.lit(', "accessToken": "t"}'))).when(n == 1, F.concat(F.lit('[{"k":'), k, F.lit(',"a":1,"csrf":2}]')))
        .when(n == 2, F.concat(F.lit("x="), k, F.lit("&password=1&y=a%20b&x=3"))).when(n == 3, F.concat(F.lit("["), k, F.lit("]"))).otherwise(F.col("props"))
    )
    kind = F.when(n == 2, F.lit("application/x-www-form-urlencoded")).when(n == 4, F.lit("text/plain")).otherwise(F.lit("application/json"))
    return A.table(spark, d, "events").select("event_id", text.sanitised_body(body, kind).alias("body"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Accept,X-' || event_type ELSE 'Accept' END AS headers FROM events")
def header_redaction(spark, d):
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("X-"), "event_type")).otherwise(F.concat(F.lit("session_token-"), "event_type"))
    given = F.create_map(F.lit("Accept"), F.lit("a"), F.lit("COOKIE"), F.lit("c"), F.lit("Set-Cookie"), F.lit("d"), F.lit("Location"), F.lit("l"), name, F.col("props"))
    return A.table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(frames.redact_headers(given))), ",").alias("headers"))


@query("""
SELECT event_id::VARCHAR AS session_id, CASE WHEN event_id % 7 = 0 THEN 'too large' WHEN event_id % 7 = 1 THEN 'no JSON' WHEN event_id % 7 = 2 THEN 'other schema' WHEN event_type NOT IN ('click', 'signup') THEN 'other kind' END AS problem
FROM events WHERE event_id % 7 < 3 OR event_type NOT IN ('click', 'signup')
""")
def rejected_actions(spark, d):
    n = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "click", "click").otherwise("hover")
    payload = F.to_json(F.struct(F.when(n % 7 == 2, 2).otherwise(1).alias("schema"), kind.alias("kind"), F.when(n % 7 == 0, F.repeat(F.lit("x"), 40_000)).alias("pad")))
    rows = A.table(spark, d, "events").select(S("event_id").alias("session_id"), F.lit(0).alias("sequence"), F.when(n % 7 == 1, F.concat(payload, F.lit("}"))).otherwise(payload).alias("payload"))
    return actions.rejected_actions(rows).select("session_id", "problem")


# Bodies and what they hold


def _page_requests(spark, d):
    """A finished request for every page, of a company or a unit, and the page as its body."""
    n = F.col("page_id")
    p = A.table(spark, d, "pages").select("page_id", "html").withColumn("session_id", F.concat(F.lit("s"), S(n % 5)))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    unit = n % 2 == 0
    query_ = F.array(pair("id", S(n + 1)), pair("tab", F.when(unit, "goods").otherwise("units")))
    common = [F.col("session_id"), F.concat(F.lit("r"), S(n)).alias("request_id"), F.lit(0).alias("redirect_index"), F.lit("t").alias("observed_at")]
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    asked = p.select(*common, (n * 3).alias("sequence"), F.lit("http.request").alias("event_type"), F.lit("GET").alias("method"), F.when(unit, recognise.GOODS_PATH).otherwise(recognise.ROSTER_PATH).alias("url_path"), query_.alias("query"), none("int", "status_code"), none("string", "mime_type"), none("double", "encoded_length"))
    pairs = none(asked.schema["query"].dataType, "query")
    told = p.select(*common, (n * 3 + 1).alias("sequence"), F.lit("http.response").alias("event_type"), none("string", "method"), none("string", "url_path"), pairs, F.when(n % 7 == 0, 404).otherwise(200).alias("status_code"), F.lit("text/html").alias("mime_type"), none("double", "encoded_length"))
    done = p.select(*common, (n * 3 + 2).alias("sequence"), F.lit("http.finished").alias("event_type"), none("string", "method"), none("string", "url_path"), pairs, none("int", "status_code"), none("string", "mime_type"), F.when(n % 11 == 0, 1e9).otherwise(1.0).alias("encoded_length"))
    coded = n % 3 == 0
    body = F.when(coded, F.base64(F.col("html").cast("binary"))).otherwise(F.col("html"))
    bodies_ = p.where("page_id % 13 <> 0").select("session_id", F.concat(F.lit("r"), S(n)).alias("request_id"), body.alias("body"), coded.alias("base64_encoded"))
    return asked.unionByName(told).unionByName(done), bodies_


@query("""
WITH p AS (SELECT page_id, 's' || page_id % 5 AS session_id, page_id * 3 + 2 AS sequence, CASE WHEN page_id % 11 = 0 THEN 'encoded size exceeds limit' WHEN page_id % 13 = 0 THEN 'no body' END AS problem FROM pages WHERE page_id % 7 <> 0)
SELECT session_id, sequence, CASE WHEN problem IS NULL THEN CASE WHEN page_id % 2 = 0 THEN 'unit-economics' ELSE 'company-roster' END END AS kind, problem,
  CASE WHEN problem IS NULL AND page_id % 2 = 0 THEN 'sha256:' || sha256('{"contract_version":1,"coverage":"observed","rows":[],"schema":"unit-economics/v1","unit_id":"' || (page_id + 1) || '"}') END AS goods_ref FROM p
""")
def body_capture(spark, d):
    """Body events of the pages' requests and the warnings for those without."""
    found = bodies.body_events(*_page_requests(spark, d))
    kind = F.col("response_body_kind")
    made = found["events"].select("session_id", "sequence", kind.alias("kind"), F.lit(None).cast("string").alias("problem"), F.when(kind == "unit-economics", F.col("response_body_ref")).alias("goods_ref"))
    none = F.lit(None).cast("string")
    return made.unionByName(found["warnings"].select("session_id", "sequence", none.alias("kind"), "problem", none.alias("goods_ref")))


def _goods_events(spark, d):
    """Body events of units: the goods that each order shows of its suppliers, and their artifacts."""
    li = A.table(spark, d, "lineitem")
    n, one = F.col("l_orderkey"), F.lit(1).cast("long")
    row = F.struct(
        one.alias("city_price"), F.lit(1.5).alias("city_quality"), one.alias("our_price"), (F.col("l_partkey") + 1).alias("product_numeric_id"), one.alias("profit"), one.alias("revenue"),
        F.col("l_quantity").cast("long").alias("sales_volume"), one.alias("stock_qty"), F.lit(0.5).alias("stock_quality"), one.alias("supply_cost"), one.alias("supply_qty"),
    )
    unit = F.col("l_suppkey") + 1
    kind = F.col("l_linenumber")
    text_ = F.when(kind == 2, artifacts.unit_economics_text(unit, F.array(row), "unit-economics/v0")).otherwise(artifacts.unit_economics_text(F.when(kind == 4, unit + 1).otherwise(unit), F.array(row)))
    rows = materialise(li.select(S(n).alias("session_id"), kind.alias("sequence"), S("l_shipdate").alias("observed_at"), unit.alias("unit"), text_.alias("content")).withColumn("ref", artifacts.ref(F.col("content"))))
    events = rows.select(
        "session_id", "sequence", "observed_at", F.lit("http.response_body").alias("event_type"), F.lit("cdp.network").alias("source"), F.lit("GET").alias("method"), F.lit(200).alias("status_code"), F.lit(recognise.GOODS_PATH).alias("url_path"),
        F.map_from_arrays(F.array(F.lit("id"), F.lit("tab")), F.array(F.array(S("unit")), F.array(F.when(F.col("sequence") == 5, "orders").otherwise("goods")))).alias("query"), F.col("ref").alias("response_body_ref"),
    )
    return events, rows.where("sequence <> 3").select("ref", "content").dropDuplicates(["ref"])


_GOODS = """g AS (SELECT l_orderkey::VARCHAR AS session_id, l_linenumber AS sequence, (l_suppkey + 1)::VARCHAR AS unit_id, l_partkey + 1 AS product_numeric_id, l_quantity::BIGINT AS sales_volume, l_suppkey, l_partkey FROM lineitem WHERE l_linenumber <> 5),
h AS (SELECT *, CASE WHEN sequence = 3 AND NOT EXISTS (SELECT 1 FROM g o WHERE o.sequence NOT IN (2, 3, 4) AND o.l_suppkey = g.l_suppkey AND o.l_partkey = g.l_partkey AND o.sales_volume = g.sales_volume)
    AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_linenumber = 5 AND o.l_suppkey = g.l_suppkey AND o.l_partkey = g.l_partkey AND o.l_quantity::BIGINT = g.sales_volume)
    AND NOT EXISTS (SELECT 1 FROM g o WHERE o.sequence = 4 AND o.l_suppkey + 1 = g.l_suppkey AND o.l_partkey = g.l_partkey AND o.sales_volume = g.sales_volume) THEN 'missing artifact'
  WHEN sequence = 2 THEN 'incompatible' WHEN sequence = 4 THEN 'other unit' END AS problem FROM g)"""


@query(f"WITH {_GOODS} SELECT session_id, sequence, unit_id, problem, CASE WHEN problem IS NULL THEN product_numeric_id END AS product_numeric_id, CASE WHEN problem IS NULL THEN sales_volume END AS sales_volume FROM h")
def goods_projection(spark, d):
    rows = project.goods(*_goods_events(spark, d))
    first = F.try_element_at("rows", F.lit(1))
    return rows.select("session_id", "sequence", "unit_id", "problem", first["product_numeric_id"].alias("product_numeric_id"), first["sales_volume"].alias("sales_volume"))


@query("SELECT count(*) > 0 AS incompatible, count(*) AS pages FROM lineitem WHERE l_linenumber = 2")
def parser_incompatible(spark, d):
    return project.parser_incompatible(project.goods(*_goods_events(spark, d)))


_ROSTER = """r AS (SELECT s_nationkey AS page_id, (s_suppkey + 1)::VARCHAR AS unit_id, s_name AS name, 'Town ' || s_nationkey AS city, s_suppkey % 9 AS level, s_nationkey % 5 = 0 AND s_suppkey % 3 = 0 AS bad FROM supplier),
n AS (SELECT page_id, count(*) FILTER (bad)::INTEGER AS bad_rows FROM r GROUP BY 1)"""


def _company_pages(spark, d):
    """A company for each nation, its suppliers as units; on some pages levels that are none."""
    bad = (F.col("s_nationkey") % 5 == 0) & (F.col("s_suppkey") % 3 == 0)
    lines = F.concat_ws("\n", F.concat(F.lit("Town "), S("s_nationkey")), F.concat("s_name", F.lit(" ("), S(F.col("s_suppkey") + 1), F.lit(")")), F.when(bad, F.lit("x")).otherwise(S(F.col("s_suppkey") % 9)))
    listed = A.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", lines.alias("t")))).alias("l"))
    return listed.select("page_id", F.concat(F.lit("Company\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("text"))


@query(f"WITH {_ROSTER} SELECT page_id, unit_id, name, city, level FROM r JOIN n USING (page_id) WHERE bad_rows = 0")
def roster_units(spark, d):
    return market_pages.roster(_company_pages(spark, d))[0]


@query(f"WITH {_ROSTER} SELECT page_id, bad_rows FROM n WHERE bad_rows > 0")
def roster_problems(spark, d):
    return market_pages.roster(_company_pages(spark, d))[1]


@query(f"""WITH {_ROSTER}
SELECT (page_id + 1)::VARCHAR AS company_id, unit_id, name, city, level, 0 AS problems FROM r JOIN n USING (page_id) WHERE bad_rows = 0
UNION ALL SELECT (page_id + 1)::VARCHAR, NULL, NULL, NULL, NULL, bad_rows FROM n WHERE bad_rows > 0""")
def roster_projection(spark, d):
    """The pages of companies as artifacts, the events that name these, and what they show."""
    docs = _company_pages(spark, d).select("page_id", artifacts.company_page_text(S("page_id"), F.col("text")).alias("content"))
    kept = docs.withColumn("ref", artifacts.ref(F.col("content")))
    events = kept.select(
        F.lit("s").alias("session_id"), F.col("page_id").alias("sequence"), F.lit("t").alias("observed_at"), F.lit("http.response_body").alias("event_type"), F.lit("cdp.network").alias("source"), F.lit("GET").alias("method"), F.lit(200).alias("status_code"),
        F.lit(recognise.ROSTER_PATH).alias("url_path"), F.map_from_arrays(F.array(F.lit("id"), F.lit("tab")), F.array(F.array(S(F.col("page_id") + 1)), F.array(F.lit("units")))).alias("query"), F.col("ref").alias("response_body_ref"),
    )
    units, problems = project.roster_units(project.rosters(events, kept.select("ref", "content").dropDuplicates(["ref"])))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    bad = problems.select(F.substring_index("page_id", "#", -1).alias("company_id"), none("string", "unit_id"), none("string", "name"), none("string", "city"), none("int", "level"), F.col("bad_rows").cast("int").alias("problems"))
    return units.select("company_id", "unit_id", "name", "city", "level", F.lit(0).alias("problems")).unionByName(bad)


# Market pages, made of the given tables


def _cells(*cells):
    return F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), c if not isinstance(c, str) else F.lit(c), F.lit("</td>"))], F.lit("</tr>"))


def _pages(rows, key: str, *order: str):
    """One page a key with the rows (tr) in ``order``."""
    listed = rows.groupBy(F.col(key).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(*order, "tr"))).alias("r"))
    return listed.select("page_id", F.concat(F.lit("<table>"), F.array_join(F.transform("r", lambda x: x["tr"]), ""), F.lit("</table>")).alias("html"))


@query("""
WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, p_partkey, p_name FROM part)
SELECT p_brand AS page_id, p_name AS group_name, p_partkey + 1 AS product_id FROM r
""")
def vendor_products(spark, d):
    """Brands as pages of vendors: a heading for each part, and its product under it."""
    id_ = S(F.col("p_partkey") + 1)
    link = F.concat(F.lit('<a href="/analitics/vendors/?product='), id_, F.lit('">x</a>'))
    tr = F.concat(F.lit("<tr><td><h3>"), "p_name", F.lit("</h3></td></tr>"), _cells(link))
    pages = _pages(A.table(spark, d, "part").withColumn("tr", tr), "p_brand", "p_partkey")
    return market_pages.vendor_products(pages)[0].select("page_id", "group_name", "product_id")


@query("""
WITH c AS (SELECT n_regionkey + 1 AS group_id, n_nationkey + 1 AS city_id, n_name AS city_name, n_nationkey + 0.5::DOUBLE AS price, 1.25::DOUBLE AS quality FROM nation)
SELECT group_id, city_id, city_name, price, quality FROM c
""")
def group_cities(spark, d):
    n = F.col("n_nationkey")
    cell = F.concat(F.lit('<a href="/city/?id='), S(n + 1), F.lit('">'), "n_name", F.lit('</a><div id="basketPrice[0]">'), S(n), F.lit('.5</div><div id="basketQuality[0]">1.25</div>'))
    pages = _pages(A.table(spark, d, "nation").withColumn("tr", _cells(cell, "", "", "", "")), "n_regionkey", "n_nationkey").withColumn("group_id", F.col("page_id") + 1)
    return market_pages.group_cities(pages)[0].select("group_id", "city_id", "city_name", "price", "quality")


@query("""
SELECT s_nationkey + 1 AS city_id, s_suppkey + 1 AS group_id, s_name AS group_name, (s_suppkey + 1) * 1000000 + 500000 AS sales_volume, 1.5::DOUBLE AS delta_percent, 13.25::DOUBLE AS share_percent, s_suppkey::DOUBLE AS markup_percent, 67.5::DOUBLE AS price_level_percent
FROM supplier WHERE s_nationkey % 5 <> 0
""")
def city_groups(spark, d):
    """Nations as cities and their suppliers as retail groups; a page with one amount that is none gives no rows."""
    n, city = F.col("s_suppkey") + 1, F.col("s_nationkey") + 1
    link = lambda shown: F.concat(F.lit('<a href="/analitics/retailmarket/?city='), S(city), F.lit("&amp;retailgroup="), S(n), F.lit('">'), shown, F.lit("</a>"))
    bad = (F.col("s_nationkey") % 5 == 0) & (F.row_number().over(_of_nation()) == 1)
    amount = F.when(bad, F.lit("much")).otherwise(F.concat(S(n), F.lit(".5 млн p.")))
    tr = _cells(link(F.lit("<img>")), link(F.col("s_name")), amount, "x", "+1.5%", "13.25%", F.concat(S("s_suppkey"), F.lit("%")), "", '<span title="Уровень цен:  67.5%"></span>')
    pages = _pages(A.table(spark, d, "supplier").withColumn("tr", tr), "s_nationkey", "s_suppkey").withColumn("city_id", F.col("page_id") + 1)
    return market_pages.city_groups(pages)[0].drop("page_id")


def _of_nation():
    from pyspark.sql import Window

    return Window.partitionBy("s_nationkey").orderBy("s_suppkey")


def _goods_pages(spark, d):
    """Suppliers as units: a page with a row for each part that they have delivered. Numbers are gathered, rows written in their page."""
    li = A.table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))

    def tr(x):
        id_ = S(x["l_partkey"] + 1)
        link = F.concat(F.lit('<a href="?product='), id_, F.lit('">i</a>'))
        given = lambda name, value: F.concat(F.lit(f'<input name="{name}['), id_, F.lit(']" value="'), value, F.lit('">'))
        last = F.concat(given("purchaseQuantity", F.lit("3")), given("vendorPrice", F.lit("")))
        return _cells(link, link, "", "1 200 / 300", "", "15 pcs", "1.25 q", "", "", given("price", F.lit("40")), "2.5", "50", S(x["q"]), "", last)

    listed = li.groupBy(F.col("l_suppkey").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("l_partkey", "q"))).alias("r"))
    return listed.select("page_id", F.concat(F.lit("<table>"), F.array_join(F.transform("r", tr), ""), F.lit("</table>")).alias("html"), (F.col("page_id") + 1).alias("unit_id"))


@query("""
SELECT l_suppkey AS page_id, l_suppkey + 1 AS unit_id, l_partkey + 1 AS product_id, 1200 AS revenue, 300 AS profit, 15 AS stock_qty, 1.25::DOUBLE AS stock_quality, 40 AS our_price, 2.5::DOUBLE AS city_quality, 50 AS city_price, sum(l_quantity::BIGINT)::BIGINT AS sales_volume, 3 AS supply_qty, 0 AS supply_cost
FROM lineitem GROUP BY l_suppkey, l_partkey
""")
def goods_pages(spark, d):
    return market_pages.goods(_goods_pages(spark, d))[0]


@query("SELECT l_suppkey AS page_id, unnest(['price[n]', 'purchaseQuantity[n]', 'vendorPrice[n]']) AS name, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey")
def input_inventory(spark, d):
    return probes.input_inventory(_goods_pages(spark, d))


# Streams


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1")
def stream_append(spark, d):
    """Events that are appended to files by day, each once."""
    from tessera.streaming import ingest

    where = new_folder(spark, "appended")
    e = _event_stream(spark, d).select("session_id", "event_id", F.date_format(F.timestamp_micros((F.col("time") * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss").alias("observed_at"))
    ingest.append_events(e, f"{where}/events", f"{where}/checkpoint", late="2 days").awaitTermination()
    return spark.read.schema("event_id string, day string").json(f"{where}/events").groupBy("day").agg(F.count("*").alias("events"))


