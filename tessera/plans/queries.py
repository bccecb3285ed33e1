"""The registered queries of the engine: each applies an operator to a view of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import canonical, normalise, pages, text
from tessera.operators import census, consistency, correlate, current, detect, experiments, integrity, knowledge, market, market_pages, paths, provenance, search, sessions
from tessera.plans import adapters as A
from tessera.sources.shared import materialise, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TIMING = correlate.Timing().scaled(A.WINDOW)
_STEPS = (TIMING.near, TIMING.close, TIMING.late)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Market


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, o_orderstatus, n FROM (
  SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1
""")
def market_latest(spark, d):
    rows = A.table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    return market.latest_per_key(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def market_append(spark, d):
    """The log of finished orders, and all orders after it: what it holds already comes once."""
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return market.append(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.drop("o_orderstatus"), ["o_orderkey"])


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, '{"o_orderpriority":' || to_json(o_orderpriority)::VARCHAR || ',"o_orderstatus":' || to_json(o_orderstatus)::VARCHAR || '}' AS t FROM orders)
SELECT o_custkey, count(*) AS rows, sha256('[' || string_agg(t, ',' ORDER BY o_orderkey) || ']') AS fingerprint FROM r GROUP BY 1
""")
def market_page_fingerprints(spark, d):
    rows = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return market.page_fingerprints(rows, ["o_custkey"], "o_orderkey")


@query("""
WITH h AS (SELECT sha256('{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}') AS x FROM orders),
s AS (SELECT count(*) AS rows, sum(('0x' || x[1:8])::BIGINT) AS s0, sum(('0x' || x[9:16])::BIGINT) AS s1, sum(('0x' || x[17:24])::BIGINT) AS s2, sum(('0x' || x[25:32])::BIGINT) AS s3 FROM h)
SELECT rows, sha256(concat_ws('-', rows, s0, s1, s2, s3)) AS fingerprint FROM s
""")
def state_fingerprint(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return canonical.rows_fingerprint(o, "k", "s")


@query("""
WITH t AS (SELECT p_partkey, p_retailprice, p_partkey % 4 AS kind, p_retailprice::DECIMAL(20,6) * CASE p_partkey % 4 WHEN 0 THEN 1000000000 WHEN 1 THEN 1000 ELSE 1000000 END AS amount FROM part)
SELECT p_partkey, CASE WHEN kind < 3 AND amount = floor(amount) THEN amount::BIGINT END AS amount, CASE WHEN kind = 3 THEN p_retailprice END AS percent FROM t
""")
def money_parse(spark, d):
    """Prices as the pages write them, in thousands, millions, billions or per cent, read back."""
    p = A.table(spark, d, "part")
    shown, kind = F.col("p_retailprice").cast("string"), F.col("p_partkey") % 4
    text_ = F.when(kind == 0, F.concat(shown, F.lit(" млрд p."))).when(kind == 1, F.concat(shown, F.lit(" тыс p."))).when(kind == 2, F.concat(shown, F.lit(" млн p."))).otherwise(F.concat(F.lit("+"), shown, F.lit("%")))
    return p.select("p_partkey", normalise.money(text_).alias("amount"), normalise.percent(text_).alias("percent"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, last_value(CASE WHEN l_returnflag = 'R' THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS heading FROM lineitem
""")
def carry_forward_group(spark, d):
    """Each line item under the last returned part of its supplier."""
    li = A.table(spark, d, "lineitem").withColumn("_returned", F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))
    rows = market_pages.carry_forward(li, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "_returned", "heading")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "heading")


# Sessions

_LINK = A.correlation_sql(_STEPS)
_SUMMARY = f"""{_LINK}, own AS (
  SELECT session_id, count(*) AS event_count, count(*) FILTER (source = 'dom.action') AS action_count, count(*) FILTER (event_type = 'http.request') AS http_request_count,
    count(*) FILTER (event_type = 'http.response') AS http_response_count, count(*) FILTER (event_type = 'http.failed') AS anomaly_count, count(*) FILTER (raw_type = 'error' AND k < 10) AS warning_count
  FROM ev GROUP BY session_id
), ls AS (
  SELECT session_id, count(*) FILTER (status = 'strong') AS strong_count, count(*) FILTER (status = 'probable') AS probable_count, count(*) FILTER (status = 'temporal-only') AS temporal_count
  FROM link GROUP BY session_id
), un AS (SELECT session_id, event_id FROM ev WHERE source = 'dom.action' AND event_id NOT IN (SELECT action_event_id FROM link)),
summary AS (
  SELECT session_id, event_count, action_count, http_request_count, http_response_count, coalesce(strong_count, 0) AS strong_count, coalesce(probable_count, 0) AS probable_count,
    coalesce(temporal_count, 0) AS temporal_count, 0::BIGINT AS exact_count, coalesce(u.n, 0) AS uncorrelated_count, warning_count, anomaly_count
  FROM own LEFT JOIN ls USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM un GROUP BY 1) u USING (session_id)
)"""


def _links(spark, d):
    return correlate.correlate(*A.correlation_inputs(spark, d), TIMING)


def _summaries(spark, d, only=None):
    """The counters of all sessions, or of those for which ``only`` holds: nothing else is then read on."""
    rows = A.events(spark, d)
    e = materialise(rows if only is None else rows.where(only))  # read by the counts, the links and the actions without one
    links = materialise(correlate.correlate(e.where("source = 'dom.action'"), e.where("event_type = 'http.request'"), TIMING))
    warnings = e.groupBy("session_id").agg(F.count_if((F.col("raw_type") == "error") & (F.col("k") < 10)).alias("warning_count"))
    return sessions.summaries(e, links, warnings)


@query(f"WITH {_LINK} SELECT session_id, action_event_id, network_event_id, status, round(raw, 4) AS score, round(d * 1000, 3) AS delta_ms FROM link")
def correlation_best(spark, d):
    return _links(spark, d)


@query(f"WITH {_SUMMARY} SELECT * FROM summary")
def session_summary(spark, d):
    return _summaries(spark, d)


@query(f"WITH {_SUMMARY} SELECT session_id, event_id FROM un")
def uncorrelated_actions(spark, d):
    return sessions.uncorrelated_actions(A.events(spark, d), _links(spark, d))


@query(f"WITH {_SUMMARY}, b AS (SELECT * FROM summary WHERE session_id = '1'), a AS (SELECT * FROM summary WHERE session_id = '2') SELECT true AS before_found, true AS after_found, "
    + ", ".join(f"a.{c} - b.{c} AS {c}_delta" for c in sessions.COUNTERS) + " FROM a, b")
def session_compare(spark, d):
    return sessions.compare(_summaries(spark, d, F.col("session_id").isin("1", "2")), "1", "2")


@query(f"WITH {_SUMMARY} SELECT session_id, event_count, anomaly_count, warning_count, uncorrelated_count, count(*) OVER () > 20 AS has_more FROM (SELECT * FROM summary WHERE (warning_count > 0 OR anomaly_count > 0 OR uncorrelated_count > 0) AND session_id > '1' ORDER BY session_id LIMIT 21) QUALIFY row_number() OVER (ORDER BY session_id) <= 20")
def session_signal_page(spark, d):
    rows = _summaries(spark, d, F.col("session_id") > "1").where(sessions.has_signal())
    page = sessions.keyset_page(rows, ["session_id"], limit=20, after=("1",))
    return page.select("session_id", "event_count", "anomaly_count", "warning_count", "uncorrelated_count", "has_more")


@query("SELECT o_custkey, o_orderkey, o_totalprice, true AS has_more FROM orders WHERE (o_custkey, o_orderkey) > (10, 50) ORDER BY o_custkey, o_orderkey LIMIT 50")
def keyset_page(spark, d):
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sessions.keyset_page(o, ["o_custkey", "o_orderkey"], limit=50, after=(10, 50))


@query("SELECT l_orderkey AS session_id, count(*) AS events, min(l_linenumber - 1) AS first, max(l_linenumber - 1) AS last, count(DISTINCT l_linenumber) AS \"distinct\", min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1")
def sequence_contiguity(spark, d):
    """Whether the lines of each order are numbered without gaps and repeats."""
    return integrity.sequence_gaps(A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber") - 1).alias("sequence")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return integrity.repeated(A.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
WITH l AS (SELECT l_partkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O'), r AS (SELECT l_partkey, l_linenumber FROM lineitem WHERE l_linestatus <> 'O')
SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)
""")
def dataset_diff(spark, d):
    li = A.table(spark, d, "lineitem")
    side = lambda c: li.where(c).select("l_partkey", "l_linenumber")
    return integrity.multiset_difference(side("l_linestatus = 'O'"), side("l_linestatus <> 'O'"))


# Captured requests


def _app(spark, d):
    return census.application_events(A.entries(spark, d)).withColumn("path_pattern", normalise.endpoint_pattern(F.col("path"), A.PAGE_RULES))


@query(f"WITH {A.ENTRIES} SELECT capture, entry, path, query, status FROM app")
def application_events(spark, d):
    return _app(spark, d).select("capture", "entry", "path", "query", "status")


@query(f"""WITH {A.ENTRIES}, k AS (SELECT DISTINCT path_pattern, split_part(unnest(list_filter(string_split(query, '&'), lambda x: x <> '')), '=', 1) AS key FROM app)
SELECT path_pattern, count(*) AS count, coalesce((SELECT string_agg(key, ',' ORDER BY key) FROM k WHERE k.path_pattern = app.path_pattern), '') AS query_keys FROM app GROUP BY path_pattern""")
def endpoint_census(spark, d):
    app = _app(spark, d)
    keys = F.transform(normalise.query_pairs(F.col("query")), lambda p: p["key"])
    return census.endpoint_census(app, F.col("path_pattern"), keys)


@query(f"""WITH {A.ENTRIES}, f AS (
  SELECT path_pattern, 'status' AS facet, status::VARCHAR AS value FROM app UNION ALL SELECT path_pattern, 'capture', capture FROM app),
c AS (SELECT path_pattern, facet, value, count(*) AS n FROM f GROUP BY ALL)
SELECT path_pattern, facet, string_agg(value || '=' || n, ',' ORDER BY value) AS counts FROM c GROUP BY ALL""")
def endpoint_value_counts(spark, d):
    return census.counts_as_text(census.value_counts(_app(spark, d), "path_pattern", ["status", "capture"]), "path_pattern")


@query(f"WITH {A.ENTRIES} SELECT path, count(*) AS count, array_to_string(list_sort(list(DISTINCT capture)), ',') AS captures, 'text/html' AS mime_types FROM en WHERE first_party AND NOT EXISTS (SELECT 1 FROM app WHERE app.path = en.path) GROUP BY path")
def asset_census(spark, d):
    from tessera.operators import datasets

    found = datasets.assets(A.entries(spark, d), "example.org")
    return found.withColumn("captures", F.array_join("captures", ",")).withColumn("mime_types", F.array_join("mime_types", ","))


@query(f"WITH {A.ENTRIES} SELECT capture, entry, path, example::INTEGER AS example FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY entry) AS example FROM app) WHERE example <= 5")
def first_examples(spark, d):
    return census.first_examples(_app(spark, d), "capture", ["entry"]).select("capture", "entry", "path", "example")


def _route_sql(token: str) -> str:
    """The normalised route of a token with path and query, in SQL."""
    path = f"split_part({token}, '?', 1)"
    segments = f"string_split({path}, '/')"
    named = f"CASE WHEN {segments}[i - 1] = 'topic' THEN '{{topic}}' WHEN {segments}[i - 1] = 'id' AND i = len({segments}) AND starts_with({path}, '/user/splash/') THEN '{{splash_id}}' ELSE '{{id}}' END"
    of_path = f"array_to_string(list_transform({segments}, lambda s, i: CASE WHEN s <> '' AND i > 1 AND {segments}[i - 1] IN ('id', 'r', 'style', 'topic') THEN {named} ELSE s END), '/')"
    key, value = "split_part(p, '=', 1)", "CASE WHEN contains(p, '=') THEN substr(p, length(split_part(p, '=', 1)) + 2) ELSE '' END"
    number = f"regexp_matches({value}, '^[0-9]+$')"
    of_id = f"CASE WHEN starts_with({path}, '/city/map/') THEN '{{ID}}' WHEN {number} THEN '{{id}}' ELSE '{{value}}' END"
    of_number = f"CASE WHEN {key} = 'product' THEN '{{product_id}}' WHEN {key} IN ('replace', 'vendor') THEN '{{vendor_id}}' ELSE '{{number}}' END"
    told = f"CASE WHEN {key} = 'topic' THEN '{{value}}' WHEN {key} = 'id' THEN {of_id} WHEN {number} THEN {of_number} ELSE {value} END"
    of_query = f"array_to_string(list_transform(list_filter(string_split(substr({token}, length({path}) + 2), '&'), lambda p: p <> ''), lambda p: {key} || '=' || {told}), '&')"
    return f"{of_path} || CASE WHEN contains({token}, '?') THEN '?' || {of_query} ELSE '' END"


_SITE = "example.org"
_TOKENS = r"""["']((?:(?:https?:)?//example\.org)?/[^"'\s<>()\\]*)["']""".replace("'", "''")
_ROUTES = f"""{A.ENTRIES}, t AS (
  SELECT capture, entry, path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS token FROM en WHERE first_party
  UNION ALL SELECT capture, entry, rtrim(regexp_replace(q, '^(?:https?:)?//{_SITE}', ''), '.,;:!') FROM (SELECT capture, entry, unnest(regexp_extract_all(html, '{_TOKENS}', 1)) AS q FROM en WHERE first_party)),
u AS (SELECT DISTINCT capture, entry, token, {_route_sql("token")} AS pattern FROM t WHERE token = '/' OR (length(token) >= 2 AND starts_with(token, '/') AND NOT starts_with(token, '//') AND NOT contains(token, '{{')))"""


def _site_entries(spark, d):
    return A.entries(spark, d).where("first_party").withColumn("raw_query", F.col("query")).withColumn("body", F.col("html").cast("binary"))


@query(f"WITH {_ROUTES} SELECT pattern, count(*) AS count, count(DISTINCT capture) AS captures, count(DISTINCT (capture, entry)) AS entries FROM u GROUP BY pattern")
def route_census(spark, d):
    from tessera.operators import datasets

    return datasets.routes(_site_entries(spark, d), _SITE)


@query(f"WITH {_ROUTES} SELECT capture, entry, token, pattern FROM u")
def route_tokens(spark, d):
    from tessera.operators import datasets

    return datasets.route_tokens(_site_entries(spark, d), _SITE)


@query()
def form_signatures(spark, d):
    p = A.table(spark, d, "pages").select(F.col("page_id").alias("page"), F.explode(pages.page_forms("html")).alias("f"))
    return census.form_dedup(p.select("page", "f.form_id", "f.method", "f.action", F.to_json("f.fields").alias("fields")))


@query()
def page_text(spark, d):
    return A.table(spark, d, "pages").select("page_id", pages.page_text("html").alias("p")).select("page_id", "p.title", "p.text", "p.links")


@query()
def page_visible_text(spark, d):
    return A.table(spark, d, "pages").select("page_id", pages.visible_text("html").alias("text"))


@query("SELECT part, count(*) AS records, part * 60 AS \"offset\", min(o_orderkey) AS first_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 60 AS part FROM orders) GROUP BY part")
def partition_manifest(spark, d):
    return census.partition_manifest(A.table(spark, d, "orders"), ["o_orderkey"])


_DROP = "(?i)" + "|".join(normalise.DROP_FIELDS)


@query(rf"""
WITH n AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '{_DROP}')) AS names FROM documents),
k AS (SELECT doc_id, list_sort(list_distinct(list_transform(names, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '{{numeric-key}}' ELSE regexp_replace(x, '\[[0-9]+\]', '[n]', 'g') END))) AS keys FROM n)
SELECT doc_id, len(keys)::INTEGER AS n_keys, sha256(array_to_string(keys, ',')) AS keys_sha256 FROM k
""")
def key_set_normalise(spark, d):
    keys = normalise.key_set(F.split(F.coalesce("text", F.lit("")), " "))
    return A.table(spark, d, "documents").select("doc_id", F.size(keys).alias("n_keys"), F.sha2(F.array_join(keys, ","), 256).alias("keys_sha256"))


_URL = r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS token FROM pages)"""


@query(f"{_URL} SELECT page_id, {_route_sql('token')} AS route, CASE WHEN regexp_matches(split_part(token, '?', 1), '^/wikihelp/topic/.+$') THEN '/wikihelp/topic/{{topic}}' ELSE split_part(token, '?', 1) END AS endpoint FROM u")
def route_normalise(spark, d):
    token = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return A.table(spark, d, "pages").select("page_id", normalise.route(token).alias("route"), normalise.endpoint_pattern(F.substring_index(token, "?", 1)).alias("endpoint"))


@query(r"""
WITH p AS (SELECT DISTINCT '/' || event_type || '/' || (json_extract_string(props, '$.k')::INTEGER) || CASE WHEN event_id % 3 = 0 THEN '/edit' ELSE '' END AS path FROM events)
SELECT path, CASE WHEN path = '/view/7' THEN '/view/7' WHEN regexp_matches(path, '^/view/[0-9]+$') THEN '/view/{id}' WHEN regexp_matches(path, '^/click/[0-9]+/edit$') THEN '/click/{id}/edit'
  WHEN regexp_matches(path, '^/error/[0-9]+/edit$') THEN NULL WHEN regexp_matches(path, '^/[a-z]+/[0-9]+/edit$') THEN '/{kind}/{id}/edit' END AS pattern,
  CASE WHEN path = '/view/7' THEN 'exact' WHEN regexp_matches(path, '^/error/[0-9]+/edit$') THEN 'ambiguous' WHEN regexp_matches(path, '^/view/[0-9]+$|/edit$') THEN 'template' ELSE 'unknown' END AS status FROM p
""")
def path_match(spark, d):
    e = A.events(spark, d)
    path = F.concat(F.lit("/"), "raw_type", F.lit("/"), F.col("k").cast("string"), F.when(F.col("n") % 3 == 0, F.lit("/edit")).otherwise(F.lit("")))
    known = [("/view/{id}",), ("/view/7",), ("/click/{id}/edit",), ("/{kind}/{id}/edit",), ("/error/{id}/edit",), ("/error/{name}/edit",)]
    return paths.match(e.select(path.alias("path")), spark.createDataFrame(known, "pattern string"))


@query()
def redact_json(spark, d):
    nested = F.concat(F.lit('{"body":'), "props", F.lit(',"authToken":"x","list":[{"cookie":1,"v":'), F.col("event_id").cast("string"), F.lit("}]}"))
    return A.table(spark, d, "events").select("event_id", text.redact_json(nested).alias("body"))


@query("SELECT event_type, quantile_disc(v, 0.0) AS p0, max(v) FILTER (k = ceil((n - 1) * 0.5) + 1) AS p50, max(v) FILTER (k = ceil((n - 1) * 0.95) + 1) AS p95 FROM (SELECT event_type, value AS v, row_number() OVER w AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY value)) GROUP BY 1")
def percentiles(spark, d):
    return consistency.nearest_rank(A.table(spark, d, "events"), ["event_type"], "value", {"p0": 0.0, "p50": 0.5, "p95": 0.95})


@query(f"""WITH {A.ENTRIES}, n AS (SELECT path_pattern, count(*) AS count, count(*) FILTER (status = 200) AS good FROM app GROUP BY 1)
SELECT path_pattern, facet, count, good AS total FROM n, (SELECT unnest(['status', 'capture']) AS facet) WHERE good > 0 AND good <> count""")
def census_conservation(spark, d):
    """Endpoints whose requests are not all accounted for by the successful ones, per facet."""
    app = _app(spark, d)
    total = census.endpoint_census(app, F.col("path_pattern"), F.array().cast("array<string>"))
    counts = census.value_counts(app.where("status = 200"), "path_pattern", ["status", "capture"])
    return consistency.census_conservation(total, counts, "path_pattern").select("path_pattern", "facet", "count", "total")


@query(f"""WITH {A.OBSERVATIONS}, a AS (SELECT DISTINCT path, method FROM ob WHERE known), b AS (SELECT DISTINCT path, method FROM ob WHERE n % 50 = 0)
SELECT path, method, 'left' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT path, method, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def contract_consistency(spark, d):
    ob = A.observations(spark, d)
    return consistency.both_ways(ob.where("known"), ob.where("n % 50 = 0"), ["path", "method"])


@query("""
SELECT event_id::VARCHAR AS session_id, CASE event_type WHEN 'signup' THEN 'submit' ELSE 'click' END AS action_kind, event_id % 2 = 0 AS is_trusted, '/p/' || event_id % 10 AS page_path, CASE WHEN event_id % 3 = 0 THEN 'POST' END AS form_method,
  CASE WHEN event_id % 4 <> 0 THEN 'name' END AS element_name FROM events WHERE event_type IN ('click', 'signup')
""")
def action_events(spark, d):
    from tessera.functions.actions import action_events as read

    n, text_ = F.col("event_id"), lambda c: c.cast("string")
    kind = F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "click", "click").otherwise("hover")
    payload = F.to_json(F.struct(
        F.lit(1).alias("schema"), kind.alias("kind"), (n % 2 == 0).alias("isTrusted"), F.concat(F.lit("/p/"), text_(n % 10), F.lit("?q=1")).alias("pagePath"),
        F.struct(F.when(n % 4 != 0, F.lit(" name ")).otherwise(F.lit("csrfName")).alias("name")).alias("element"), F.struct(F.when(n % 3 == 0, F.lit("post")).otherwise(F.lit("p1")).alias("method")).alias("form"),
    ))
    rows = A.table(spark, d, "events").select(text_(n).alias("session_id"), F.lit(0).alias("sequence"), payload.alias("payload"))
    return read(rows).select("session_id", "action_kind", "is_trusted", "page_path", "form_method", "element_name")


# Changes


def _contract(spark, d):
    ob = A.observations(spark, d)
    return ob, detect.compile_contract(ob.where("known"))


_EP = f"""WITH {A.OBSERVATIONS}, c AS (SELECT path, method, list_distinct(flatten(list(query_keys))) AS all_keys, list_distinct(list(status)) AS statuses FROM ob WHERE known GROUP BY ALL),
j AS (SELECT o.*, c.all_keys, c.statuses, o.path IN (SELECT path FROM c) AS has_path, list_sort(list_filter(o.query_keys, lambda x: NOT list_contains(c.all_keys, x))) AS added
  FROM ob o LEFT JOIN c USING (path, method) WHERE NOT known),
ef AS (
  SELECT event_id, session_id, ts, path, method, 'endpoint.new' AS kind, 'NOVEL' AS state, '' AS delta FROM j WHERE NOT has_path
  UNION ALL SELECT event_id, session_id, ts, path, method, 'endpoint.method_added', 'NOVEL', method FROM j WHERE has_path AND all_keys IS NULL
  UNION ALL SELECT event_id, session_id, ts, path, method, 'endpoint.query_key_added', 'NOVEL', array_to_string(added, ',') FROM j WHERE all_keys IS NOT NULL AND len(added) > 0
  UNION ALL SELECT event_id, session_id, ts, path, method, 'endpoint.status_added', 'NOVEL', status::VARCHAR FROM j WHERE all_keys IS NOT NULL AND NOT list_contains(statuses, status)
  UNION ALL SELECT event_id, session_id, ts, path, method, 'endpoint.known', 'KNOWN', '' FROM j WHERE all_keys IS NOT NULL AND len(added) = 0 AND list_contains(statuses, status))"""


def _endpoint_facts(spark, d):
    ob, contract = _contract(spark, d)
    return detect.endpoint_facts(ob.where("NOT known"), contract)


@query(f"{_EP} SELECT session_id, event_id, path, method, kind, state, delta FROM ef")
def endpoint_facts(spark, d):
    return _endpoint_facts(spark, d)


@query(f"{_EP} SELECT state, kind, count(*) AS n FROM ef GROUP BY ALL")
def fact_counts(spark, d):
    return _endpoint_facts(spark, d).groupBy("state", "kind").agg(F.count("*").alias("n"))


_CHANGE = "'chg.' || sha256('{" + ",".join(f'"{c}":\' || to_json({c})::VARCHAR || \'' for c in ("delta", "kind", "method", "path", "rule")) + ',"version":"1"}\')'
_RULE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in detect.RULES.items()) + " END"


_NOVEL = f"{_EP}, nv AS (SELECT *, {_CHANGE} AS change_id FROM (SELECT *, {_RULE} AS rule FROM ef WHERE state = 'NOVEL'))"
_STARTED = "s AS (SELECT session_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS started_at FROM ob GROUP BY 1)"


@query(f"""{_NOVEL} SELECT change_id, rule, kind, path, method, delta, count(DISTINCT event_id) AS n_evidence, array_to_string(list_sort(list(DISTINCT event_id))[1:100], ',') AS evidence
FROM nv GROUP BY change_id, rule, kind, path, method, delta""")
def findings(spark, d):
    return detect.findings(_endpoint_facts(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


@query(f"{_NOVEL} SELECT DISTINCT change_id, rule, kind, path, method, delta, event_id FROM nv")
def finding_evidence(spark, d):
    return detect.finding_evidence(_endpoint_facts(spark, d))


def _found(spark, d):
    """Promotable facts of all sessions with change_id, session_id and its start: the facts carry their session."""
    ob, contract = _contract(spark, d)
    started = ob.groupBy("session_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"))
    return detect.promotable(detect.endpoint_facts(ob.where("NOT known"), contract)).join(started, "session_id")


@query(f"""{_NOVEL}, {_STARTED}, f AS (SELECT DISTINCT change_id, session_id, started_at FROM nv JOIN s USING (session_id))
SELECT change_id, min(started_at) AS first_seen, max(started_at) AS last_seen, count(*) AS occurrences, arg_min(session_id, (started_at, session_id)) AS first_session, arg_max(session_id, (started_at, session_id)) AS last_session FROM f GROUP BY 1""")
def change_rollup(spark, d):
    return detect.change_rollup(_found(spark, d))


@query(f"""WITH {A.OBSERVATIONS}, s AS (SELECT DISTINCT path, method, query_keys AS sq, body_keys AS sb FROM ob WHERE known AND method = 'POST' AND body_keys IS NOT NULL),
m AS (SELECT o.event_id, o.path, o.method, o.body_keys IS NULL AS unknown, list_sort(list_filter(o.query_keys, lambda x: NOT list_contains(sq, x))) AS q, list_sort(list_filter(o.body_keys, lambda x: NOT list_contains(sb, x))) AS b,
    len(list_filter(sq, lambda x: NOT list_contains(o.query_keys, x))) = 0 AND len(list_filter(sb, lambda x: NOT list_contains(o.body_keys, x))) = 0 AS holds
  FROM ob o LEFT JOIN s ON o.path = s.path AND o.method = s.method WHERE NOT o.known AND o.method = 'POST'),
n AS (SELECT *, len(q) + len(b) AS size, min(len(q) + len(b)) FILTER (holds) OVER (PARTITION BY event_id) AS least FROM m),
p AS (SELECT event_id, path, method, bool_or(unknown) AS unknown, coalesce(bool_or(holds AND size = 0), false) AS exact, count(*) FILTER (holds AND size = least) AS nearest,
    any_value(q) FILTER (holds AND size = least) AS q, any_value(b) FILTER (holds AND size = least) AS b FROM n GROUP BY ALL)
SELECT event_id, path, method, 'operation.indeterminate' AS kind, 'INDETERMINATE' AS state, '' AS delta FROM p WHERE unknown
UNION ALL SELECT event_id, path, method, 'operation.known', 'KNOWN', '' FROM p WHERE NOT unknown AND exact
UNION ALL SELECT event_id, path, method, 'operation.query_key_added', 'NOVEL', array_to_string(q, ',') FROM p WHERE NOT unknown AND NOT exact AND nearest = 1 AND len(q) > 0
UNION ALL SELECT event_id, path, method, 'operation.body_key_added', 'NOVEL', array_to_string(b, ',') FROM p WHERE NOT unknown AND NOT exact AND nearest = 1 AND len(b) > 0
UNION ALL SELECT event_id, path, method, 'operation.new_signature', 'NOVEL', '' FROM p WHERE NOT unknown AND NOT exact AND nearest <> 1""")
def operation_facts(spark, d):
    ob = A.observations(spark, d)
    known = ob.where("known AND method = 'POST' AND body_keys IS NOT NULL")
    return detect.operation_facts(ob.where("NOT known").drop("session_id"), known)


@query(f"""WITH {A.OBSERVATIONS}, s AS (SELECT DISTINCT path, method, fields AS sf FROM ob WHERE known),
m AS (SELECT o.event_id, o.path, o.method, sf IS NOT NULL AS has, len(list_filter(o.fields, lambda x: NOT list_contains(sf, x))) = 0 AS within, len(list_filter(sf, lambda x: NOT list_contains(o.fields, x))) = 0 AS below,
    len(sf) AS size, array_to_string(list_sort(list_filter(o.fields, lambda x: NOT list_contains(sf, x))), ',') AS delta FROM ob o LEFT JOIN s ON o.path = s.path AND o.method = s.method WHERE NOT o.known),
n AS (SELECT *, max(size) FILTER (below) OVER (PARTITION BY event_id) AS largest FROM m),
p AS (SELECT event_id, path, method, bool_or(has) AS has, coalesce(bool_or(within), false) AS within, count(DISTINCT delta) FILTER (below AND size = largest) AS deltas, min(delta) FILTER (below AND size = largest) AS delta FROM n GROUP BY ALL)
SELECT event_id, path, method, CASE WHEN NOT has THEN 'form.signature_new' WHEN within THEN 'form.known' WHEN deltas = 1 THEN 'form.field_added' ELSE 'form.signature_new' END AS kind,
  CASE WHEN has AND within THEN 'KNOWN' ELSE 'NOVEL' END AS state, CASE WHEN has AND NOT within AND deltas = 1 THEN delta ELSE '' END AS delta FROM p""")
def form_facts(spark, d):
    ob = A.observations(spark, d)
    return detect.form_facts(ob.where("NOT known").drop("session_id"), ob.where("known"))


@query(f"""WITH {_LINK}, f AS (SELECT DISTINCT path, method FROM link JOIN (SELECT event_id, n FROM ev) e ON e.event_id = network_event_id WHERE n % 5 = 0),
r AS (SELECT l.network_event_id AS event_id, l.status, l.path, l.method, l.action_path, EXISTS (SELECT 1 FROM f WHERE f.path = l.path AND f.method = l.method) AS known FROM link l)
SELECT event_id, path, method, 'relation.temporal_only' AS kind, 'INDETERMINATE' AS state, '' AS delta FROM r WHERE status = 'temporal-only'
UNION ALL SELECT event_id, path, method, 'action_http.request_family_new', 'NOVEL', '' FROM r WHERE status <> 'temporal-only' AND method = 'POST' AND NOT known
UNION ALL SELECT event_id, path, method, 'action_http.path_conflict', 'CONFLICT', action_path FROM r WHERE status <> 'temporal-only' AND action_path <> path
UNION ALL SELECT event_id, path, method, 'relation.known', 'KNOWN', '' FROM r WHERE status <> 'temporal-only' AND NOT (method = 'POST' AND NOT known) AND action_path = path""")
def relation_facts(spark, d):
    e = A.events(spark, d)
    linked = detect.linked_requests(_links(spark, d), e, e).where("problem IS NULL").drop("problem", "session_id")
    return detect.relation_facts(linked, linked.where("CAST(event_id AS BIGINT) % 5 = 0"))


@query("""
WITH r AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'F' THEN 'POST' ELSE 'GET' END AS method FROM orders),
p AS (SELECT l_orderkey AS request_id, min(l_linenumber) AS sequence, count(*) AS n, arg_min(l_partkey, (l_linenumber, l_partkey)) AS ev, arg_min(CASE WHEN l_linestatus = 'F' THEN 'POST' ELSE 'GET' END, (l_linenumber, l_partkey)) AS method FROM lineitem GROUP BY 1)
SELECT request_id::VARCHAR AS request_id, ev AS response_event_id, CASE WHEN n > 1 THEN 'duplicate' WHEN sequence <= 1 THEN 'before_request' WHEN n IS NOT NULL AND p.method <> r.method THEN 'disagrees' END AS problem FROM r LEFT JOIN p USING (request_id)
""")
def response_attach(spark, d):
    """Orders as requests, their line items as responses."""
    how = lambda c: F.when(F.col(c) == "F", "POST").otherwise("GET").alias("method")
    o = A.table(spark, d, "orders").select(F.lit("s").alias("session_id"), F.col("o_orderkey").cast("string").alias("request_id"), F.lit(0).alias("redirect_index"), F.lit(1).alias("sequence"), how("o_orderstatus"))
    r = A.table(spark, d, "lineitem").select(F.lit("s").alias("session_id"), F.col("l_orderkey").cast("string").alias("request_id"), F.lit(0).alias("redirect_index"), F.col("l_linenumber").alias("sequence"), F.col("l_partkey").alias("event_id"), F.lit(200).alias("status"), how("l_linestatus"))
    return detect.attach_responses(o, r).select("request_id", "response_event_id", "problem")


@query("SELECT l_orderkey AS request_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def unasked_responses(spark, d):
    """Line items of orders that are not finished: responses to requests that no one has made."""
    key = lambda c: [F.lit("s").alias("session_id"), F.col(c).alias("request_id"), F.lit(0).alias("redirect_index")]
    asked = A.table(spark, d, "orders").where("o_orderstatus = 'F'").select(*key("o_orderkey"))
    return detect.unasked_responses(asked, A.table(spark, d, "lineitem").select(*key("l_orderkey"), "l_linenumber")).select("request_id", "l_linenumber")


@query(f"""WITH {A.EVENTS}, h AS (SELECT *, CASE WHEN n % 4 <> 0 THEN 300 + (n % 8)::INTEGER END AS sent, lag(path) OVER w AS before FROM ev WINDOW w AS (PARTITION BY session_id, k ORDER BY sequence))
SELECT event_id, path, before AS redirected_from, count(*) OVER (PARTITION BY session_id, k) AS hops, lead(sent) OVER (PARTITION BY session_id, k ORDER BY sequence) AS hop_status,
  CASE WHEN before IS NULL AND sent IS NOT NULL THEN 'no hop before' WHEN before IS NOT NULL AND sent IS NULL THEN 'no status' END AS problem FROM h""")
def redirect_chain(spark, d):
    n = F.col("n")
    e = A.events(spark, d).withColumn("request_id", F.col("k").cast("string")).withColumn("redirect_index", F.col("sequence"))
    sent = e.withColumn("redirect_status", F.when(n % 4 != 0, (F.lit(300) + n % 8).cast("int")))
    return detect.redirect_chain(sent).select("event_id", "path", "redirected_from", "hops", "hop_status", "problem")


@query(f"""WITH {A.OBSERVATIONS} SELECT CASE WHEN path LIKE '/signup/%' THEN '/signup/{{id}}' ELSE path END AS path, method, array_to_string(list_sort(query_keys), ',') AS query_keys, array_to_string(list_sort(body_keys), ',') AS body_keys, count(*) AS posts
FROM ob WHERE method = 'POST' GROUP BY ALL""")
def operation_signatures(spark, d):
    from tessera.operators import contract

    ob = A.observations(spark, d).where("method = 'POST'")
    found = contract.operation_signatures(ob, spark.createDataFrame([("/signup/{id}",)], "pattern string"))
    return found.withColumn("query_keys", F.array_join("query_keys", ",")).withColumn("body_keys", F.array_join("body_keys", ","))


@query(f"""WITH {A.OBSERVATIONS}, e AS (SELECT path, list_sort(list(DISTINCT method)) AS methods, list_sort(list_distinct(flatten(list(query_keys)))) AS keys, list_sort(list(DISTINCT session_id || '#seq-' || sequence)) AS ev FROM ob WHERE known GROUP BY 1)
SELECT 'endpoint:' || path AS ref, 'endpoint' AS kind, path AS title, array_to_string(methods, ' ') || chr(10) || 'query: ' || array_to_string(keys, ' ') AS body, array_to_string(ev, ',') AS evidence FROM e""")
def knowledge_endpoints(spark, d):
    from tessera.operators import projectors

    ob = A.observations(spark, d).where("known")
    ref = F.concat("session_id", F.lit("#seq-"), F.col("sequence").cast("string"))
    rows = ob.groupBy(F.col("path").alias("path_pattern")).agg(
        F.array_sort(F.collect_set("method")).alias("methods"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("query_keys")))).alias("query_keys"), F.array_sort(F.collect_set(ref)).alias("evidence")
    )
    return projectors.endpoint_records(rows).select("ref", "kind", "title", "body", F.array_join("evidence", ",").alias("evidence"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN 'incompatible' WHEN l_linenumber = 5 OR l_partkey = 0 THEN 'out of range' END AS problem, CASE WHEN l_linenumber NOT IN (3, 5) AND l_partkey > 0 THEN l_quantity::BIGINT END AS sales FROM lineitem
""")
def artifact_parse(spark, d):
    from tessera.functions import artifacts

    n, one = F.col("l_linenumber"), F.lit(1).cast("long")
    row = F.struct(
        one.alias("city_price"), F.lit(1.5).alias("city_quality"), one.alias("our_price"), F.col("l_partkey").alias("product_numeric_id"), F.when(n == 5, F.lit(-1)).otherwise(F.lit(1)).cast("long").alias("profit"), one.alias("revenue"),
        F.col("l_quantity").cast("long").alias("sales_volume"), one.alias("stock_qty"), F.lit(0.5).alias("stock_quality"), one.alias("supply_cost"), one.alias("supply_qty"),
    )
    made = lambda schema: artifacts.unit_economics_text(F.col("l_suppkey"), F.array(row), schema)
    text_ = F.when(n == 3, made("unit-economics/v0")).otherwise(made(artifacts.SCHEMA))
    read = A.table(spark, d, "lineitem").withColumn("a", artifacts.unit_economics(text_))
    return read.select("l_orderkey", "l_linenumber", "l_partkey", "a.problem", F.try_element_at("a.page.rows", F.lit(1))["sales_volume"].alias("sales"))


# Current state


def _state(spark, d):
    return current.latest_state(A.unit_products(spark, d), A.STATE_KEYS, A.STATE_ORDER)


def _roster(spark, d):
    return A.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("unit_id"))


@query(f"WITH {A.UNIT_PRODUCTS} SELECT unit_id, product_id, sales_volume, stock_qty FROM latest WHERE unit_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def verified_unit_products(spark, d):
    return current.split_by_roster(_state(spark, d), _roster(spark, d), "unit_id")[0].select("unit_id", "product_id", "sales_volume", "stock_qty")


@query(f"WITH {A.UNIT_PRODUCTS} SELECT unit_id, product_id, sales_volume, stock_qty FROM latest WHERE unit_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def orphan_unit_products(spark, d):
    return current.split_by_roster(_state(spark, d), _roster(spark, d), "unit_id")[1].select("unit_id", "product_id", "sales_volume", "stock_qty")


_SURFACES = """sf AS (SELECT l_suppkey AS unit_id, max(l_shipdate) AS observed_at, CASE WHEN count(*) % 3 = 0 THEN 'stale' ELSE 'ready' END AS status FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"""


def _surfaces(spark, d):
    li = A.table(spark, d, "lineitem").where("l_returnflag = 'R'")  # a surface is seen when something comes back
    return li.groupBy(F.col("l_suppkey").alias("unit_id")).agg(F.max("l_shipdate").alias("observed_at"), F.when(F.count("*") % 3 == 0, "stale").otherwise("ready").alias("status"))


@query(f"WITH {_SURFACES} SELECT s_suppkey AS unit_id, coalesce(status, 'unknown') AS status FROM supplier LEFT JOIN sf ON s_suppkey = unit_id WHERE s_acctbal > 0")
def surface_coverage(spark, d):
    return current.surface_coverage(_roster(spark, d), _surfaces(spark, d), "unit_id")


_CATALOG = "c AS (SELECT CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE p_partkey // 2 END AS id, p_name FROM part), cn AS (SELECT id, count(DISTINCT p_name) AS n, min(p_name) AS b FROM c GROUP BY 1)"


def _catalog(spark, d):
    key = F.when(F.col("p_size") % 2 == 0, F.col("p_partkey")).otherwise(F.floor(F.col("p_partkey") / 2)).cast("long")
    return A.table(spark, d, "part").select(key.alias("id"), "p_name")


@query(f"""WITH {_CATALOG}
SELECT DISTINCT l_partkey AS id, CASE WHEN n = 1 THEN b END AS p_name, coalesce(n, 0) AS n_names, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM lineitem LEFT JOIN cn ON id = l_partkey""")
def catalog_resolution(spark, d):
    return current.resolve_catalog(A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), _catalog(spark, d), "id", "p_name")


@query(f"""WITH {_CATALOG}, h AS (SELECT sha256('{{"ambiguous":"' || (n > 1)::VARCHAR || '","id":"' || id || '","name":' || CASE WHEN n = 1 THEN to_json(b)::VARCHAR ELSE 'null' END || ',"version":"1"}}') AS x FROM cn),
s AS (SELECT count(*) AS rows, sum(('0x' || x[1:8])::BIGINT) AS s0, sum(('0x' || x[9:16])::BIGINT) AS s1, sum(('0x' || x[17:24])::BIGINT) AS s2, sum(('0x' || x[25:32])::BIGINT) AS s3 FROM h)
SELECT rows, sha256(concat_ws('-', rows, s0, s1, s2, s3)) AS fingerprint FROM s""")
def catalog_fingerprint(spark, d):
    return current.catalog_fingerprint(_catalog(spark, d), "id", "p_name")


_PLAN = f"""WITH {A.UNIT_PRODUCTS}, {_SURFACES}, r AS (SELECT l.* FROM latest l JOIN sf USING (unit_id) WHERE status = 'ready' AND unit_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)),
q AS (SELECT *, 3 * sales_volume AS target, greatest(0, 3 * sales_volume - stock_qty - supply_qty) AS order_qty, CASE WHEN city_quality > 0 AND stock_quality > 0 THEN city_price / city_quality * stock_quality END AS reference, our_price - supply_cost AS margin FROM r),
p AS (SELECT *, reference * 1.05::DOUBLE AS recommended FROM q)
SELECT unit_id, product_id, target, order_qty, reference, recommended, margin,
  concat_ws(',', CASE WHEN our_price < city_price THEN 'below_city' END, CASE WHEN our_price > recommended THEN 'above_corridor' END, CASE WHEN our_price < city_price AND profit > 0 THEN 'potential' END,
    CASE WHEN order_qty > 0 THEN 'out_of_stock_risk' END, CASE WHEN reference IS NULL THEN 'unknown' END) AS flags FROM p"""


def _ready(spark, d):
    verified = current.split_by_roster(_state(spark, d), _roster(spark, d), "unit_id")[0]
    return verified.join(_surfaces(spark, d).where("status = 'ready'").select("unit_id"), "unit_id", "left_semi")


def _shown(rows):
    return rows.select("unit_id", "product_id", "target", "order_qty", "reference", "recommended", "margin", "flags")


@query(_PLAN)
def plan_current(spark, d):
    return _shown(current.plan(_ready(spark, d)).withColumn("margin", F.col("our_price") - F.col("supply_cost")))


@query(f"{_PLAN} ORDER BY p.margin DESC, order_qty DESC, unit_id, product_id LIMIT 100")
def plan_top(spark, d):
    return _shown(current.top_plan(_ready(spark, d), limit=100))


# Knowledge


_WORDS = "list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text)), '\\p{Mn}', '', 'g'), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"


@query(f"""
WITH w AS (SELECT doc_id AS ref, coalesce({_WORDS}, []) AS w FROM documents),
p AS (SELECT ref, len(w) AS length, unnest(w) AS term FROM w), t AS (SELECT ref, term, length, count(*) AS tf FROM p GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark),
n AS (SELECT query_id, count(*) AS needed FROM q GROUP BY 1), s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
h AS (SELECT query_id, ref, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS got FROM q JOIN t USING (term) JOIN df USING (term), s GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, ref, score FROM (SELECT query_id, ref, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref) AS rank FROM h JOIN n USING (query_id) WHERE got = needed) WHERE rank <= 10
""")
def search_bm25(spark, d):
    """The documents that hold all words of each benchmark text, in any order."""
    return search.bm25(A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), A.table(spark, d, "documents").select(F.col("doc_id").alias("ref"), "text"))


_EXACT = """q AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'part:' || (o_custkey * 2) WHEN 1 THEN coalesce(p_name, '') ELSE 'Brand#' || (o_orderkey % 60) END AS text, 'part:' || o_custkey AS expected FROM orders LEFT JOIN part ON p_partkey = o_custkey),
k AS (SELECT 'part:' || p_partkey AS ref, p_name, p_brand FROM part),
h AS (SELECT query_id, ref, min(tier) AS tier FROM (SELECT query_id, ref, 1 AS tier FROM q JOIN k ON text = ref UNION ALL SELECT query_id, ref, 2 FROM q JOIN k ON lower(text) = lower(p_brand) UNION ALL SELECT query_id, ref, 3 FROM q JOIN k ON lower(text) = lower(p_name)) GROUP BY ALL),
hit AS (SELECT query_id, rank::INTEGER AS rank, ref, tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, ref) AS rank FROM h) WHERE rank <= 5)"""


def _exact(spark, d):
    """Every order asks for a part: by its ref, by its customer's part's title, or by a brand."""
    part = A.table(spark, d, "part")
    n = F.col("o_orderkey")
    asked = A.table(spark, d, "orders").join(part.select(F.col("p_partkey").alias("o_custkey"), "p_name"), "o_custkey", "left")
    wanted = F.when(n % 3 == 0, F.concat(F.lit("part:"), (F.col("o_custkey") * 2).cast("string"))).when(n % 3 == 1, F.coalesce("p_name", F.lit(""))).otherwise(F.concat(F.lit("Brand#"), (n % 60).cast("string")))
    q = asked.select(n.alias("query_id"), wanted.alias("text"), F.concat(F.lit("part:"), F.col("o_custkey").cast("string")).alias("expected")).withColumn("norm", text.search_text("text"))
    known = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("ref"), text.search_text("p_name").alias("title"), text.search_text("p_brand").alias("alias"))
    return q, search.exact_tiers(q, known.select("ref"), known.select("ref", F.col("alias").alias("norm")), known.select("ref", F.col("title").alias("norm")), limit=5)


@query(f"WITH {_EXACT} SELECT * FROM hit")
def search_exact(spark, d):
    return _exact(spark, d)[1]


@query(f"""WITH {_EXACT}, o AS (SELECT q.query_id, CASE query_id % 3 WHEN 0 THEN 'ref' WHEN 1 THEN 'title' ELSE 'alias' END AS category, query_id % 7 = 0 AS negative, min(rank) FILTER (ref = expected) AS rank, count(ref) AS hits, coalesce(bool_or(ref = expected AND tier < 3), false) AS evidence_ok FROM q LEFT JOIN hit USING (query_id) GROUP BY ALL),
b AS (SELECT category, negative, rank, hits, evidence_ok FROM o UNION ALL SELECT 'all', negative, rank, hits, evidence_ok FROM o)
SELECT category, count(*) FILTER (NOT negative) AS positives, count(*) FILTER (negative) AS negatives, round(avg((coalesce(rank, 99) <= 1)::INTEGER) FILTER (NOT negative), 6) AS recall_1, round(avg((coalesce(rank, 99) <= 5)::INTEGER) FILTER (NOT negative), 6) AS recall_5,
  round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0.0 END) FILTER (NOT negative), 6) AS mrr, round(avg((hits = 0)::INTEGER) FILTER (negative), 6) AS no_match,
  round(avg(evidence_ok::INTEGER) FILTER (NOT negative), 6) AS evidence_correct FROM b GROUP BY category""")
def retrieval_metrics(spark, d):
    q, hits = _exact(spark, d)
    met = hits.join(q.select("query_id", "expected"), "query_id")
    own = F.col("ref") == F.col("expected")
    of = met.groupBy("query_id").agg(F.min(F.when(own, F.col("rank"))).alias("rank"), F.count("*").alias("hits"), F.bool_or(own & (F.col("tier") < 3)).alias("evidence_ok"))
    n = F.col("query_id")
    category = F.when(n % 3 == 0, F.lit("ref")).when(n % 3 == 1, F.lit("title")).otherwise(F.lit("alias"))
    rows = q.select("query_id").join(of, "query_id", "left").select(category.alias("category"), (n % 7 == 0).alias("negative"), "rank", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("evidence_ok", F.lit(False)).alias("evidence_ok"))
    return search.retrieval_metrics(rows)


@query("""
WITH s AS (SELECT 'c' || o_custkey AS source_id, count(*) AS size FROM orders GROUP BY 1), r AS (SELECT CASE WHEN l_orderkey % 11 = 0 THEN 'bad ' || l_orderkey ELSE 'c' || (l_suppkey * 20) || '#' || CASE WHEN l_linenumber % 2 = 0 THEN 'entry' ELSE 'seq' END || '-' || l_linenumber END AS ref FROM lineitem),
p AS (SELECT ref, nullif(regexp_extract(ref, '^(.+)#(entry|seq)-([0-9]+)$', 1), '') AS source_id, TRY_CAST(regexp_extract(ref, '^(.+)#(entry|seq)-([0-9]+)$', 3) AS BIGINT) AS ordinal FROM r)
SELECT ref, p.source_id, ordinal, CASE WHEN p.source_id IS NULL THEN 'malformed' WHEN size IS NULL THEN 'unknown_source' WHEN ordinal >= size THEN 'out_of_range' ELSE 'resolved' END AS status FROM p LEFT JOIN s USING (source_id)
""")
def trace_evidence(spark, d):
    sources = A.table(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id")).agg(F.count("*").alias("size"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, F.lit("entry")).otherwise(F.lit("seq"))
    ref = F.concat(F.lit("c"), (F.col("l_suppkey") * 20).cast("string"), F.lit("#"), kind, F.lit("-"), F.col("l_linenumber").cast("string"))
    refs = A.table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 11 == 0, F.concat(F.lit("bad "), F.col("l_orderkey").cast("string"))).otherwise(ref).alias("ref"))
    return provenance.trace(refs, sources)


@query("""
WITH l AS (SELECT l_partkey AS ref, list(DISTINCT l_suppkey) AS e FROM lineitem WHERE l_quantity < 25 GROUP BY 1), r AS (SELECT l_partkey AS ref, list(DISTINCT l_suppkey) AS e FROM lineitem WHERE l_quantity >= 25 GROUP BY 1)
SELECT coalesce(l.ref, r.ref) AS ref, array_to_string(list_sort(list_distinct(list_concat(coalesce(l.e, []), coalesce(r.e, [])))), ',') AS evidence, CASE WHEN l.ref IS NULL THEN 'right' WHEN r.ref IS NULL THEN 'left' ELSE 'both' END AS origin FROM l FULL JOIN r ON l.ref = r.ref
""")
def merge_records(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("ref"), "l_suppkey", "l_quantity")
    side = lambda c: li.where(c).groupBy("ref").agg(F.collect_set("l_suppkey").alias("evidence"))
    merged = provenance.merge_records(side("l_quantity < 25"), side("l_quantity >= 25"), "ref", "evidence")
    return merged.withColumn("evidence", F.array_join(F.transform(F.array_sort("evidence"), lambda x: x.cast("string")), ","))


@query("""
WITH a AS (SELECT p_partkey AS ref, 1 AS position, p_name AS alias FROM part UNION ALL SELECT p_partkey, 2, upper(p_name) FROM part UNION ALL SELECT p_partkey, 3, p_brand FROM part)
SELECT ref, lower(alias) AS norm, alias FROM a QUALIFY row_number() OVER (PARTITION BY ref, lower(alias) ORDER BY position, alias) = 1
""")
def knowledge_aliases(spark, d):
    p = A.table(spark, d, "part")
    every = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("position"), c.alias("alias")) for k, c in enumerate((F.col("p_name"), F.upper("p_name"), F.col("p_brand")))])).alias("a")
    return knowledge.aliases(p.select(F.col("p_partkey").alias("ref"), every).select("ref", "a.*"))


@query("""
WITH f AS (SELECT l_partkey AS ref, l_suppkey::VARCHAR AS evidence_ref, min(l_orderkey) AS position FROM lineitem GROUP BY ALL)
SELECT ref, (row_number() OVER (PARTITION BY ref ORDER BY position, evidence_ref) - 1)::INTEGER AS ordinal, evidence_ref FROM f
""")
def knowledge_evidence(spark, d):
    li = A.table(spark, d, "lineitem")
    return knowledge.evidence(li.select(F.col("l_partkey").alias("ref"), F.col("l_orderkey").alias("position"), F.col("l_suppkey").cast("string").alias("evidence_ref")))


@query("""
WITH f AS (SELECT l_partkey AS ref, l_suppkey::VARCHAR AS evidence_ref, min(l_orderkey) AS position FROM lineitem GROUP BY ALL), o AS (SELECT ref, evidence_ref, row_number() OVER (PARTITION BY ref ORDER BY position, evidence_ref) AS k FROM f)
SELECT ref, string_agg(evidence_ref, ',' ORDER BY k) AS evidence FROM o WHERE k <= 8 GROUP BY 1
""")
def evidence_top(spark, d):
    return consistency.top_evidence(knowledge_evidence(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


@query("""
SELECT 'order-' || o_orderkey AS source_id, count(*) AS size, 'har' AS kind FROM (SELECT DISTINCT o_orderkey FROM orders) GROUP BY 1 UNION ALL SELECT 'part-' || p_partkey, p_size::BIGINT, 'web' FROM part
""")
def provenance_registry(spark, d):
    from tessera.sources.registry import source_catalog

    o = A.table(spark, d, "orders").select("o_orderkey").distinct()
    web = A.table(spark, d, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("source_id"), F.col("p_size").cast("long").alias("size"))
    return source_catalog(har=o.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("source_id"), F.lit(1).cast("long").alias("size")), web=web)


@query("""
SELECT p_partkey AS ref, coalesce(array_to_string(list_sort(list_distinct(list('s' || l_suppkey % 9) FILTER (l_suppkey IS NOT NULL))), ','), '') AS categories FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1
""")
def knowledge_enrichment(spark, d):
    li = A.table(spark, d, "lineitem").join(A.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    named = li.select(F.col("l_partkey").alias("ref"), F.concat(F.lit("s"), (F.col("l_suppkey") % 9).cast("string")).alias("category"))
    rich = knowledge.enrich(A.table(spark, d, "part").select(F.col("p_partkey").alias("ref")), named, "ref")
    return rich.select("ref", F.array_join("categories", ",").alias("categories"))


@query(f"""{_NOVEL}, f AS (SELECT DISTINCT session_id, change_id, kind, method, path, rule FROM nv),
b AS (SELECT session_id, '"findings":[' || string_agg('{{"change_id":"' || change_id || '","kind":"' || kind || '","method":"' || method || '","path":"' || path || '","rule":"' || rule || '"}}', ',' ORDER BY change_id) || '],"profile":"p\\"1","session_id":"' || session_id || '"}}' AS t FROM f GROUP BY 1)
SELECT session_id, 'promotion.' || sha256('{{' || t) AS bundle_id, sha256('{{"bundle_id":"promotion.' || sha256('{{' || t) || '",' || t) AS payload_sha256 FROM b""")
def promotion_bundles(spark, d):
    return knowledge.bundles(_found(spark, d), 'p"1').select("session_id", "bundle_id", "payload_sha256")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'k' WHEN 1 THEN 'a,k' WHEN 2 THEN 'x,y' END AS keys FROM events
""")
def body_keys(spark, d):
    from tessera.sources.frames import body_keys as keys

    e, n = A.table(spark, d, "events"), F.col("event_id") % 4
    body = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("["), "props", F.lit(',{"a":1,"token":2}]'))).when(n == 2, F.lit("x=1&y=2&x=3&session_id=4")).otherwise(F.lit("plain"))
    kind = F.when(n < 2, F.lit("application/json")).when(n == 2, F.lit("application/x-www-form-urlencoded")).otherwise(F.lit("text/plain"))
    return e.select("event_id", F.array_join(keys(body, kind), ",").alias("keys"))


# Experiments

_SLICES = """b AS (SELECT l_partkey AS product_id, coalesce(sum(l_quantity::BIGINT) FILTER (l_linenumber <= 3), 0)::BIGINT AS volume, count(*) FILTER (l_linenumber <= 3) AS lines FROM lineitem GROUP BY 1),
a AS (SELECT l_partkey AS product_id, coalesce(sum(l_quantity::BIGINT) FILTER (l_linenumber > 3), 0)::BIGINT AS volume, count(*) FILTER (l_linenumber > 3) AS lines FROM lineitem GROUP BY 1),
r AS (SELECT product_id, unnest(['volume', 'lines']) AS field, unnest([b.volume, b.lines])::DOUBLE AS before, unnest([a.volume, a.lines])::DOUBLE AS after FROM a JOIN b USING (product_id))"""


def _deltas(spark, d):
    li = A.table(spark, d, "lineitem")
    side = lambda c: li.groupBy(F.col("l_partkey").alias("product_id")).agg(F.coalesce(F.sum(F.when(F.expr(c), F.col("l_quantity").cast("long"))), F.lit(0)).alias("volume"), F.count_if(F.expr(c)).alias("lines"))
    return experiments.deltas(side("l_linenumber <= 3"), side("l_linenumber > 3"), ["product_id"], ["volume", "lines"])


@query(f"WITH {_SLICES} SELECT count(*) FILTER (before <> after AND product_id <> 1) AS untouched_changed_rows FROM r")
def untouched_changes(spark, d):
    return experiments.untouched_changes(_deltas(spark, d), "product_id", 1)


@query(f"WITH {_SLICES} SELECT product_id, field, before, after, after - before AS delta, before <> after AS changed FROM r")
def delta_rows(spark, d):
    return _deltas(spark, d)


@query(f"WITH {_SLICES} SELECT count(*) FILTER (before <> after) AS changed_rows, count(*) FILTER (before = after) AS unchanged_rows, count(DISTINCT product_id) FILTER (before <> after) AS changed_products FROM r")
def delta_summary(spark, d):
    return experiments.delta_summary(_deltas(spark, d), "product_id")


@query(f"""WITH {_SLICES}, e AS (SELECT *, ['increase', 'decrease', 'change', 'unchanged'][(product_id % 4 + 1)::INTEGER] AS expected FROM r WHERE field = 'volume')
SELECT product_id, expected, CASE WHEN product_id % 10 = 0 THEN 'inconclusive' WHEN before = after THEN 'refuted' WHEN expected = 'change' THEN 'confirmed' WHEN expected = CASE WHEN after > before THEN 'increase' ELSE 'decrease' END THEN 'confirmed' ELSE 'refuted' END AS outcome FROM e""")
def experiment_outcome(spark, d):
    rows = _deltas(spark, d).where("field = 'volume'")
    expected = F.element_at(F.array(*map(F.lit, ("increase", "decrease", "change", "unchanged"))), (F.col("product_id") % 4 + 1).cast("int"))
    told = rows.withColumn("expected", expected)
    return told.select("product_id", "expected", experiments.outcome(F.col("expected"), F.col("changed"), F.col("delta"), F.col("product_id") % 10 == 0).alias("outcome"))


@query("""
WITH o AS (SELECT o_custkey, row_number() OVER w AS n, o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER w AS same FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, count(*) AS reads, CASE WHEN count(*) >= 3 THEN bool_and(same) FILTER (n > 1) END AS converged FROM o GROUP BY 1
""")
def convergence(spark, d):
    o = A.table(spark, d, "orders").withColumn("_at", F.struct("o_orderdate", "o_orderkey"))
    return experiments.converged(o, ["o_custkey"], "_at", "o_orderstatus")


# Streams


def _event_stream(spark, d):
    """The events as a stream, in the order in which they were numbered at the source: the sequence is the id."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 64).parquet(f"{d}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("int")
    kind, text_ = F.col("event_type"), lambda c: c.cast("string")
    return e.select(
        text_(F.col("user_id")).alias("session_id"), text_(F.col("event_id")).alias("event_id"), F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("at"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), kind.isin("click", "signup").alias("is_action"), text_(F.col("user_id")).alias("target"),
        F.concat(F.lit("f"), text_(k % 3)).alias("frame"), F.concat(F.lit("/k/"), text_(k % 10)).alias("path"), F.when(kind.isin("signup", "purchase"), "POST").otherwise("GET").alias("method"),
        F.when(kind == "signup", "submit").otherwise("click").alias("kind"), (F.col("event_id") % 2 == 0).alias("trusted"), (F.col("event_id") % 3 == 0).alias("gesture"),
        kind.alias("raw_type"), k.alias("k"),
    )


@query(f"WITH {_LINK} SELECT session_id, action_event_id, network_event_id, status, round(raw, 4) AS score, round(d * 1000, 3) AS delta_ms FROM link")
def stream_correlation(spark, d):
    """Actions and requests as a stream; failed requests are neither."""
    from tessera.streaming.matcher import match_stream
    from tessera.streaming.state import keyed_state

    where = new_folder(spark, "stream")
    found = match_stream(_event_stream(spark, d).where("raw_type <> 'error'"), TIMING, idle=2 * A.WINDOW)
    sink = found.writeStream.format("parquet").option("path", f"{where}/links").option("checkpointLocation", f"{where}/checkpoint").outputMode("append")
    with keyed_state(spark):
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{where}/links")


_SESSION_END = "CASE WHEN event_type = 'purchase' AND k >= 80 THEN 'completed' WHEN event_type = 'signup' AND k >= 90 THEN 'cancelled' END"


@query(f"""
WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS session_id, event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d') AS day, event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events),
ends AS (SELECT session_id, min(event_id) AS at_end, arg_min(ended, event_id) AS status FROM (SELECT *, {_SESSION_END} AS ended FROM e) WHERE ended IS NOT NULL GROUP BY 1),
kept AS (SELECT e.*, status FROM e LEFT JOIN ends USING (session_id) WHERE at_end IS NULL OR event_id <= at_end),
refs AS (SELECT session_id, count(DISTINCT k % 7) AS artifact_count FROM kept WHERE event_type IN ('signup', 'purchase') GROUP BY 1),
warned AS (SELECT session_id, list(message ORDER BY first) AS warnings FROM (SELECT session_id, 'failed: /k/' || (k % 10) AS message, min(event_id) AS first FROM kept WHERE event_type = 'error' GROUP BY 1, 2) GROUP BY 1)
SELECT '1.0' AS schema_version, session_id, strftime(make_timestamp(min(ms) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS started_at, strftime(make_timestamp(max(ms) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS ended_at,
  coalesce(any_value(status), 'failed') AS status, 'events/day=' || min(day) AS event_files, coalesce(any_value(artifact_count), 0) AS artifact_count, count(*) AS event_count,
  coalesce(array_to_string(any_value(warnings), ','), '') AS warnings
FROM kept LEFT JOIN refs USING (session_id) LEFT JOIN warned USING (session_id) GROUP BY session_id
HAVING any_value(status) IS NOT NULL OR max(ms) + 7200000 < (SELECT max(ms) - 600000 FROM e)
""")
def session_manifests(spark, d):
    """Manifests of users' days, closed by a purchase, a signup or two silent hours; the run is started again at its end and adds nothing."""
    from tessera.streaming.manifests import MANIFEST, write_manifests

    where = new_folder(spark, "stream")
    e = _event_stream(spark, d)
    day, post = F.date_format("at", "yyyy-MM-dd"), F.col("raw_type").isin("signup", "purchase")
    rows = e.select(
        F.concat_ws("/", "session_id", day).alias("session_id"), "sequence", "at", F.concat(F.lit("events/day="), day).alias("file"),
        F.when(post, F.array(F.concat(F.lit("sha256:"), F.sha2((F.col("k") % 7).cast("string"), 256)))).alias("refs"),
        F.when(F.col("raw_type") == "error", F.concat(F.lit("failed: "), "path")).alias("warning"),
        F.when((F.col("raw_type") == "purchase") & (F.col("k") >= 80), "completed").when((F.col("raw_type") == "signup") & (F.col("k") >= 90), "cancelled").alias("ended"),
    )
    for _ in range(2):
        write_manifests(rows, f"{where}/sessions", f"{where}/checkpoint", idle=7200.0).awaitTermination()
    return spark.read.schema(MANIFEST).json(f"{where}/sessions").drop("day").withColumns({c: F.array_join(c, ",") for c in ("event_files", "warnings")})


@query(f"""{_NOVEL}, {_STARTED}, f AS (SELECT DISTINCT change_id, session_id, started_at FROM nv JOIN s USING (session_id))
SELECT change_id, min(started_at) AS first_seen, max(started_at) AS last_seen, count(*) AS occurrences FROM f GROUP BY 1""")
def stream_checkpoint_rerun(spark, d):
    """Findings delivered in two batches, the second one twice: the history is as after one delivery."""
    from tessera.streaming.changes import ChangeHistory

    seen = _found(spark, d).select("change_id", "session_id", "started_at", F.sha2("session_id", 256).alias("evidence_sha256"))
    early = F.col("started_at") < "2024-01-01T06:00:00"
    history = ChangeHistory(spark, new_folder(spark, "stream"), buckets=8)
    history.apply(seen.where(early), 0)
    history.apply(seen.where(~early), 1)
    history.apply(seen.where(~early), 1)
    history.apply(seen, 2)  # sessions that are done already
    return history.latest(2).drop("profile")
