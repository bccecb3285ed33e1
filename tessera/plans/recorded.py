"""Registered queries of recorded evidence: contexts, schemas, verified files, manifests against files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import api
from tessera.functions import normalise, pages
from tessera.functions.schema import compile_schema
from tessera.operators import census, consistency, contexts, correlate, current, datasets, detect, experiments, knowledge, market, projectors
from tessera.plans import adapters as A
from tessera.plans import captured
from tessera.plans import queries as Q
from tessera.sources import evidence
from tessera.sources.generations import Generations
from tessera.sources.postings import PostingIndex
from tessera.sources.shared import new_folder

query = Q.query


# Execution contexts: views create them, failures destroy one or clear all, other events are calls of the binding


def _frames(spark, d):
    e = A.table(spark, d, "events")
    k, n, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_id"), F.col("event_type")
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), n.alias("sequence"),
        F.when(kind == "view", contexts.CREATED).when((kind == "error") & (k % 4 == 0), contexts.CLEARED).when(kind == "error", contexts.DESTROYED).otherwise(contexts.CALLED).alias("method"),
        F.when(~((kind == "error") & (k % 4 == 0)), k % 5).alias("context_id"), F.concat(F.lit("f"), (n % 4).cast("string")).alias("frame_id"),
        F.when(n % 3 == 0, "page").otherwise("observer").alias("world"), F.when(n % 4 == 0, "https://other.net/a").when(n % 7 > 0, "https://www.example.com/b").alias("origin"),
        F.when(k % 6 == 0, "other").otherwise("send").alias("name"), F.when(n % 11 > 0, n.cast("string")).alias("payload"),
    )


@query("""
WITH f AS (
  SELECT user_id::VARCHAR AS session_id, event_id AS n, event_type AS kind, json_extract_string(props, '$.k')::INTEGER AS k,
    CASE WHEN event_type = 'error' AND json_extract_string(props, '$.k')::INTEGER % 4 = 0 THEN NULL ELSE json_extract_string(props, '$.k')::INTEGER % 5 END AS context_id FROM events
), t AS (
  SELECT *, last_value(CASE WHEN kind = 'view' THEN n WHEN kind = 'error' AND context_id IS NOT NULL THEN -1 END IGNORE NULLS) OVER (PARTITION BY session_id, context_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS made,
    last_value(CASE WHEN kind = 'error' AND context_id IS NULL THEN n END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS cleared FROM f
)
SELECT session_id, n AS sequence, context_id, n::VARCHAR AS payload, 'f' || (made % 4) AS frame_id, 'https://www.example.com/b' AS origin
FROM t WHERE kind NOT IN ('view', 'error') AND k % 6 <> 0 AND n % 11 > 0 AND made >= 0 AND (cleared IS NULL OR made > cleared) AND made % 3 <> 0 AND made % 4 <> 0 AND made % 7 > 0
""")
def observed_calls(spark, d):
    """Calls of the binding whose context is registered, in the observer's world and first-party at that moment."""
    ours = normalise.first_party(normalise.url_host(F.col("origin")), "example.com")
    return contexts.observed_calls(_frames(spark, d), binding="send", world="observer", first_party=ours)


# Schemas

ORDER_SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "required": ["id", "status", "customer", "placed"],
    "properties": {
        "id": {"type": "integer", "minimum": 1},
        "status": {"enum": ["F", "O"]},
        "total": {"type": ["number", "null"], "exclusiveMaximum": 300000},
        "placed": {"type": "string", "format": "date"},
        "tags": {"type": "array", "items": {"type": "string", "pattern": "^[1-5A-Za-z]", "maxLength": 14}, "minItems": 1, "uniqueItems": True},
        "customer": {"$ref": "#/$defs/customer"},
        "clerk": {"type": "string", "minLength": 1},
    },
    "additionalProperties": False,
    "if": {"properties": {"status": {"const": "F"}}},
    "then": {"required": ["clerk"]},
    "$defs": {"customer": {"type": "object", "required": ["key"], "properties": {"key": {"type": "integer", "minimum": 100}, "kind": {"oneOf": [{"type": "null"}, {"type": "string", "maxLength": 1}]}}, "maxProperties": 2}},
}


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS t, o_orderpriority AS p FROM orders)
SELECT k AS o_orderkey, '$.status' AS path, 'enum' AS rule FROM o WHERE s NOT IN ('F', 'O') UNION ALL
SELECT k, '$.total', 'exclusiveMaximum' FROM o WHERE t >= 300000 AND k % 9 <> 0 UNION ALL
SELECT k, '$.placed', 'format' FROM o WHERE k % 17 = 0 UNION ALL
SELECT k, '$.placed', 'required' FROM o WHERE k % 19 = 0 AND k % 17 <> 0 UNION ALL
SELECT k, '$.id', 'minimum' FROM o WHERE k < 1 UNION ALL
SELECT k, '$.tags[0]', 'maxLength' FROM o WHERE length(p) > 14 UNION ALL
SELECT k, '$.tags[1]', 'maxLength' FROM o WHERE length(p) > 14 AND k % 7 = 2 UNION ALL
SELECT k, '$.tags[1]', 'pattern' FROM o WHERE k % 7 = 1 UNION ALL
SELECT k, '$.tags', 'uniqueItems' FROM o WHERE k % 7 = 2 UNION ALL
SELECT k, '$.customer.key', 'minimum' FROM o WHERE c < 100 UNION ALL
SELECT k, '$.customer.kind', 'oneOf' FROM o WHERE k % 5 = 3 UNION ALL
SELECT k, '$.more', 'additionalProperties' FROM o WHERE k % 13 = 0 UNION ALL
SELECT k, '$.clerk', 'required' FROM o WHERE s = 'F' AND k % 2 = 0
""")
def schema_violations(spark, d):
    """Orders as JSON documents, with what breaks the schema in some of them."""
    o = A.table(spark, d, "orders")
    k = F.col("o_orderkey")
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    when = lambda c, text: F.when(c, text).otherwise(F.lit(""))
    second = F.when(k % 7 == 1, F.lit(',"?"')).when(k % 7 == 2, F.concat(F.lit(","), quoted(F.col("o_orderpriority")))).otherwise(F.lit(""))
    kind = F.when(k % 5 == 3, F.lit('"ab"')).when(k % 5 == 4, F.lit("null")).otherwise(F.lit('"a"'))
    placed = F.when(k % 17 == 0, F.lit(',"placed":"1995-02-30"')).when(k % 19 == 0, F.lit("")).otherwise(F.lit(',"placed":"1995-02-28"'))
    text = F.concat(
        F.lit('{"id":'), k.cast("string"), F.lit(',"status":'), quoted(F.col("o_orderstatus")), F.lit(',"total":'), F.when(k % 9 == 0, F.lit("null")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        placed, F.lit(',"tags":['), quoted(F.col("o_orderpriority")), second, F.lit('],"customer":{"key":'), F.col("o_custkey").cast("string"), F.lit(',"kind":'), kind, F.lit("}"),
        when(k % 2 == 1, F.lit(',"clerk":"c"')), when(k % 13 == 0, F.lit(',"more":1')), F.lit("}"),
    )
    return o.select("o_orderkey", F.explode(compile_schema(ORDER_SCHEMA)(text)).alias("v")).select("o_orderkey", "v.path", "v.rule")


# Verified files


@query("SELECT user_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence, event_id::VARCHAR AS event_id, 'k' || event_type AS event_type FROM events")
def verified_snapshot(spark, d):
    """Events written as JSON lines and read back through their digests, the same bytes for both."""
    from pyspark.sql import Window

    e = A.table(spark, d, "events")
    rows = e.select(
        F.lit("1.0").alias("schema_version"), F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("session_id"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("sequence"), F.col("ts").cast("string").alias("observed_at"), F.lit(0.5).alias("monotonic_time"),
        F.lit("system").alias("source"), F.concat(F.lit("k"), "event_type").alias("event_type"), F.lit("observed").alias("confidence"),
    )
    where = new_folder(spark, "snapshot")
    rows.write.json(f"{where}/events")
    evidence.snapshot_identity(spark, f"{where}/events/*.json").select("path", "sha256").write.parquet(f"{where}/known")
    found = evidence.verified_events(spark, f"{where}/events/*.json", expected=spark.read.parquet(f"{where}/known"))
    return found.select("session_id", "sequence", "event_id", "event_type")


@query("""
WITH e AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS day FROM events),
n AS (SELECT user_id, count(*) AS n, list(DISTINCT day) AS days FROM e GROUP BY 1)
SELECT user_id::VARCHAR AS session_id, 'number of events differs' AS problem FROM n WHERE user_id % 10 = 1 UNION ALL
SELECT user_id::VARCHAR, 'no manifest' FROM n WHERE user_id % 10 = 2 UNION ALL
SELECT user_id::VARCHAR, 'no events in day=none' FROM n WHERE user_id % 10 = 3 UNION ALL
SELECT DISTINCT user_id::VARCHAR, 'not listed: day=' || day FROM e WHERE user_id % 10 = 4 AND day = (SELECT min(day) FROM e) UNION ALL
SELECT user_id::VARCHAR, 'more than one manifest' FROM n WHERE user_id % 10 = 5
""")
def manifest_problems(spark, d):
    """Users' manifests against their events; some count wrong, list too much or too little, stand twice, or are missing."""
    e = A.table(spark, d, "events").select(F.col("user_id").alias("u"), F.concat(F.lit("day="), F.date_format("ts", "yyyy-MM-dd")).alias("file"))
    first = e.agg(F.min("file").alias("first"))
    made = e.groupBy("u").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("file")).alias("files")).join(F.broadcast(first))  # one row
    kind = F.col("u") % 10
    files = F.when(kind == 3, F.concat("files", F.array(F.lit("day=none")))).when(kind == 4, F.array_remove(F.col("files"), F.col("first"))).otherwise(F.col("files"))
    manifests = made.where(kind != 2).select(
        F.col("u").cast("string").alias("session_id"), files.alias("event_files"), (F.col("n") + (kind == 1).cast("long")).alias("event_count"), F.when(kind == 6, "cancelled").otherwise("completed").alias("status"),
        F.explode(F.when(kind == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_k"),
    ).drop("_k")
    return evidence.manifest_problems(manifests, e.select(F.col("u").cast("string").alias("session_id"), "file")).distinct()


# The matcher by sequence


@query(f"WITH {Q._LINK} SELECT session_id, action_event_id, network_event_id, status, round(raw, 4) AS score, round(d * 1000, 3) AS delta_ms FROM link")
def correlation_sequenced(spark, d):
    """Links of all users by the sequence of their events; tests compare disordered clocks and large sessions with the fold."""
    rows = A.events(spark, d).where("event_type <> 'http.failed'").withColumn("is_action", F.col("source") == "dom.action")
    return correlate.correlate_sequenced(rows, Q.TIMING)


# Generations, pages and the index in files


@query(f"WITH {A.UNIT_PRODUCTS} SELECT unit_id, product_id, observed_at, sales_volume, our_price FROM latest")
def sealed_generation(spark, d):
    """The state that is shown after three rebuilds, of which the last was not finished."""
    rows = A.unit_products(spark, d)
    g = Generations(spark, new_folder(spark, "generations"))
    state = lambda r: current.latest_state(r, A.STATE_KEYS, A.STATE_ORDER)
    g.publish("1", {"products": state(rows.where("o1 % 2 = 0")), "units": rows.select("unit_id").distinct()})
    g.write("2", {"products": state(rows)})
    g.seal("2", ["products"], taken={"units": "1"})
    g.write("3", {"products": state(rows.where("o1 % 3 = 0"))})
    return g.load()["products"].select("unit_id", "product_id", "observed_at", "sales_volume", "our_price")


@query(f"SELECT change_id, first_seen, last_seen, occurrences FROM ({Q.SQL['change_rollup']}) WHERE occurrences % 3 = 1 ORDER BY change_id LIMIT 30")
def change_pages(spark, d):
    """Two pages of the changes of one profile, from files in the order of profile and id, and each change got by its key."""
    w = api.Workspace(spark, new_folder(spark, "changes"))
    found = detect.change_rollup(Q._found(spark, d)).withColumn("profile", F.concat(F.lit("p"), (F.col("occurrences") % 3).cast("string")))
    w.generations.write("1", {"changes": found})
    keys = ["profile", "change_id"]
    w.sort("1", "changes", keys, per_file=20)
    w.generations.seal("1", ["changes"])
    first, after = w.page("1", "changes", keys, limit=15, prefix=("p1",))
    second, _ = w.page("1", "changes", keys, limit=15, after=after, prefix=("p1",)) if after else ([], None)
    page = spark.createDataFrame([(r["change_id"],) for r in [*first, *second]], "change_id string")  # two pages
    return w.generations.table("changes").join(page, "change_id").where("profile = 'p1'").select("change_id", "first_seen", "last_seen", "occurrences")


@query("SELECT o_orderpriority AS surface, o_custkey AS request_key, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_custkey, o_orderkey LIMIT 200")
def market_pages(spark, d):
    """Two pages of one surface of the market log, in the order of its requests."""
    w = api.Workspace(spark, new_folder(spark, "market"))
    log = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("surface"), F.col("o_custkey").alias("request_key"), "o_orderkey", "o_totalprice")
    w.generations.write("1", {"log": log})
    keys = ["surface", "request_key", "o_orderkey"]
    w.sort("1", "log", keys, per_file=500)
    first, after = w.page("1", "log", keys, limit=100, prefix=("1-URGENT",))
    second, _ = w.page("1", "log", keys, limit=100, after=after, prefix=("1-URGENT",)) if after else ([], None)
    return spark.createDataFrame([tuple(r)[:4] for r in [*first, *second]], log.schema)  # two pages


@query(Q.SQL["search_bm25"].replace("SELECT query_id, rank::INTEGER AS rank, ref, score", "SELECT query_id, rank::INTEGER AS rank, ref::VARCHAR AS ref, score").replace("score DESC, ref)", "score DESC, ref::VARCHAR)"))
def postings_search(spark, d):
    """Benchmark texts asked of an index in files that was brought to the documents in three updates."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("ref"), "text")
    index = PostingIndex(spark, new_folder(spark, "postings"), buckets=16)
    index.update(docs.withColumn("text", F.when(F.crc32("ref") % 4 == 0, F.concat(F.lit("old words "), F.substring("text", 1, 200))).otherwise(F.col("text"))).where("crc32(ref) % 5 > 0"))
    index.update(docs.union(spark.createDataFrame([("gone", "the and of")], docs.schema)))
    index.update(docs)
    asked = A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.search(asked)


# Contracts, attributes and forms


@query("""
WITH o AS (SELECT o_orderkey AS k, '/o/' || (o_orderkey % 50) AS path, CASE WHEN o_orderstatus = 'F' THEN 'POST' ELSE 'GET' END AS method, o_custkey AS c FROM orders),
l AS (SELECT '/o/' || (l_partkey % 40) AS path, CASE WHEN l_linestatus = 'F' THEN 'POST' ELSE 'GET' END AS method, ['q' || (l_linenumber % 5), 'z'] AS qs, ['f' || (l_suppkey % 4), 'id'] AS fs, [200 + l_linenumber % 3] AS ss FROM lineitem),
ops AS (SELECT path, method, list(DISTINCT qs) AS qs, list_distinct(flatten(list(fs))) AS fs, list_distinct(flatten(list(ss))) AS ss FROM l GROUP BY ALL),
a AS (SELECT o.*, ops.path IS NOT NULL AS known, ops.qs, ops.fs, ops.ss FROM o LEFT JOIN ops USING (path, method))
SELECT k AS action_id, 'no operation' AS problem FROM a WHERE NOT known UNION ALL
SELECT k, 'query shape of no operation' FROM a WHERE known AND NOT list_contains(qs, ['q' || (c % 6), 'z']) UNION ALL
SELECT k, 'field of no operation' FROM a WHERE known AND NOT list_contains(fs, 'f' || (c % 5)) UNION ALL
SELECT k, 'status of no operation' FROM a WHERE known AND NOT list_contains(ss, 200 + c % 4) UNION ALL
SELECT k, 'counts do not add up' FROM a WHERE c % 7 = 0
""")
def action_problems(spark, d):
    """Orders as action families against the operations that line items make."""
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    post = lambda c: F.when(F.col(c) == "F", "POST").otherwise("GET")
    c = F.col("o_custkey")
    actions = A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("action_id"), text("/o/", F.col("o_orderkey") % 50).alias("path"), post("o_orderstatus").alias("method"), F.array(text("f", c % 5), F.lit("id")).alias("fields"),
        F.array(F.array(F.lit("z"), text("q", c % 6))).alias("query_sets"), F.array((F.lit(200) + c % 4).cast("int")).alias("statuses"), F.lit(3).alias("observed_count"),
        F.array(F.when(c % 7 == 0, 2).otherwise(1), F.lit(2)).alias("status_counts"),
    )
    operations = A.table(spark, d, "lineitem").select(
        text("/o/", F.col("l_partkey") % 40).alias("path"), post("l_linestatus").alias("method"), F.array(text("q", F.col("l_linenumber") % 5), F.lit("z")).alias("query_keys"),
        F.array(text("f", F.col("l_suppkey") % 4), F.lit("id")).alias("body_keys"), F.array((F.lit(200) + F.col("l_linenumber") % 3).cast("int")).alias("statuses"),
    ).distinct()
    return consistency.action_problems(actions, operations)


@query("""
WITH p AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_type AS t, p_size AS s FROM part)
SELECT 'product:' || k AS key, array_to_string(list_filter(list_distinct_in_order, x -> x IS NOT NULL), '|') AS terms, 'p#' || k AS evidence FROM (
  SELECT k, [x FOR x, i IN every IF x IS NOT NULL AND list_position(every, x) = i] AS list_distinct_in_order FROM (
    SELECT k, flatten([[s || ' kg', CASE WHEN s % 2 = 0 THEN b END, t], CASE WHEN s % 3 = 0 THEN ['award', n] ELSE [] END, [n, CASE WHEN s % 5 = 0 THEN 'energy ' || s END],
      flatten(list_transform(range(1, s % 4 + 1), lambda i: ['s' || i, 'm' || i, i || ' pc']))]) AS every FROM p))
""".replace("x -> x IS NOT NULL", "lambda x: x IS NOT NULL"))
def attribute_documents(spark, d):
    """Parts as documents of attributes, awards and recipes of several materials, flattened to terms."""
    s, n = F.col("p_size"), F.col("p_name")
    piece = lambda i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("slug"), F.concat(F.lit("m"), i.cast("string")).alias("name"), F.concat(i.cast("string"), F.lit(" pc")).alias("quantity_text"))
    materials = F.when(s % 4 > 0, F.transform(F.sequence(F.lit(1), s % 4), piece)).otherwise(F.array().cast("array<struct<slug:string,name:string,quantity_text:string>>"))
    item = F.struct(
        F.concat(F.lit("product:"), F.col("p_partkey").cast("string")).alias("product_id"), F.lit("documented").alias("confidence"), F.concat(s.cast("string"), F.lit(" kg")).alias("weight_text"),
        F.when(s % 2 == 0, F.col("p_brand")).alias("storage"), F.col("p_type").alias("department"), F.array(F.concat(F.lit("p#"), F.col("p_partkey").cast("string"))).alias("evidence"),
        F.when(s % 3 == 0, F.array(F.struct(F.lit("award").alias("label"), n.alias("value")))).alias("awards"),
        F.struct(n.alias("output_name"), F.when(s % 5 == 0, F.concat(F.lit("energy "), s.cast("string"))).alias("energy_text"), materials.alias("materials")).alias("recipe"),
    )
    found = projectors.attribute_documents(A.table(spark, d, "part").select(F.to_json(item).alias("text")))
    return found.select("key", F.array_join("terms", "|").alias("terms"), F.array_join("evidence", "|").alias("evidence"))


@query("""
WITH f AS (SELECT page_id AS page, CASE WHEN page_id % 4 = 0 THEN 'GET' ELSE 'POST' END AS method, '/f/' || (page_id % 5) AS action,
  CASE WHEN page_id % 3 = 0 THEN '[{"name":"q","type":"text","value":"' || (page_id % 2) || '"}]' ELSE '[{"name":"q","type":"text","value":"' || (page_id % 2) || '"},{"name":"t","type":"textarea","value":null}]' END AS fields FROM pages)
SELECT substr(sha256('["' || method || '","' || action || '",' || fields || ']'), 1, 16) AS form_id, method, action, replace(fields, ',"value":null', '') AS fields, count(*) AS observed, min(page) AS first_seen FROM f GROUP BY ALL
""")
def form_census(spark, d):
    """Every page with a form put at its end: the distinct forms, how many pages have them and which first."""
    n = F.col("page_id")
    text = lambda c: c.cast("string")
    form = F.concat(
        F.lit('<form action="/f/'), text(n % 5), F.lit('"'), F.when(n % 4 == 0, F.lit("")).otherwise(F.lit(' method="post"')), F.lit('><input type="text" name="q" value="'), text(n % 2), F.lit('"><input type="submit">'),
        F.when(n % 3 == 0, F.lit("")).otherwise(F.lit('<textarea name="t"></textarea>')), F.lit("</form>"),
    )
    p = A.table(spark, d, "pages").select(n.alias("page"), F.explode(pages.page_forms(F.concat("html", form))).alias("f"))
    return census.form_dedup(p.select("page", "f.form_id", "f.method", "f.action", F.to_json("f.fields").alias("fields")))


# Experiments and open requests


@query(f"""WITH {Q._SLICES}, e AS (SELECT *, ['increase', 'decrease', 'change', 'unchanged'][(product_id % 4 + 1)::INTEGER] AS expected, product_id % 10 = 0 AND product_id % 3 = 0 AS disturbed FROM r WHERE field = 'volume')
SELECT product_id AS experiment_id, CASE WHEN disturbed THEN 'inconclusive' WHEN before = after THEN 'refuted' WHEN expected = 'change' THEN 'confirmed' WHEN expected = CASE WHEN after > before THEN 'increase' ELSE 'decrease' END THEN 'confirmed' ELSE 'refuted' END AS outcome,
  before <> after AS changed, CASE WHEN product_id % 10 = 0 THEN true END AS control_unchanged FROM e""")
def experiment_evaluation(spark, d):
    """A hypothesis about the volume of every part, every tenth with a control, every third of which changed the same field."""
    rows, n = Q._deltas(spark, d), F.col("product_id")
    expected = F.element_at(F.array(*map(F.lit, ("increase", "decrease", "change", "unchanged"))), (n % 4 + 1).cast("int"))
    asked = rows.where("field = 'volume'").select("product_id", n.alias("experiment_id"), "field", F.lit("price").alias("changed_field"), expected.alias("expected"))
    controls = asked.where(n % 10 == 0).select("experiment_id", F.when(n % 3 == 0, "price").otherwise("supply").alias("changed_field"), F.lit(1.0).alias("before_value"), F.lit(1.0).alias("after_value"))
    return experiments.evaluate(rows, asked, controls, ["product_id"]).select("experiment_id", "outcome", "changed", "control_unchanged")


@query("""
WITH e AS (SELECT event_id // 4 AS request, event_id % 4 AS step, event_type, json_extract_string(props, '$.k')::INTEGER AS k, epoch_us(ts) // 1000 AS ms FROM events),
f AS (SELECT request, max(ms) AS seen, bool_or(step = 0) AS asked, bool_or(step = 1 AND k % 5 = 0) AS again, bool_or(step = 3 AND k % 7 <> 0) AS ended, bool_or(step = 3 AND event_type = 'error') AS failed,
  arg_max(k, step) FILTER (step < 2 AND (step = 0 OR k % 5 = 0)) AS path, max(CASE WHEN step = 2 THEN 200 + k % 3 END) AS status FROM e GROUP BY request)
SELECT 's' || (request % 10) AS session_id, request::VARCHAR AS request_id, '/k/' || path AS url_path, status::INTEGER AS status_code, CASE WHEN asked AND again THEN 1 ELSE 0 END AS hops,
  CASE WHEN ended THEN CASE WHEN failed THEN 'failed' ELSE 'finished' END ELSE 'open' END AS outcome
FROM f WHERE (asked OR again) AND (ended OR seen + 7200000 <= (SELECT max(ms) - 600000 FROM e))
""")
def stream_requests(spark, d):
    """Every four events as the frames of a request: asked for, redirected or not, answered, and finished, failed, or silent.

    One that is silent is given up when its last frame is two hours behind the watermark, which is ten minutes behind the
    last event; the few that are not at the end of the stream are still waited for and have no row yet.
    """
    from tessera.streaming.ingest import finished_requests
    from tessera.streaming.state import keyed_state

    e = Q._event_stream(spark, d)
    step, n = F.col("sequence") % 4, F.floor(F.col("sequence") / 4)
    kind = (
        F.when(step == 0, "http.request").when((step == 1) & (F.col("k") % 5 == 0), "http.request").when(step == 1, "http.data").when(step == 2, "http.response")
        .when(F.col("k") % 7 == 0, "http.data").when(F.col("raw_type") == "error", "http.failed").otherwise("http.finished")
    )
    frames = e.select(
        F.concat(F.lit("s"), (n % 10).cast("string")).alias("session_id"), n.cast("string").alias("request_id"), "sequence", "at", kind.alias("event_type"), F.lit("GET").alias("method"),
        F.concat(F.lit("/k/"), F.col("k").cast("string")).alias("url_path"), F.when(step == 2, (F.lit(200) + F.col("k") % 3).cast("int")).alias("status_code"), F.col("time").alias("monotonic_time"),
    )
    where = new_folder(spark, "stream")
    found = finished_requests(frames, idle=7200.0)
    sink = found.writeStream.format("parquet").option("path", f"{where}/requests").option("checkpointLocation", f"{where}/checkpoint").outputMode("append")
    with keyed_state(spark):
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{where}/requests").select("session_id", "request_id", "url_path", "status_code", "hops", "outcome")


# Outbox, orders and digests of parsed pages

_FIRST = f"""{Q._NOVEL}, {Q._STARTED}, one AS (SELECT DISTINCT n.session_id, started_at, change_id, kind, method, path, rule FROM nv n JOIN s USING (session_id)),
first AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY started_at, session_id) = 1),
b AS (SELECT session_id, min(started_at) AS created_at, '"findings":[' || string_agg('{{"change_id":"' || change_id || '","kind":"' || kind || '","method":"' || method || '","path":"' || path || '","rule":"' || rule || '"}}', ',' ORDER BY change_id) || '],"profile":"default","session_id":"' || session_id || '"}}' AS t FROM first GROUP BY 1),
o AS (SELECT session_id, created_at, 'promotion.' || sha256('{{' || t) AS bundle_id, sha256('{{"bundle_id":"promotion.' || sha256('{{' || t) || '",' || t) AS payload_sha256 FROM b)"""


def _history(spark, d):
    from tessera.streaming.changes import ChangeHistory

    seen = Q._found(spark, d).select("change_id", "session_id", "started_at", F.sha2("session_id", 256).alias("evidence_sha256"), "rule", "kind", "path", "method")
    history = ChangeHistory(spark, new_folder(spark, "history"), buckets=8)
    history.apply(seen.where("started_at < '2024-01-01T06:00:00'"), 0)
    history.apply(seen.where("started_at >= '2024-01-01T06:00:00'"), 1)
    return history


@query(f"{_FIRST} SELECT session_id, bundle_id, payload_sha256, created_at, 'pending' AS state FROM o")
def change_outbox(spark, d):
    """The outbox after two batches: each session with the findings that it was the first to have."""
    return _history(spark, d).outbox().select("session_id", "bundle_id", "payload_sha256", "created_at", "state")


@query(f"{_FIRST} SELECT (SELECT count(*) FROM o) AS written, 0 AS again, session_id, 'materialised' AS state FROM o")
def outbox_delivered(spark, d):
    """Bundles written and marked in one version; a second delivery finds nothing to do."""
    history = _history(spark, d)
    where = new_folder(spark, "bundles")
    n, again = history.deliver(where, 2), history.deliver(where, 3)
    written = spark.read.parquet(where).select("bundle_id")
    return history.outbox().join(written, "bundle_id").select(F.lit(n).cast("long").alias("written"), F.lit(again).alias("again"), "session_id", "state")


@query(f"{_FIRST} SELECT bundle_id, row_number() OVER (ORDER BY created_at, bundle_id) AS place FROM o WHERE session_id NOT LIKE '%1'")
def outbox_pending(spark, d):
    """Bundles that are not written yet, in the order in which they were made."""
    from tessera.operators.census import number_rows

    outbox = _history(spark, d).outbox()
    left = knowledge.pending(outbox, outbox.where("session_id LIKE '%1'"))
    return number_rows(left, ["created_at", "bundle_id"]).select("bundle_id", F.col("row").alias("place"))


@query("""
WITH e AS (SELECT o_orderkey AS entry, o_orderpriority AS capture FROM orders)
SELECT capture, entry, row_number() OVER (ORDER BY CASE capture WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, capture, entry) AS place FROM e
""")
def capture_order(spark, d):
    """Entries of captures in replay order: two captures that are named, then the others by name."""
    from tessera.operators.census import number_rows

    rows = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("capture"), F.col("o_orderkey").alias("entry"))
    placed = rows.select("*", *[c.alias(f"_o{k}") for k, c in enumerate(datasets.in_capture_order(("3-MEDIUM", "1-URGENT")))])
    return number_rows(placed, ["_o0", "_o1", "_o2"]).select("capture", "entry", F.col("row").alias("place"))


@query(f"""WITH v AS ({Q.SQL["vendor_products"]})
SELECT page_id, count(*) AS rows, sha256('[' || string_agg('{{"group_name":' || to_json(group_name)::VARCHAR || ',"product_id":' || product_id || '}}', ',' ORDER BY product_id) || ']') AS fingerprint FROM v GROUP BY 1""")
def parsed_page_fingerprints(spark, d):
    """Digests of what the vendor pages say, as they are parsed."""
    rows = captured.vendor_products(spark, d)
    return market.page_fingerprints(rows.withColumn("at", F.col("product_id")), ["page_id"], "at")
