"""Registered queries of published tables: records, search, pages, change history, and the checks of all of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import canonical
from tessera.operators import consistency, contract, detect, knowledge, projectors, search, snapshot
from tessera.plans import adapters as A
from tessera.plans.queries import _NOVEL, _STARTED, SQL, _endpoint_facts, _found, query
from tessera.sources.parts import publish
from tessera.sources.shared import materialise, new_folder

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# Change history


@query(f"""{_NOVEL}, f AS (SELECT DISTINCT change_id, 'p' || event_id::BIGINT % 2 AS profile, event_id::BIGINT % 3 AS part FROM nv)
SELECT DISTINCT profile, change_id FROM f WHERE (profile, change_id) IN (SELECT (profile, change_id) FROM f WHERE part = 0)""")
def existing_changes(spark, d):
    """Changes of a profile that a third of the events has shown already."""
    n = F.col("event_id").cast("long")
    found = detect.promotable(_endpoint_facts(spark, d)).select("change_id", F.concat(F.lit("p"), S(n % 2)).alias("profile"), (n % 3).alias("part"))
    return detect.existing_changes(found.where("part = 0"), found)


@query(f"""{_NOVEL}, {_STARTED}, f AS (SELECT DISTINCT change_id, rule, kind, session_id, started_at FROM nv JOIN s USING (session_id))
SELECT 'default' AS profile, change_id, rule AS rule_id, 1 AS rule_version, kind, 'NOVEL' AS novelty_class, min(started_at) AS first_seen, max(started_at) AS last_seen, count(*) AS occurrences FROM f GROUP BY ALL""")
def change_records(spark, d):
    found = _found(spark, d)
    return detect.change_records(detect.change_rollup(found), found)


@query("""
WITH b AS (SELECT o_custkey::VARCHAR AS session_id, o_orderstatus AS e FROM orders) SELECT session_id, count(DISTINCT e) AS n FROM b GROUP BY 1 HAVING count(DISTINCT e) > 1
""")
def evidence_conflicts(spark, d):
    """Customers as sessions, the states of their orders as evidence: finished ones are processed, the others come now."""
    o = A.table(spark, d, "orders").select(S("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("evidence_sha256"))
    return detect.evidence_conflicts(o.where("evidence_sha256 = 'F'"), o.where("evidence_sha256 <> 'F'"))


@query(f"""SELECT state, count(*) AS n FROM (SELECT state FROM ({SQL["endpoint_facts"]}) UNION ALL SELECT state FROM ({SQL["operation_facts"]}) UNION ALL SELECT state FROM ({SQL["form_facts"]})) GROUP BY 1""")
def detection_counts(spark, d):
    """Facts of endpoints, operations and forms together, by state, as the detector runs them."""
    ob = A.observations(spark, d)
    return api.detect_changes(ob.where("NOT known"), ob.where("known"))["counts"]


@query(f"SELECT sum(n)::BIGINT AS bundles FROM (SELECT count(*) AS n FROM ({SQL['promotion_bundles']}))")
def outbox_materialised(spark, d):
    """Bundles written twice: the second time there is nothing left to write."""
    where = f"{new_folder(spark, 'outbox')}/bundles"
    found = knowledge.bundles(_found(spark, d), 'p"1')
    knowledge.materialise(found, where)
    knowledge.materialise(found, where)
    return spark.read.schema("bundle_id string").parquet(where).agg(F.count("bundle_id").alias("bundles"))


@query("""
SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN ['$.a_value', '$.list[0].Cookie'] ELSE ['$.list[0].Cookie'] END) AS path FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, 'not JSON' FROM events WHERE event_id % 2 = 1 AND event_type = 'error'
""")
def privacy_audit(spark, d):
    n = F.col("event_id")
    odd = F.when((n % 2 == 1) & (F.col("event_type") == "error"), F.lit("no JSON")).otherwise(F.col("props"))
    doc = F.when(n % 2 == 0, F.concat(F.lit('{"x":'), "props", F.when(n % 3 == 0, F.lit(',"a_value":1')).otherwise(F.lit("")), F.lit(',"list":[{"Cookie":"c","v":{"k":1}}]}'))).otherwise(odd)
    return snapshot.privacy_audit(A.table(spark, d, "events").select("event_id", doc.alias("payload")), "event_id")


# Contracts

_OPS = f"WITH {A.OBSERVATIONS}, v AS (SELECT DISTINCT path, method, list_sort(query_keys) AS q, status FROM ob WHERE known), o AS (SELECT DISTINCT path, method, list_sort(query_keys) AS q FROM ob WHERE NOT known AND method = 'POST')"


@query(f"{_OPS} SELECT path, method, array_to_string(q, ',') AS query_keys, status FROM v UNION ALL SELECT path, method, array_to_string(q, ','), NULL FROM o WHERE (path, method, q) NOT IN (SELECT (path, method, q) FROM v)")
def merged_endpoints(spark, d):
    ob = A.observations(spark, d).withColumn("query_keys", F.array_sort("query_keys"))
    rows = contract.merge_endpoints(ob.where("known"), ob.where("NOT known AND method = 'POST'"))
    return rows.withColumn("query_keys", F.array_join("query_keys", ","))


@query(f"""WITH {A.OBSERVATIONS}, k AS (SELECT DISTINCT path, method, fields FROM ob WHERE known)
SELECT event_id AS action_id, path, method FROM ob o WHERE NOT known AND NOT EXISTS (SELECT 1 FROM k WHERE k.path = o.path AND k.method = o.method AND len(list_filter(o.fields, lambda x: NOT list_contains(k.fields, x))) = 0)""")
def actions_without_operation(spark, d):
    ob = A.observations(spark, d)
    actions = ob.where("NOT known").select(F.col("event_id").alias("action_id"), "path", "method", "fields")
    return consistency.actions_without_operation(actions, ob.where("known").select("path", "method", F.col("fields").alias("keys")))


@query(f"""WITH {A.OBSERVATIONS}, f AS (SELECT path, method, count(*) AS posts FROM ob WHERE method = 'POST' GROUP BY ALL), t AS (SELECT path, method, count(*) AS declared_posts FROM ob WHERE known AND method = 'POST' GROUP BY ALL)
SELECT path, method, posts, declared_posts FROM f FULL JOIN t USING (path, method) WHERE posts IS DISTINCT FROM declared_posts""")
def posts_disagree(spark, d):
    """Operations that were posted more often than the contract declares."""
    ob = A.observations(spark, d).where("method = 'POST'")
    none = spark.createDataFrame([], "pattern string")
    return contract.posts_disagree(contract.operation_signatures(ob, none), contract.operation_signatures(ob.where("known"), none))


# Records

_ROWS = """
  SELECT 'product:' || p_partkey AS ref, 'product' AS kind, p_name AS title, p_brand || chr(10) || p_type || ' ' || p_size AS body, upper(p_name) AS aliases, 'p#entry-' || p_partkey AS evidence FROM part
  UNION ALL SELECT 'entity:' || s_suppkey, 'entity', s_name, CASE WHEN s_suppkey::VARCHAR = s_nationkey::VARCHAR THEN 'balance nation ' || s_nationkey ELSE 'balance nation ' || s_nationkey || ' unit ' || s_suppkey END, '', 's#entry-' || s_suppkey FROM supplier WHERE s_suppkey <> s_nationkey
  UNION ALL SELECT 'entity:' || s_suppkey, 'entity', s_name, 'balance nation ' || s_nationkey || ' unit', '', 's#entry-' || s_suppkey FROM supplier WHERE s_suppkey = s_nationkey
  UNION ALL SELECT 'wiki:' || n_name, 'wiki', n_name, 'Nation ' || n_nationkey, 'n' || n_nationkey, 'w#entry-' || n_nationkey FROM nation
  UNION ALL SELECT 'action:o' || o_orderkey, 'action', o_orderpriority, 'POST /order/' || o_custkey || chr(10) || 'id status', 'o' || o_orderkey, 'o#seq-' || o_orderkey FROM orders
  UNION ALL SELECT 'ts.form.v1.' || substr(sha256('POST|/c/' || o_custkey || '|a,b'), 1, 24), 'form', 'POST /c/' || o_custkey, 'a b', '', 'f#entry-' || o_custkey FROM (SELECT DISTINCT o_custkey FROM orders)
  UNION ALL SELECT 'ts.operation.v1.' || substr(sha256('POST|/c/' || o_custkey || '|q|b'), 1, 24), 'operation', 'POST /c/' || o_custkey, 'q' || chr(10) || 'b', '', 'f#entry-' || o_custkey FROM (SELECT DISTINCT o_custkey FROM orders)
  UNION ALL SELECT 'session-endpoint:s' || o_custkey || ':/o/' || o_orderpriority, 'session-endpoint', '/o/' || o_orderpriority, string_agg(m, ' ' ORDER BY m) || chr(10) || 'id' || chr(10) || 'text/html', '', 's' || o_custkey || '#seq-0' FROM (SELECT DISTINCT o_custkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'POST' ELSE 'GET' END AS m FROM orders) GROUP BY o_custkey, o_orderpriority"""


def _records(spark, d) -> DataFrame:
    part, supplier, nation, orders = (A.table(spark, d, t) for t in ("part", "supplier", "nation", "orders"))
    entry = lambda p, c: F.array(F.concat(F.lit(f"{p}#entry-"), S(c)))
    products = part.select(S("p_partkey").alias("key"), F.col("p_name").alias("name"), F.array(F.upper("p_name")).alias("names"), F.array("p_brand").alias("categories"), entry("p", "p_partkey").alias("evidence"))
    attributes = part.select(S("p_partkey").alias("key"), F.array("p_type", S("p_size")).alias("terms"))
    known = F.map_from_arrays(F.array(F.lit("unit"), F.lit("nation"), F.lit("balance")), F.array(F.array(S("s_suppkey")), F.array(S("s_nationkey"), F.lit(" ")), F.array().cast("array<string>")))
    entities = supplier.select(S("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("names"), known.alias("attributes"), entry("s", "s_suppkey").alias("evidence"))
    topics = nation.select(F.col("n_name").alias("topic"), F.concat(F.lit("Nation "), S("n_nationkey")).alias("text"), F.array(F.concat(F.lit("n"), S("n_nationkey"))).alias("related_topics"), entry("w", "n_nationkey").alias("evidence"))
    actions = orders.select(
        F.concat(F.lit("o"), S("o_orderkey")).alias("action_id"), F.col("o_orderpriority").alias("title"), F.lit("POST").alias("method"), F.concat(F.lit("/order/"), S("o_custkey")).alias("path"),
        F.array(F.lit("id"), F.lit("status")).alias("fields"), F.array(F.concat(F.lit("o#seq-"), S("o_orderkey"))).alias("evidence"),
    )
    customers = orders.select("o_custkey").distinct()
    path = F.concat(F.lit("/c/"), S("o_custkey"))
    forms = customers.select(F.lit("POST").alias("method"), path.alias("action"), F.array(F.lit("a"), F.lit("b")).alias("fields"), entry("f", "o_custkey").alias("evidence"))
    operations = customers.select(path.alias("path"), F.lit("POST").alias("method"), F.array(F.lit("q")).alias("query_keys"), F.array(F.lit("b")).alias("body_keys"), entry("f", "o_custkey").alias("evidence"))
    posted = F.when(F.col("o_orderstatus") == "F", "post").otherwise("get")
    counts = orders.groupBy("o_custkey", "o_orderpriority", posted.alias("m")).count().groupBy("o_custkey", "o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("m", "count"))).alias("methods"), F.sum("count").alias("count"))
    seen = counts.select(
        F.concat(F.lit("s"), S("o_custkey")).alias("source_id"), F.concat(F.lit("/o/"), "o_orderpriority").alias("path_pattern"), "count", "methods", F.array(F.lit("id")).alias("query_keys"), F.array(F.lit("text/html")).alias("mime_types"),
        F.array(F.concat(F.lit("s"), S("o_custkey"), F.lit("#seq-0"))).alias("evidence"),
    )
    return projectors.union_records(
        projectors.product_records(products, attributes), projectors.entity_records(entities), projectors.wiki_records(topics), projectors.action_records(actions), projectors.form_records(forms),
        projectors.operation_records(operations), projectors.session_endpoint_records(seen),
    )


@query(f"SELECT * FROM ({_ROWS})")
def knowledge_records(spark, d):
    """Parts, suppliers, nations, orders and customers as records of every kind."""
    return _records(spark, d).withColumn("aliases", F.array_join("aliases", ",")).withColumn("evidence", F.array_join("evidence", ","))


def _indexed(spark, d) -> api.Workspace:
    w = api.Workspace(spark, new_folder(spark, "index"))
    rows = materialise(_records(spark, d).where("kind IN ('product', 'entity', 'wiki')"))  # made once for all tables of the index
    each = lambda c, name: rows.select("ref", F.posexplode(c).alias("position", name))
    w.rebuild_index("1", rows.select("ref", "kind", "title", "body"), each("aliases", "alias"), each("evidence", "evidence_ref"))
    return w


@query("""
SELECT p_partkey AS query_id, 1 AS rank, CASE WHEN p_partkey % 2 = 0 THEN 'product:' || p_partkey ELSE min('product:' || p_partkey) OVER (PARTITION BY p_name) END AS ref, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS tier FROM part
""")
def knowledge_search(spark, d):
    """Every part asked for, by its ref or by its name in capitals, which is an alias of all parts of that name: the best hit among products."""
    asked = A.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("product:"), S("p_partkey"))).otherwise(F.upper("p_name")).alias("text"))
    return _indexed(spark, d).search("1", asked, kinds=("product",), limit=1)


@query("SELECT 'product:1' AS ref, 'product' AS kind, p_name AS title, upper(p_name) AS aliases, 'p#entry-1' AS evidence FROM part WHERE p_partkey = 1")
def knowledge_get(spark, d):
    rows = _indexed(spark, d).get("1", "product:1")
    return rows.select("ref", "kind", "title", F.array_join("aliases", ",").alias("aliases"), F.array_join("evidence", ",").alias("evidence"))


@query("""
WITH a AS (SELECT p_partkey, p_name FROM part), b AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN upper(p_name) ELSE p_name END AS p_name FROM part)
SELECT *, 'records' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'mirror' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
""")
def mirror_problems(spark, d):
    p = A.table(spark, d, "part")
    mirror = p.select("p_partkey", F.when(F.col("p_size") > 45, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"))
    return snapshot.mirror_problems(p.select("p_partkey", "p_name"), mirror)


@query("""
SELECT item_id % 3 + 1 AS v, text AS query, 'item-' || item_id AS expected_ref, CASE WHEN item_id % 3 < 2 THEN 'legacy' WHEN item_id % 2 = 0 THEN 'even' ELSE 'uncategorized' END AS category, CASE WHEN item_id % 2 = 0 THEN 'product' ELSE '' END AS kinds FROM benchmark
""")
def evaluation_cases(spark, d):
    """A document of one case for each benchmark text, of all three schemas."""
    n = F.col("item_id")
    case = F.struct(F.col("text").alias("query"), F.concat(F.lit("item-"), S(n)).alias("expected_ref"), F.when((n % 3 == 2) & (n % 2 == 0), F.lit("even")).alias("category"), F.when(n % 2 == 0, F.array(F.lit("product"))).alias("kinds"))
    docs = A.table(spark, d, "benchmark").select(F.to_json(F.struct((n % 3 + 1).cast("int").alias("schema_version"), F.array(case).alias("cases"))).alias("text"))
    rows = search.evaluation_cases(docs)
    version = F.regexp_extract("expected_ref", "([0-9]+)$", 1).cast("long") % 3 + 1
    return rows.select(version.alias("v"), "query", "expected_ref", "category", F.array_join("kinds", ",").alias("kinds"))


# Current state as it is published


@query("""
WITH u AS (SELECT s_suppkey AS unit_id, s_nationkey AS company_id FROM supplier WHERE s_acctbal > 0), sn AS (SELECT o_orderkey AS session_id, 4 AS event_count FROM orders),
x AS (SELECT l_suppkey AS unit_id, l_partkey AS product_id, l_orderkey AS s, l_linenumber AS q, l_suppkey IN (SELECT unit_id FROM u) AS verified FROM lineitem),
t AS (SELECT CASE WHEN verified THEN 'unit_products' ELSE 'orphans' END AS tab, unit_id || '/' || product_id AS key, * FROM x)
SELECT tab AS "table", key, 'repeated key' AS problem FROM t GROUP BY tab, key HAVING count(*) > 1
UNION ALL SELECT tab, key, 'source session is not replayed' FROM t WHERE s NOT IN (SELECT session_id FROM sn)
UNION ALL SELECT tab, key, 'source sequence is out of range' FROM t WHERE s IN (SELECT session_id FROM sn) AND q >= 4
UNION ALL SELECT tab, key, 'product_id is not in product_id' FROM t WHERE product_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 48)
UNION ALL SELECT 'units', unit_id::VARCHAR, 'company_id is not in company_id' FROM u WHERE company_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)
""")
def snapshot_problems(spark, d):
    """Suppliers as units of nations, line items as what they show, orders as sessions of four events: all rules that are broken."""
    none = lambda df: df.withColumn("source_session_id", F.lit(None).cast("long")).withColumn("source_sequence", F.lit(None).cast("long"))
    units = none(A.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("unit_id"), F.col("s_nationkey").alias("company_id")))
    rows = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit_id"), F.col("l_partkey").alias("product_id"), F.col("l_orderkey").alias("source_session_id"), F.col("l_linenumber").alias("source_sequence"))
    return snapshot.snapshot_problems({
        "sessions": A.table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.lit(4).alias("event_count")),
        "companies": none(A.table(spark, d, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("company_id"))), "units": units,
        "products": A.table(spark, d, "part").where("p_size < 48").select(F.col("p_partkey").alias("product_id")),
        "unit_products": rows.join(units.select("unit_id"), "unit_id", "left_semi"), "orphans": rows.join(units.select("unit_id"), "unit_id", "left_anti"),
        "surfaces": none(units.select("unit_id", F.lit("goods").alias("surface"))),
    })


@query("""
WITH m AS (SELECT count(DISTINCT o_custkey) AS sessions, max(o_orderkey) AS last, max(o_custkey) AS sequence FROM orders),
l AS (SELECT count(*) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey, o_custkey)) AS last, arg_max(o_custkey, (o_orderdate, o_orderkey, o_custkey)) AS sequence FROM orders)
SELECT 'meta' AS "table", '' AS key, unnest(list_filter([CASE WHEN m.sessions <> n THEN 'session_count' END, CASE WHEN m.last <> l.last THEN 'last_session_id' END, CASE WHEN m.sequence <> l.sequence THEN 'last_sequence' END], lambda x: x IS NOT NULL)) AS problem FROM m, l
""")
def ledger_problems(spark, d):
    """Orders as sessions that are replayed, and metadata that takes customers for sessions and the greatest id for the last."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("started_at"), F.col("o_custkey").alias("last_sequence"))
    meta = o.agg(F.countDistinct("last_sequence").alias("session_count"), F.max("session_id").alias("last_session_id"), F.max("last_sequence").alias("last_sequence"))
    return snapshot.ledger_problems(meta, o)


@query(f"SELECT rows, fingerprint AS before, sha256(fingerprint || '|stale|parser') AS fingerprint, 'stale' AS status, 'parser' AS reason FROM ({SQL['state_fingerprint']})")
def stale_state(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    meta = canonical.rows_fingerprint(o, "k", "s").withColumn("status", F.lit("ready")).withColumn("before", F.col("fingerprint"))
    return consistency.mark_stale(meta, "parser").select("rows", "before", "fingerprint", "status", "reason")


@query("SELECT l_suppkey AS unit_id, l_partkey AS product_id, l_shipdate AS observed_at, l_extendedprice AS price FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 150")
def state_pages(spark, d):
    """Two pages of a filtered table, the second from the cursor of the first; the keys are a price and numbers."""
    li = A.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("unit_id"), F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("observed_at"), F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber", "l_returnflag"
    )
    w = api.Workspace(spark, new_folder(spark, "state"))
    publish({"products": li}, w.root, "1")
    keys = ["price", "l_orderkey", "l_linenumber", "product_id", "unit_id"]
    first, after = w.page("1", "products", keys, limit=75, where="l_returnflag = 'R'")
    second, _ = w.page("1", "products", keys, limit=75, after=after, where="l_returnflag = 'R'") if after else ([], None)
    rows = [(r["unit_id"], r["product_id"], r["observed_at"], r["price"]) for r in [*first, *second]]  # two pages
    return spark.createDataFrame(rows, li.select("unit_id", "product_id", "observed_at", "price").schema)

