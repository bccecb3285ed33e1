"""Views that show the given tables as sessions, requests, observations and market rows.

Every view exists twice: as a DataFrame and, for the checks against SQL, as a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Observations before this time make up the contract, those after it are compared with it.
CUT = "2024-01-04"
#: The correlation window in seconds; users of the given events act hours apart.
WINDOW = 43200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    action, post = kind.isin("click", "signup"), kind.isin("signup", "purchase")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("n"), seq.alias("sequence"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), "ts", kind.alias("raw_type"), k.alias("k"), "value",
        F.when(action, "dom.action").otherwise("cdp.network").alias("source"),
        F.when(action, "dom.action").when(kind == "error", "http.failed").otherwise("http.request").alias("event_type"),
        F.col("user_id").cast("string").alias("target"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("frame"), F.concat(F.lit("/k/"), (k % 10).cast("string")).alias("path"),
        F.when(post, "POST").otherwise("GET").alias("method"), F.when(kind == "signup", "submit").otherwise("click").alias("kind"),
        (F.col("event_id") % 2 == 0).alias("trusted"), (F.col("event_id") % 3 == 0).alias("gesture"),
    )


EVENTS = """ev AS (
  SELECT user_id::VARCHAR AS session_id, event_id::VARCHAR AS event_id, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence,
    epoch_us(ts) / 1e6 AS time, ts, event_type AS raw_type, json_extract_string(props, '$.k')::INTEGER AS k, value,
    CASE WHEN event_type IN ('click', 'signup') THEN 'dom.action' ELSE 'cdp.network' END AS source,
    CASE WHEN event_type IN ('click', 'signup') THEN 'dom.action' WHEN event_type = 'error' THEN 'http.failed' ELSE 'http.request' END AS event_type,
    user_id::VARCHAR AS target, 'f' || (json_extract_string(props, '$.k')::INTEGER % 3) AS frame, '/k/' || (json_extract_string(props, '$.k')::INTEGER % 10) AS path,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method, CASE WHEN event_type = 'signup' THEN 'submit' ELSE 'click' END AS kind,
    event_id % 2 = 0 AS trusted, event_id % 3 = 0 AS gesture
  FROM events
)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    """http observations: path, method, status, query and body keys, form fields of every event."""
    e = events(spark, d)
    k = F.col("k")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    body = F.when(F.col("n") % 2 == 0, F.array(text("b", k % 5), F.lit("c"))).otherwise(F.array(text("b", k % 5)))
    return e.select(
        "session_id", "event_id", "n", "ts", "sequence", F.concat(F.lit("/"), "raw_type", F.lit("/"), (k / 10).cast("int").cast("string")).alias("path"), "method",
        (k % 3 + 200).alias("status"), F.array_distinct(F.array(F.lit("a"), text("k", k % 10))).alias("query_keys"),
        F.when(F.col("n") % 7 != 0, body).alias("body_keys"), F.array_distinct(F.array(F.lit("name"), text("f", k % 4), text("g", F.col("n") % 3))).alias("fields"),
        (F.col("ts") < F.lit(CUT).cast("timestamp_ntz")).alias("known"),
    )


OBSERVATIONS = (
    EVENTS
    + f""", ob AS (
  SELECT session_id, event_id, n, ts, sequence, '/' || raw_type || '/' || (k // 10) AS path, method, k % 3 + 200 AS status,
    ['a', 'k' || (k % 10)] AS query_keys,
    CASE WHEN n % 7 <> 0 THEN CASE WHEN n % 2 = 0 THEN ['b' || (k % 5), 'c'] ELSE ['b' || (k % 5)] END END AS body_keys,
    ['name', 'f' || (k % 4), 'g' || (n % 3)] AS fields, ts < TIMESTAMP '{CUT}' AS known
  FROM ev
)"""
)


def correlation_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d)
    return e.where("source = 'dom.action'"), e.where("event_type = 'http.request'")


def correlation_sql(steps: tuple[float, float, float]) -> str:
    near, close, late = steps
    return (
        EVENTS
        + f""", met AS (
  SELECT a.session_id, a.event_id AS action_event_id, r.event_id AS network_event_id, a.sequence AS a_seq, r.sequence AS r_seq, a.path AS action_path, r.path, r.method,
    abs(r.time - a.time) AS d, a.path = r.path AS p, upper(a.method) = upper(r.method) AS m, r.gesture AS g,
    (((((CASE WHEN a.frame <> '' AND a.frame = r.frame THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN abs(r.time - a.time) <= {near} THEN 0.30::DOUBLE WHEN abs(r.time - a.time) <= {close} THEN 0.22::DOUBLE WHEN abs(r.time - a.time) <= {late} THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END)
      + CASE WHEN a.path = r.path THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN upper(a.method) = upper(r.method) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)
      + CASE WHEN r.gesture THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN a.trusted THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)
      + CASE WHEN a.kind = 'submit' AND a.path = r.path AND upper(a.method) = upper(r.method) THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS total
  FROM ev a JOIN ev r ON a.session_id = r.session_id AND a.target = r.target AND (a.frame IS NULL OR r.frame IS NULL OR a.frame = r.frame)
    AND abs(r.time - a.time) <= {WINDOW} AND NOT (least(a.time, r.time) < greatest(a.time, r.time) - {WINDOW})
  WHERE a.source = 'dom.action' AND r.event_type = 'http.request'
), scored AS (
  SELECT *, least(total, 1.0::DOUBLE) AS raw,
    CASE WHEN (p OR g) AND least(total, 1.0::DOUBLE) >= 0.80 THEN 'strong' WHEN (p OR g) AND least(total, 1.0::DOUBLE) >= 0.60 THEN 'probable'
      WHEN least(total, 1.0::DOUBLE) >= 0.40 THEN 'temporal-only' END AS status
  FROM met
), link AS (
  SELECT * FROM scored WHERE status IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_id, network_event_id ORDER BY a_seq >= r_seq,
    CASE WHEN a_seq < r_seq THEN -raw ELSE 0 END, CASE WHEN a_seq < r_seq THEN d ELSE 0 END, CASE WHEN a_seq >= r_seq THEN a_seq ELSE 0 END, action_event_id DESC) = 1
)"""
    )


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Captured requests from the pages: the host is the capture, the page its entry."""
    from tessera.functions import normalise as N

    p = table(spark, d, "pages")
    return p.select(
        N.url_host(F.col("url")).alias("capture"), F.col("page_id").alias("entry"), N.url_path(F.col("url")).alias("path"), N.url_query(F.col("url")).alias("query"),
        F.lit("GET").alias("method"), (F.lit(200) + F.col("page_id") % 2).alias("status"), F.lit("text/html").alias("mime_type"), F.lit("document").alias("resource_type"), "html",
        N.first_party(N.url_host(F.col("url")), "example.com", "example.org").alias("first_party"),
    )


#: Path rewrites for the pages, in place of the census's own.
PAGE_RULES = ((r"^/[a-z]{2}/[0-9]+(\.html)?/?$", "/{lang}/{id}"),)

ENTRIES = r"""en AS (
  SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS capture, page_id AS entry,
    CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path,
    regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, 200 + page_id % 2 AS status, html,
    regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '(^|\.)example\.(com|org)$') AS first_party
  FROM pages
), app AS (
  SELECT *, CASE WHEN regexp_matches(path, '^/[a-z]{2}/[0-9]+(\.html)?/?$') THEN '/{lang}/{id}' ELSE path END AS path_pattern FROM en
  WHERE first_party AND NOT regexp_matches(path, '(?i)^/(css|img|js)/|/[^/]+\.(css|eot|gif|html?|ico|jpe?g|js|map|mp3|mp4|png|svg|ttf|txt|webp|woff2?|xml)(/|$)')
)"""


def unit_products(spark: SparkSession, d: str) -> DataFrame:
    """Observations of products in units: a line item is what supplier (unit) and part (product) showed at its ship date."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("unit_id"), F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("observed_at"), F.col("l_orderkey").alias("o1"), F.col("l_linenumber").alias("o2"),
        F.col("l_quantity").cast("long").alias("sales_volume"), (F.col("l_orderkey") % 20).alias("stock_qty"), F.col("l_linenumber").cast("long").alias("supply_qty"),
        F.col("l_extendedprice").alias("our_price"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("city_price"), (F.col("l_discount") * 10).alias("city_quality"),
        (F.col("l_tax") * 10).alias("stock_quality"), (F.col("l_extendedprice") * F.col("l_discount")).alias("profit"), (F.col("l_extendedprice") * 0.5).alias("supply_cost"),
    )


UNIT_PRODUCTS = """up AS (
  SELECT l_suppkey AS unit_id, l_partkey AS product_id, l_shipdate AS observed_at, l_orderkey AS o1, l_linenumber AS o2, l_quantity::BIGINT AS sales_volume, l_orderkey % 20 AS stock_qty,
    l_linenumber::BIGINT AS supply_qty, l_extendedprice AS our_price, l_extendedprice * (1 + l_tax) AS city_price, l_discount * 10 AS city_quality,
    l_tax * 10 AS stock_quality, l_extendedprice * l_discount AS profit, l_extendedprice * 0.5::DOUBLE AS supply_cost
  FROM lineitem
), latest AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY unit_id, product_id ORDER BY observed_at DESC, o1 DESC, o2 DESC) = 1)"""

STATE_KEYS, STATE_ORDER = ["unit_id", "product_id"], ["observed_at", "o1", "o2"]
