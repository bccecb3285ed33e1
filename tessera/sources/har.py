"""HAR captures as rows of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import normalise as N

_SCHEMA = """log struct<entries: array<struct<startedDateTime: string, _resourceType: string,
  request: struct<method: string, url: string>,
  response: struct<status: int, content: struct<mimeType: string, size: bigint, encoding: string, text: string>>>>>"""


def started_at(value):
    """UTC instant with milliseconds, cut and not rounded; kept as it is if it is in that form already."""
    canonical = value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$")
    zoned = F.when(value.rlike(r"(Z|[+-]\d\d:?\d\d)$"), value).otherwise(F.concat(value, F.lit("Z")))
    instant = F.to_utc_timestamp(F.try_to_timestamp(zoned), F.current_timezone())
    millis = F.timestamp_millis(F.floor(F.unix_micros(instant) / 1000))
    return F.when(canonical, value).otherwise(F.concat(F.date_format(F.from_utc_timestamp(millis, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))


def read_har(spark: SparkSession, *paths: str, hosts: tuple[str, ...] = ()) -> DataFrame:
    """(capture, entry, started_at, method, url, path, query, raw_query, status, mime_type, resource_type, response_size,
    response_text_sha256, body, first_party) of all entries of the captures, in the order of each file.

    The digest is over the text as it stands in the capture, encoded or not; the size falls back to the
    text's bytes, then to 0. The first value of a repeated query key counts.
    """
    log = spark.read.schema(_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(list(paths))
    rows = log.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("capture"), F.posexplode("log.entries").alias("entry", "e"))
    url, content = F.col("e.request.url"), F.col("e.response.content")
    pairs = N.first_values(N.query_pairs(N.url_query(url)))
    text = content["text"]
    body = F.when(content["encoding"] == "base64", F.unbase64(text)).otherwise(text.cast("binary"))
    return rows.select(
        "capture", "entry", started_at(F.col("e.startedDateTime")).alias("started_at"), F.upper("e.request.method").alias("method"), url.alias("url"), N.url_path(url).alias("path"),
        F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["key"], p["value"]))).alias("query"), N.url_query(url).alias("raw_query"),
        F.col("e.response.status").alias("status"),
        N.content_type(content["mimeType"]).alias("mime_type"), F.coalesce("e._resourceType", F.lit("")).alias("resource_type"),
        F.coalesce(content["size"], F.octet_length(text).cast("long"), F.lit(0)).alias("response_size"), F.sha2(text, 256).alias("response_text_sha256"),
        body.alias("body"), N.first_party(N.url_host(url), *hosts).alias("first_party"),
    )
