"""The datasets that are built from captured entries, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import normalise as N
from tessera.functions import pages, recognise, wiki
from tessera.functions.text import is_json
from tessera.operators import census

#: Quoted routes in page and script text, with or without the site's origin. ``%s`` is the site. A fixed value:
#: which tokens count decides the census.
ROUTE_TOKEN = r"""["']((?:(?:https?:)?//%s)?/[^"'\s<>()\\]*)["']"""
SCANNED = ("application/javascript", "text/html", "text/javascript")


def in_capture_order(first: tuple[str, ...] = ()) -> list[Column]:
    """Captures named in ``first`` before the others, then by name; entries as they stand."""
    place = F.array_position(F.array(*map(F.lit, first)), F.col("capture")) if first else F.lit(0)
    return [F.when(place > 0, place).otherwise(len(first) + 1), F.col("capture"), F.col("entry")]


def route_tokens(entries: DataFrame, site: str) -> DataFrame:
    """(capture, entry, token, pattern) of each entry's own route and of the routes quoted in its text."""
    own = F.concat("path", F.when(F.col("raw_query") != "", F.concat(F.lit("?"), "raw_query")).otherwise(F.lit("")))
    text = F.when(F.col("mime_type").isin(*SCANNED), F.col("body").cast("string"))
    quoted = F.regexp_extract_all(text, F.lit(ROUTE_TOKEN % site.replace(".", r"\.")), F.lit(1))
    bare = F.transform(quoted, lambda t: F.rtrim(F.regexp_replace(t, rf"^(?:https?:)?//{site}", ""), F.lit(".,;:!")))
    fits = F.filter(bare, lambda t: (F.length(t) >= 2) & t.startswith("/") & ~t.startswith("//") & (F.instr(t, "{") == 0))
    each = entries.select("capture", "entry", F.explode(F.array_distinct(F.concat(F.array(own), F.coalesce(fits, F.array().cast("array<string>"))))).alias("token"))
    return each.withColumn("pattern", N.route(F.col("token")))


def application_events(entries: DataFrame, site: str) -> DataFrame:
    return census.application_events(entries).drop("body")


def endpoints(entries: DataFrame, site: str) -> DataFrame:
    """(path_pattern, count, query_keys) of the endpoints; their value counts are ``census.value_counts``."""
    return census.endpoint_census(census.application_events(entries), N.endpoint_pattern(F.col("path")), F.map_keys("query"))


def assets(entries: DataFrame, site: str) -> DataFrame:
    static = entries.where(F.col("first_party") & N.is_static(F.col("path"), F.col("resource_type")))
    return static.groupBy("path").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("capture")).alias("captures"), F.array_sort(F.collect_set("mime_type")).alias("mime_types"))


def routes(entries: DataFrame, site: str) -> DataFrame:
    return census.route_census(route_tokens(entries.where("first_party"), site))


def forms(entries: DataFrame, site: str) -> DataFrame:
    found = entries.where(recognise.page_candidate()).select(F.concat("capture", F.lit("#entry-"), F.col("entry").cast("string")).alias("page"), F.explode(pages.page_forms(F.col("body").cast("string"))).alias("f"))
    return census.form_dedup(found.select("page", "f.form_id", "f.method", "f.action", "f.fields"))


def page_texts(entries: DataFrame, site: str) -> DataFrame:
    own = entries.where(recognise.page_candidate()).withColumn("p", pages.page_text(F.col("body").cast("string")))
    return own.select("capture", "entry", "started_at", "method", "path", "query", "status", "p.title", "p.text", F.col("response_text_sha256").alias("html_sha256"))


def json_responses(entries: DataFrame, site: str) -> DataFrame:
    """Bodies of JSON responses; a body that is no JSON stays as text, and ``is_json`` says which it is."""
    body = F.col("body").cast("string")
    own = entries.where(recognise.json_candidate())
    return own.select("capture", "entry", "path", "query", F.col("response_text_sha256").alias("sha256"), body.alias("data"), is_json(body).alias("is_json"))


def wiki_topics(entries: DataFrame, site: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The first help page of each topic in capture order, with its article and related topics."""
    own = entries.where(recognise.wiki_candidate()).withColumn("topic", wiki.topic(F.col("url"))).where("topic IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("topic").orderBy(*in_capture_order(order)))
    html = F.col("body").cast("string")
    return own.withColumn("_k", first).where("_k = 1").select("topic", "capture", "entry", "path", wiki.article_text(html).alias("text"), wiki.related_topics(html).alias("related_topics"))


BUILDERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "application-events": application_events, "endpoints": endpoints, "routes": routes, "forms": forms, "json-responses": json_responses, "pages": page_texts, "assets": assets, "wiki-topics": wiki_topics,
}


def build(name: str, entries: DataFrame, site: str) -> DataFrame:
    """The dataset ``name`` of ``entries`` (as ``sources.har.read_har`` gives them) of a site."""
    if name not in BUILDERS:
        raise ValueError(f"no dataset {name}; there are {', '.join(BUILDERS)}")
    return BUILDERS[name](entries, site)
