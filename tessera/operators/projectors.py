"""Knowledge records out of datasets: one row (ref, kind, title, body) and its aliases and evidence per thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.canonical import versioned_ref
from tessera.operators.integrity import require

_SHAPE = ["ref", "kind", "title", "body", "aliases", "evidence"]


def _record(rows: DataFrame, ref: Column, kind: str, title: Column, body: list[Column], aliases: Column | None = None, evidence: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    lines = F.array_join(F.filter(F.array(*body), lambda x: x.isNotNull() & (x != "")), "\n")
    return rows.select(
        ref.alias("ref"), F.lit(kind).alias("kind"), title.alias("title"), lines.alias("body"),
        (none if aliases is None else F.coalesce(aliases, none)).alias("aliases"), (none if evidence is None else F.array_distinct(F.coalesce(evidence, none))).alias("evidence"),
    )


def endpoint_records(rows: DataFrame) -> DataFrame:
    """Of endpoints (path_pattern, methods, query_keys, evidence)."""
    keys = F.concat(F.lit("query: "), F.array_join("query_keys", " "))
    return _record(rows, F.concat(F.lit("endpoint:"), "path_pattern"), "endpoint", F.col("path_pattern"), [F.array_join("methods", " "), F.when(F.size("query_keys") > 0, keys)], None, F.col("evidence"))


def operation_records(rows: DataFrame) -> DataFrame:
    """Of operations (path, method, query_keys, body_keys, evidence); the ref is a digest of what they are."""
    identity = F.concat_ws("|", "method", "path", F.array_join("query_keys", ","), F.array_join("body_keys", ","))
    return _record(rows, versioned_ref("operation", identity), "operation", F.concat_ws(" ", "method", "path"), [F.array_join("query_keys", " "), F.array_join("body_keys", " ")], None, F.col("evidence"))


def form_records(rows: DataFrame) -> DataFrame:
    """Of forms (method, action, fields, evidence)."""
    identity = F.concat_ws("|", "method", "action", F.array_join("fields", ","))
    return _record(rows, versioned_ref("form", identity), "form", F.concat_ws(" ", "method", "action"), [F.array_join("fields", " ")], None, F.col("evidence"))


def wiki_records(rows: DataFrame) -> DataFrame:
    """Of help topics (topic, text, related_topics, evidence)."""
    return _record(rows, F.concat(F.lit("wiki:"), "topic"), "wiki", F.col("topic"), [F.col("text")], F.col("related_topics"), F.col("evidence"))


def product_records(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Of products (key, name, names, categories, evidence) with the terms of their attributes (key, terms).

    A product has at most one row of attributes; a second one fails the job.
    """
    one = attributes.groupBy("key").agg(F.first("terms").alias("terms"), F.count("*").alias("n"))
    checked = one.where(F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("attributes are not unique")).cast("boolean"))).drop("n")
    rows = products.join(checked.hint("merge"), "key", "left")  # as many as products: nothing to send to every task
    return _record(rows, F.concat(F.lit("product:"), "key"), "product", F.col("name"), [F.array_join("categories", " "), F.array_join("terms", " ")], F.col("names"), F.col("evidence"))


#: Fields of a product's attributes whose texts are terms, in their order. Fixed values.
_ATTRIBUTES = ("weight_text", "volume_text", "storage", "retail_group", "enterprise", "department")
_MATERIAL = ("slug", "name", "quantity_text", "quality_share")
_ITEM = (
    ", ".join(f"{c} string" for c in ("product_id", "confidence", *_ATTRIBUTES))
    + ", evidence array<string>, awards array<struct<label: string, value: string>>, recipe struct<output_name: string, energy_text: string, materials: array<struct<"
    + ", ".join(f"{c}: string" for c in _MATERIAL)
    + ">>>"
)


def attribute_documents(items: DataFrame) -> DataFrame:
    """(key, terms, evidence) of documents (text): the texts of a product's attributes, awards and recipe, each once, in the order of the document.

    An item that is no JSON object, isn't documented, has no product_id or no evidence, or holds an empty text or an award
    without label or value fails the job, as does a product that stands twice.
    """
    d = F.from_json("text", _ITEM, {"mode": "FAILFAST"})
    rows = items.select(F.explode(F.array(d)).alias("d"))  # conditions are not pushed below a generator, so each text is parsed once
    awards = F.flatten(F.transform("d.awards", lambda a: F.array(F.coalesce(a["label"], F.lit("")), F.coalesce(a["value"], F.lit("")))))
    materials = F.flatten(F.transform("d.recipe.materials", lambda m: F.array(*[m[c] for c in _MATERIAL])))
    none = F.array().cast("array<string>")
    parts = [F.array(*[F.col(f"d.{c}") for c in _ATTRIBUTES]), F.coalesce(awards, none), F.array(F.col("d.recipe.output_name"), F.col("d.recipe.energy_text")), F.coalesce(materials, none)]
    read = rows.select(F.col("d.product_id").alias("key"), F.col("d.confidence").alias("confidence"), F.array_compact(F.concat(*parts)).alias("terms"), F.array_distinct("d.evidence").alias("evidence"))
    sound = require(read, "key <> '' AND confidence = 'documented' AND size(evidence) > 0 AND NOT exists(terms, t -> trim(t) = '')", "attributes are not sound")
    one = sound.groupBy("key").agg(F.first("terms").alias("terms"), F.first("evidence").alias("evidence"), F.count("*").alias("n"))
    return require(one, "n = 1", "attributes are not unique").select("key", F.array_distinct("terms").alias("terms"), "evidence")


def action_records(rows: DataFrame) -> DataFrame:
    """Of actions (action_id, title, method, path, fields, evidence)."""
    return _record(rows, F.concat(F.lit("action:"), "action_id"), "action", F.col("title"), [F.concat_ws(" ", "method", "path"), F.array_join("fields", " ")], F.array("action_id"), F.col("evidence"))


def entity_records(rows: DataFrame) -> DataFrame:
    """Of entities (entity_id, name, names, attributes as a map of lists, evidence)."""
    return _record(rows, F.concat(F.lit("entity:"), "entity_id"), "entity", F.col("name"), [F.array_join(attribute_terms(F.col("attributes")), " ")], F.col("names"), F.col("evidence"))


def attribute_terms(attributes: Column) -> Column:
    """Distinct words of a map of lists: each name, in order, and its values; nulls and blanks are left out."""
    pairs = F.array_sort(F.map_entries(attributes), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    every = F.flatten(F.transform(pairs, lambda p: F.concat(F.array(p["key"]), F.coalesce(p["value"], F.array().cast("array<string>")))))
    return F.array_distinct(F.filter(F.transform(every, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")))


def session_endpoint_records(rows: DataFrame) -> DataFrame:
    """Of endpoints seen in a session (source_id, path_pattern, count, methods as a map of counts, query_keys, mime_types, evidence).

    The counts of the methods have to add up to count, and a path stands once a source; else the job fails.
    """
    total = F.aggregate(F.map_values("methods"), F.lit(0).cast("long"), lambda s, n: s + n)
    n = F.count("*").over(Window.partitionBy("source_id", "path_pattern"))
    fine = (total == F.col("count")) & (F.col("count") > 0) & (F.col("_n") == 1)
    checked = rows.withColumn("_n", n).where(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("session endpoint is not sound")).cast("boolean"))).drop("_n")
    methods = F.array_join(F.array_sort(F.transform(F.map_keys("methods"), lambda m: F.upper(m))), " ")
    return _record(
        checked, F.concat(F.lit("session-endpoint:"), "source_id", F.lit(":"), "path_pattern"), "session-endpoint", F.col("path_pattern"),
        [methods, F.array_join(F.array_sort("query_keys"), " "), F.array_join(F.array_sort("mime_types"), " ")], None, F.col("evidence"),
    )


def union_records(*parts: DataFrame) -> DataFrame:
    """All records; a ref that two of them have fails the job."""
    every = parts[0].select(*_SHAPE)
    for p in parts[1:]:
        every = every.unionByName(p.select(*_SHAPE))
    n = every.groupBy("ref").agg(F.count("*").alias("n"))
    joined = every.join(n.hint("merge"), "ref")  # a row a record: nothing to send to every task
    return joined.where(F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("ref is not unique")).cast("boolean"))).drop("n")
