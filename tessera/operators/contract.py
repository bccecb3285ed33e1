"""Compile a contract from curated rows: signatures on resolved paths, and the identity of what was compiled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.canonical import rows_fingerprint
from tessera.functions.normalise import key_set, method
from tessera.operators import paths


def resolve(rows: DataFrame, templates: DataFrame, *, required: bool = False) -> DataFrame:
    """``rows`` (path, ..) with path replaced by its pattern; an unknown path stays, or fails the job if ``required``."""
    found = paths.match(rows.select("path"), templates).where("status <> 'ambiguous'").select("path", F.col("pattern").alias("_pattern"))
    joined = rows.join(found, "path", "left")
    path = F.coalesce("_pattern", F.raise_error(F.lit("path of no endpoint")).cast("string")) if required else F.coalesce("_pattern", "path")
    return joined.withColumn("path", path).drop("_pattern")


def operation_signatures(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Distinct (path, method, query_keys, body_keys) of operations, with normalised names, and posts, their number."""
    named = resolve(rows, templates).select("path", method(F.col("method")).alias("method"), key_set(F.col("query_keys")).alias("query_keys"), key_set(F.col("body_keys")).alias("body_keys"))
    return named.groupBy("path", "method", "query_keys", "body_keys").agg(F.count("*").alias("posts"))


def posts_disagree(signatures: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, method, posts, declared_posts) of operations whose number of posts is not the declared one (path, method, posts)."""
    found = signatures.groupBy("path", "method").agg(F.sum("posts").alias("posts"))
    told = declared.groupBy("path", "method").agg(F.sum("posts").alias("declared_posts"))
    return found.join(told, ["path", "method"], "full_outer").where(~F.col("posts").eqNullSafe(F.col("declared_posts")))


def form_signatures(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Distinct (path, method, fields) of forms with normalised names."""
    return resolve(rows, templates).select("path", method(F.col("method")).alias("method"), key_set(F.col("fields")).alias("fields")).distinct()


def merge_endpoints(variants: DataFrame, operations: DataFrame) -> DataFrame:
    """Endpoint variants (path, method, query_keys, status) with those that only operations show, status unknown."""
    more = operations.select("path", "method", "query_keys", F.lit(None).cast("int").alias("status")).distinct()
    known = variants.select("path", "method", "query_keys").distinct()
    return variants.select("path", "method", "query_keys", "status").distinct().unionByName(more.join(known, ["path", "method", "query_keys"], "left_anti"))


def profile(tables: dict[str, DataFrame], versions: dict[str, int]) -> str:
    """Digest of a contract's tables and of the versions it is read with; the order of rows doesn't matter."""
    import hashlib
    import json

    parts = {}
    for name, df in sorted(tables.items()):
        flat = df.select(*[F.col(c).cast("string").alias(c) for c in sorted(df.columns)])
        parts[name] = rows_fingerprint(flat, *flat.columns).first()["fingerprint"]  # one row
    return hashlib.sha256(json.dumps([parts, versions], sort_keys=True).encode()).hexdigest()
