"""Evidence references to their sources, and merges of records from two origins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """(ref, source_id, ordinal, status) for each ref "<source>#<kind>-<ordinal>".

    ``sources``: source_id, size. status: resolved, out_of_range, unknown_source, or malformed.
    """
    pattern = r"^(.+)#(entry|seq)-([0-9]+)$"
    source = F.regexp_extract("ref", pattern, 1)
    parsed = refs.select("ref", F.when(source != "", source).alias("source_id"), F.regexp_extract("ref", pattern, 3).try_cast("long").alias("ordinal"))
    joined = parsed.join(sources.select("source_id", "size"), "source_id", "left")
    status = (
        F.when(F.col("source_id").isNull(), F.lit("malformed"))
        .when(F.col("size").isNull(), F.lit("unknown_source"))
        .when(F.col("ordinal") >= F.col("size"), F.lit("out_of_range"))
        .otherwise(F.lit("resolved"))
    )
    return joined.select("ref", "source_id", "ordinal", status.alias("status"))


def merge_records(left: DataFrame, right: DataFrame, key: str, array: str) -> DataFrame:
    """Full outer merge on ``key``: the arrays of both sides joined, each element once, the left's first."""
    r = right.select(F.col(key).alias("_key"), F.col(array).alias("_array"))
    both = left.join(r, F.col(key) == F.col("_key"), "full_outer")
    empty = F.array().cast(dict(left.dtypes)[array])
    merged = F.array_distinct(F.concat(F.coalesce(F.col(array), empty), F.coalesce(F.col("_array"), empty)))
    origin = F.when(F.col(key).isNull(), F.lit("right")).when(F.col("_key").isNull(), F.lit("left")).otherwise(F.lit("both"))
    return both.select(F.coalesce(key, "_key").alias(key), merged.alias(array), origin.alias("origin"))
