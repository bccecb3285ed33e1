"""Registries of evidence sources and the redaction policy."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "source_id string, size bigint, sha256 string, captured_at string"


def source_catalog(**registries: DataFrame) -> DataFrame:
    """(source_id, size, kind) of all registries (source_id, size); an id that stands in more than one row fails the job."""
    parts = [df.select("source_id", "size", F.lit(kind).alias("kind")) for kind, df in registries.items()]
    every = reduce(DataFrame.unionByName, parts)
    once = every.groupBy("source_id").agg(F.min("size").alias("size"), F.min("kind").alias("kind"), F.count("*").alias("n"))
    return once.where(F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("source id is not unique")).cast("boolean"))).drop("n")


def read_registry(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(_ROW).option("mode", "FAILFAST").json(list(paths))


def translate_refs(rows: DataFrame, captures: DataFrame) -> DataFrame:
    """``rows`` (capture, entry, session_id, sequence) with ref, "<source>#entry-N" or "<session>#seq-N".

    ``captures``: (capture, source_id). A capture that it lacks fails the job.
    """
    joined = rows.join(captures.select("capture", "source_id"), "capture", "left")
    of_capture = F.when(F.col("source_id").isNull(), F.raise_error(F.lit("unknown capture"))).otherwise(F.concat("source_id", F.lit("#entry-"), F.col("entry").cast("string")))
    of_session = F.concat("session_id", F.lit("#seq-"), F.col("sequence").cast("string"))
    return joined.withColumn("ref", F.when(F.col("capture").isNotNull(), of_capture).otherwise(of_session)).drop("source_id")


def load_policy(path: str) -> dict[str, tuple[str, ...]]:
    """Header names and field patterns of a policy file; they go into plans as literals."""
    with open(path, encoding="utf-8") as f:
        policy = json.load(f)
    return {"headers": tuple(h.lower() for h in policy["headers"]["drop"]), "fields": tuple(p.replace("(?i)", "") for p in policy["fields"]["drop_patterns"])}
