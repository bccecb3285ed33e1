"""Agreement between tables that were made apart, state metadata, and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.census import number_rows


def census_conservation(census: DataFrame, counts: DataFrame, group: str) -> DataFrame:
    """Groups whose value counts (group, facet, value, n) do not add up to their count in ``census``, per facet."""
    sums = counts.groupBy(group, "facet").agg(F.sum("n").alias("total"))
    return census.select(group, "count").join(sums, group).where("total <> count")


def both_ways(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, only_in) of key values that one side only has, from either side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("only_in", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("only_in", F.lit("right")))


def actions_without_operation(actions: DataFrame, operations: DataFrame) -> DataFrame:
    """Actions (action_id, path, method, fields) whose fields no operation (path, method, keys) of their request holds."""
    ops = operations.groupBy("path", "method").agg(F.collect_set("keys").alias("all"))
    joined = actions.join(ops, ["path", "method"], "left")
    held = F.exists("all", lambda keys: F.size(F.array_except("fields", keys)) == 0)
    return joined.where(~F.coalesce(held, F.lit(False))).select("action_id", "path", "method")


def action_problems(actions: DataFrame, operations: DataFrame) -> DataFrame:
    """(action_id, problem) of actions that the operations of their request don't bear out; none for a sound contract.

    ``actions``: action_id, path, method, fields, query_sets (array of key sets), statuses, observed_count, status_counts
    (one number a status). ``operations``: path, method, query_keys, body_keys, statuses. An action needs an operation of its path and
    method; each of its query sets is one of theirs, its fields and its statuses are among all of theirs, and its status
    counts add up to what was observed.
    """
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    ops = operations.groupBy("path", "method").agg(
        F.collect_set(F.array_sort(F.array_distinct("query_keys"))).alias("_queries"), all_of(F.col("body_keys")).alias("_fields"), all_of(F.col("statuses")).alias("_statuses"), F.lit(True).alias("_known")
    )  # as large as a contract's operations of one path
    rows = actions.join(ops, ["path", "method"], "left")
    shapes = F.transform("query_sets", lambda q: F.array_sort(F.array_distinct(q)))
    known = F.coalesce("_known", F.lit(False))
    tests = [
        (~known, "no operation"), (known & (F.size(F.array_except(shapes, F.col("_queries"))) > 0), "query shape of no operation"), (known & (F.size(F.array_except("fields", "_fields")) > 0), "field of no operation"),
        (known & (F.size(F.array_except("statuses", "_statuses")) > 0), "status of no operation"), (F.aggregate("status_counts", F.lit(0).cast("long"), lambda x, y: x + y) != F.col("observed_count"), "counts do not add up"),
    ]
    told = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(text)) for when, text in tests]))
    return rows.select("action_id", F.explode(told).alias("problem"))


def nearest_rank(rows: DataFrame, group: list[str], value: str, percentiles: dict[str, float]) -> DataFrame:
    """Upper nearest-rank percentiles of each group: the value at rank ceil((n - 1) * p) + 1, never interpolated.

    Rows are sorted and numbered by ranges, so that a large group is no task of its own; a group's ranks
    follow from the number of its first row.
    """
    numbered = number_rows(rows.where(F.col(value).isNotNull()).select(*group, value), [*group, value])
    extent = numbered.groupBy(*group).agg(F.min("row").alias("_first"), F.count("*").alias("_n"))
    wanted = extent.select(*group, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.col("_first") + F.ceil((F.col("_n") - 1) * p)).cast("long").alias("row")) for name, p in percentiles.items()])).alias("w"))
    keyed = wanted.select(*[F.col(c).alias(f"_{c}") for c in group], "w.name", F.col("w.row").alias("row"))
    found = numbered.join(keyed, "row")  # a row for each group and percentile
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in percentiles])


def mark_stale(meta: DataFrame, reason: str) -> DataFrame:
    """A snapshot's metadata (one row) with status stale and its fingerprint made anew from the former one."""
    text = F.concat_ws("|", "fingerprint", F.lit("stale"), F.lit(reason))
    return meta.withColumn("status", F.lit("stale")).withColumn("reason", F.lit(reason)).withColumn("fingerprint", F.sha2(text, 256))


def top_evidence(evidence: DataFrame, *, limit: int = 8) -> DataFrame:
    """(ref, evidence) with the first ``limit`` references of each record in order.

    Rows behind the limit are dropped before they are gathered, so an array never grows beyond it.
    """
    first = F.row_number().over(Window.partitionBy("ref").orderBy("ordinal"))
    kept = evidence.withColumn("_k", first).where(F.col("_k") <= limit)
    return kept.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("ordinal", "evidence_ref"))).alias("e")).select("ref", F.transform("e", lambda x: x["evidence_ref"]).alias("evidence"))
