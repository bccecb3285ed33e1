"""Checks on evidence: contiguous sequences, unique ids, and differences between datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequence_gaps(events: DataFrame) -> DataFrame:
    """(session_id, events, first, last, distinct, contiguous) of each session.

    A sequence is contiguous if it starts at 0 and its distinct numbers, as many as rows, end at n-1; so
    no session has to be sorted.
    """
    found = events.groupBy("session_id").agg(
        F.count("*").alias("events"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.countDistinct("sequence").alias("distinct")
    )
    ok = (F.col("first") == 0) & (F.col("last") == F.col("events") - 1) & (F.col("distinct") == F.col("events"))
    return found.withColumn("contiguous", ok)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand in more than one row, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, repeats counted, that only one side has: side is "left" or "right"."""
    cols = left.columns
    one = left.exceptAll(right.select(*cols)).withColumn("side", F.lit("left"))
    return one.unionByName(right.select(*cols).exceptAll(left).withColumn("side", F.lit("right")))


def require(rows: DataFrame, condition: str, message: str) -> DataFrame:
    """``rows``, failing the job at the first row that doesn't meet ``condition`` (a null counts as not met)."""
    ok = F.coalesce(F.expr(condition), F.lit(False))
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
