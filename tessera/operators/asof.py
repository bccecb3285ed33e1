"""The last known value before each row, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import materialise


def last_known(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: of the rows of the same ``keys``, up to this one in ``order``, the last ``value`` that isn't null.

    Rows are dealt out by ranges of keys and order, so that a key with many rows is spread over tasks. Each
    partition carries values forward in itself; what a partition's last key brings into the next ones is a
    row a partition, and all that is sent to every task. Null keys are a key like any other.
    """
    key = F.struct(*[F.col(k) for k in keys])
    kept = materialise(rows.withColumn("_value", value).orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id()))
    placed = kept.withColumn("_part", F.shiftright("_id", 33))
    inside = F.last("_value", ignorenulls=True).over(Window.partitionBy("_part", *keys).orderBy("_id"))
    own = placed.withColumn("_own", inside)
    # Of each partition its last key and what is known of that key by then; of a run of partitions that end with
    # the same key the last value known, for the first key of the partition after them.
    ends = placed.groupBy("_part").agg(F.max_by(key, "_id").alias("_key"))
    told = own.groupBy("_part").agg(F.max_by(F.struct("_own"), "_id").alias("_end"))
    w = Window.partitionBy("_key").orderBy("_part")
    edges = ends.join(told, "_part").withColumn("_carried", F.last("_end._own", ignorenulls=True).over(w))
    after = edges.withColumn("_next", F.lead("_part").over(Window.orderBy("_part"))).where("_next IS NOT NULL")
    before = after.select(F.col("_next").alias("_part"), F.col("_key"), "_carried")
    joined = own.join(F.broadcast(before), "_part", "left")
    found = F.coalesce("_own", F.when(F.col("_key").eqNullSafe(key), F.col("_carried")))
    return joined.withColumn(name, found).drop("_value", "_id", "_part", "_own", "_key", "_carried")
