"""A bounded sample of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled documents that a classifier is fitted on.
MAX_LABELLED = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: list[str], *, where: Column | None = None, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, targets) of at most ``limit`` labelled documents, the first by a hash of their id.

    A doc_id that is labelled more than once counts with the rounded mean of its labels; one that
    ``docs`` repeats counts once, with the least of its texts. Rows without doc_id or without one of the labels are not used. Only
    the ids in the sample are sent to the tasks that read ``docs``, so their size is bounded.
    """
    own = labels if where is None else labels.where(where)
    chosen = (
        own.groupBy("doc_id")
        .agg(*[F.round(F.avg(t)).cast("int").alias(t) for t in targets])
        .dropna()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", *targets).agg(F.min("text").alias("text"))
