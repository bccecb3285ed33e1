"""The corpus pipeline: toxicity, quality, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again for the next stage. All but the last return the columns of documents and
keep whatever other columns they are given, whatever their names. A null text counts as empty. An empty
table of documents gives an empty table; without labels nothing is rejected as toxic, and every document
has quality 0.5 and stays. Rows that repeat a doc_id are documents of their own in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality, simhash, toxicity
from tessera.llm.common import new_shared_path, table
from tessera.llm.queries import toxicity_chain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't hold toxic.

    Every row is judged by its whole text, of any length; rows with equal texts are judged alike, null and
    empty texts as a text without words.
    """
    chain = toxicity_chain(docs, table(spark, sf_dir, "labels"))
    return docs.where(F.element_at(toxicity.probabilities(F.col("text"), chain), -1) <= chain.threshold)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees hold good: score 0.5 and above.

    Every row is judged by its whole text; rows with equal texts are judged alike, null and empty texts by
    statistics that are all zero.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.good(F.col("text"), model) >= 0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose five-word shingles are at least 0.8 similar.

    The row with the least doc_id stays, of several texts under that doc_id the one with the least digest, of
    equal rows one. Null, empty and blank texts are one group; two texts under one doc_id are two documents.
    """
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it, three times at most.

    Documents without words are not taken. A null source is a source of its own.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; a document without words is its end token."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifiers, hashes and tokens of the stages are beyond SQL; tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        path = new_shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
