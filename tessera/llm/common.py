"""Shared pieces of the training-data operators: table access, the shared folder, text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the corpus: a run of bytes other than the ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the given Parquet tables, pruned to ``columns`` if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is missing in a local session, as in tests, a temporary folder stands in; a cluster has
    to name one, as a folder of the driver's machine would be no use to its executors.
    """
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def free_of(df: DataFrame, *names: str) -> None:
    """Raise ValueError if ``df`` has a column of one of the ``names``, in any case, that are to be added."""
    if taken := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns are there already: {', '.join(sorted(taken))}")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def id_hash(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def utf8(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column without decoding them; null texts are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [b or b"" for b in texts.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices with at most ``most`` bytes of text in ``column`` each, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + most, "right")))
        yield batch.slice(k, end - k)
        k = end


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of ``texts`` (no nulls) in a row, A-Z in lower case, and the number of each text's words.

    Arrow splits and numbers the words, so no Python object is made for a word that comes again.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, of = lists.flatten(), pc.list_parent_indices(lists)
    if len(flat) and (blank := pc.equal(flat, "")).true_count:  # white space at an end gives an empty word
        keep = pc.invert(blank)
        flat, of = flat.filter(keep), of.filter(keep)
    return flat.dictionary_encode(), np.bincount(of.to_numpy(), minlength=len(texts))
