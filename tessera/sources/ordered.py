"""Tables that are read in pages: sorted into files by ranges of their keys, with an index of what each file holds.

The index has a row a file: its first and last key and its number of rows. A page looks up the few files that
can hold it and reads those alone, however large the table is; so does the lookup of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sessions

#: Rows of a file. A page has fewer, so it lies in two or three files.
ROWS = 100_000


def write_ordered(rows: DataFrame, path: str, keys: list[str], *, per_file: int = ROWS) -> None:
    """Write ``rows`` under ``path`` in the order of ``keys``, which name each row and are not null, and the index of its files."""
    spark = rows.sparkSession
    # A task writes its range in files of ``per_file`` rows, so what is sampled for the ranges grows with tasks, not with files.
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", per_file).mode("overwrite").parquet(f"{path}/rows")
    key = F.struct(*keys)
    written = spark.read.parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), key.alias("key"))
    written.groupBy("file").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _after(key: Column, keys: list[str], value: tuple, strict: bool) -> Column:
    """Whether a struct of keys is above ``value`` (of its first keys), or equal to it if not ``strict``."""
    found = F.lit(not strict)
    for k in range(len(value) - 1, -1, -1):
        found = (key[keys[k]] > value[k]) | ((key[keys[k]] == value[k]) & found)
    return found


def page_files(spark: SparkSession, path: str, keys: list[str], *, limit: int, after: tuple | None = None, prefix: tuple = ()) -> list[str]:
    """The files that hold the next ``limit`` + 1 rows behind ``after`` whose first keys are ``prefix``; none if there are none."""
    index = spark.read.parquet(f"{path}/index")
    last, first = F.col("last"), F.col("first")
    if after is not None:
        index = index.where(_after(last, keys, after, True))
    if prefix:
        index = index.where(_after(last, keys, prefix, False) & ~_after(first, keys, prefix, True))
    found: list = []
    take = 4
    while True:  # the first file can lie mostly before the page, those after it are whole
        found = index.orderBy("first").limit(take).collect()
        if len(found) < take or sum(r.rows for r in found[1:]) > limit:
            break
        take *= 4
    total, files = 0, []
    for k, r in enumerate(found):
        files.append(r.file)
        total += r.rows if k else 0
        if total > limit:
            break
    return files


def read_page(spark: SparkSession, path: str, keys: list[str], *, limit: int, after: tuple | None = None, prefix: tuple = ()) -> DataFrame:
    """The next ``limit`` rows behind ``after`` in the order of ``keys``, with has_more; only rows whose first keys are ``prefix``."""
    files = page_files(spark, path, keys, limit=limit, after=after, prefix=prefix)
    schema = spark.read.parquet(f"{path}/rows").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    for name, value in zip(keys, prefix):
        rows = rows.where(F.col(name) == F.lit(value))
    return sessions.keyset_page(rows, keys, limit=limit, after=after)


def read_key(spark: SparkSession, path: str, keys: list[str], value: tuple) -> DataFrame:
    """The row of a key, or none; at most two files are read."""
    return read_page(spark, path, keys, limit=1, prefix=value).drop("has_more")
