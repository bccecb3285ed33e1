"""Small files that appear whole: written under another name and renamed, through Hadoop's file systems.

On stores whose rename is not atomic (object stores) put ``root`` on a file system or table format
that has one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _paths(spark: SparkSession, *names: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [make(n) for n in names]


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    (at,) = _paths(spark, path)
    return _system(spark, at).exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if it isn't there."""
    (at,) = _paths(spark, path)
    fs = _system(spark, at)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _rename(spark: SparkSession, path: str, text: str, how: str) -> None:
    at, draft = _paths(spark, path, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.draft")
    stream = _system(spark, draft).create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = getattr(kind, how)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(draft), context.makeQualified(at), options)


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write ``path`` in one step; FileExistsError if somebody else has written it."""
    if not exists(spark, path):
        try:
            return _rename(spark, path, text, "NONE")
        except Exception:
            if not exists(spark, path):
                raise
    raise FileExistsError(path)


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Write ``path`` in one step, over what may be there: a reader sees the old text or the new one."""
    _rename(spark, path, text, "OVERWRITE")


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    (at,) = _paths(spark, folder)
    fs = _system(spark, at)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
