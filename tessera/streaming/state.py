"""What stateful stream operators share: rows in order, and the state store that they need."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rows_in_order(batches: Iterator[pd.DataFrame], columns: list[str], order: list[str]) -> Iterator[dict]:
    """The rows of one key in a batch as plain Python values, nulls as None, in ``order`` (rows without the first of it left out)."""
    every = [b[columns] for b in batches]
    if not every:
        return
    rows = pd.concat(every, ignore_index=True).dropna(subset=order[:1]).sort_values(order, kind="stable")
    for row in rows.itertuples(index=False, name=None):
        yield {c: _plain(v) for c, v in zip(columns, row)}


def _plain(v):
    if v is None or isinstance(v, float) and v != v or v is pd.NaT:
        return None
    return v.item() if isinstance(v, np.generic) else v


def use_keyed_state(spark: SparkSession) -> None:
    """Have queries that this session starts from now on keep their state in RocksDB; those that run or are restarted keep theirs."""
    spark.conf.set(_PROVIDER, _ROCKS)


@contextmanager
def keyed_state(spark: SparkSession):
    """While this is open, queries that are started keep their state in RocksDB, as transformWithState needs; then as before."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
