"""Market observations: append-only log, latest row per key, order-free fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order`` (ties broken by its last columns), with n, the rows seen.

    One hash aggregation with partial results in the map tasks: no sort, and a hot key costs one row a task.
    """
    rest = [c for c in rows.columns if c not in keys]
    whole = F.struct(*[F.col(c) for c in rest])
    best = rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_best"), F.count("*").alias("n"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest], "n")


def append(log: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """``log`` with the rows of ``new`` whose identity it doesn't hold yet, each once.

    A row that ``log`` or ``new`` holds already, equal in every column, is the same observation; one with
    the same identity and other values is a conflict, which fails the job.
    """
    rest = [c for c in log.columns if c not in identity]
    whole = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(True).alias("_"))
    one = new.groupBy(*identity).agg(F.min(whole).alias("_a"), F.max(whole).alias("_b"))
    held = log.groupBy(*identity).agg(F.min(whole).alias("_c"))
    met = one.join(held, identity, "left")
    same = F.col("_a").eqNullSafe(F.col("_b")) & (F.col("_c").isNull() | F.col("_c").eqNullSafe(F.col("_a")))
    # One expression says what is new, so that no row can be left out before it is looked at.
    fresh = F.when(same, F.col("_c").isNull()).otherwise(F.raise_error(F.lit("observation conflicts with another of the same identity")).cast("boolean"))
    return log.unionByName(met.where(fresh).select(*identity, *[F.col(f"_a.{c}").alias(c) for c in rest]).select(*log.columns))


def page_fingerprints(rows: DataFrame, page: list[str], order: str) -> DataFrame:
    """(page, rows, fingerprint): the digest of each page's rows, all columns but ``order``, as canonical JSON in ``order``.

    Rows in another order are another page.
    """
    names = sorted(c for c in rows.columns if c not in page and c != order)
    one = F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"})
    listed = rows.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), one.alias("row")))).alias("r"))
    return listed.select(*page, F.size("r").cast("long").alias("rows"), F.sha2(F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["row"]), ","), F.lit("]")), 256).alias("fingerprint"))
