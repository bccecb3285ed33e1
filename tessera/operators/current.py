"""Current state from observations, coverage of its surfaces, and the order and price plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.canonical import rows_fingerprint

WEEKS, MARKUP = 3, 1.05


def latest_state(observations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last positive observation of each key; what is not seen again stays as it was."""
    rest = [c for c in observations.columns if c not in keys]
    best = observations.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def split_by_roster(state: DataFrame, roster: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(verified, orphans): rows of ``state`` whose key the roster holds, and the others."""
    known = roster.select(key).distinct()
    return state.join(known, key, "left_semi"), state.join(known, key, "left_anti")


def surface_coverage(roster: DataFrame, surfaces: DataFrame, key: str) -> DataFrame:
    """(key, status) of every key of the roster: unknown where no surface was seen."""
    seen = surfaces.groupBy(key).agg(F.max_by("status", "observed_at").alias("status"))
    return roster.select(key).distinct().join(seen, key, "left").select(key, F.coalesce("status", F.lit("unknown")).alias("status"))


def resolve_catalog(observed: DataFrame, catalog: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, n_names, resolution) of observed ids: a name only if the catalogue has exactly one."""
    names = catalog.groupBy(key).agg(F.countDistinct(name).alias("n_names"), F.min(name).alias("_name"))
    joined = observed.select(key).distinct().join(names, key, "left")
    how = F.when(F.col("n_names").isNull(), F.lit("unknown")).when(F.col("n_names") == 1, F.lit("resolved")).otherwise(F.lit("ambiguous"))
    return joined.select(key, F.when(F.col("n_names") == 1, F.col("_name")).alias(name), F.coalesce("n_names", F.lit(0)).cast("long").alias("n_names"), how.alias("resolution"))


def catalog_fingerprint(catalog: DataFrame, key: str, name: str, version: int = 1) -> DataFrame:
    """One row (rows, fingerprint) of what the catalogue resolves: each id's only name, or that it is ambiguous."""
    names = catalog.groupBy(key).agg(F.countDistinct(name).alias("n"), F.min(name).alias("one"))
    meaning = names.select(F.col(key).cast("string").alias("id"), F.when(F.col("n") == 1, F.col("one").cast("string")).alias("name"), (F.col("n") > 1).cast("string").alias("ambiguous"), F.lit(str(version)).alias("version"))
    return rows_fingerprint(meaning, "id", "name", "ambiguous", "version")


def plan(rows: DataFrame, *, weeks: int = WEEKS) -> DataFrame:
    """``rows`` with target, order_qty, reference, recommended and flags.

    Rows have sales_volume, stock_qty, supply_qty, our_price, city_price, city_quality, stock_quality,
    profit. Flags stand in a fixed order, joined by commas.
    """
    if not 1 <= weeks <= 8:
        raise ValueError("weeks must be 1 to 8")
    target = F.lit(weeks) * F.col("sales_volume")
    order = F.greatest(F.lit(0), target - F.col("stock_qty") - F.col("supply_qty"))
    rated = (F.col("city_quality") > 0) & (F.col("stock_quality") > 0)
    with_reference = rows.withColumn("target", target).withColumn("order_qty", order).withColumn(
        "reference", F.when(rated, F.col("city_price") / F.col("city_quality") * F.col("stock_quality"))
    )
    priced = with_reference.withColumn("recommended", F.col("reference") * MARKUP)
    below = F.col("our_price") < F.col("city_price")
    flag: list[tuple[str, Column]] = [
        ("below_city", below),
        ("above_corridor", F.col("our_price") > F.col("recommended")),
        ("potential", below & (F.col("profit") > 0)),
        ("out_of_stock_risk", F.col("order_qty") > 0),
        ("unknown", F.col("reference").isNull()),
    ]
    return priced.withColumn("flags", F.concat_ws(",", *[F.when(when, F.lit(name)) for name, when in flag]))


def top_plan(rows: DataFrame, *, limit: int, weeks: int = WEEKS) -> DataFrame:
    """The ``limit`` rows with the largest margin, then the largest order."""
    margin = F.col("our_price") - F.col("supply_cost")
    return plan(rows, weeks=weeks).withColumn("margin", margin).orderBy(F.desc("margin"), F.desc("order_qty"), "unit_id", "product_id").limit(limit)
