"""Before-and-after deltas of product rows and the outcome of an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deltas(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, before, after, delta, changed): one row per key and field; null equals null.

    Both sides have to hold the same keys; a key of one side only fails the job.
    """
    b = before.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("b"))
    a = after.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("a"))
    joined = b.join(a, keys, "full_outer")
    checked = joined.where(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("keys differ")).cast("boolean")))
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").alias("before"), F.col(f"a.{f}").alias("after")) for f in fields])).alias("r")
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    return checked.select(*keys, rows).select(*keys, "r.*").withColumn("delta", F.col("after") - F.col("before")).withColumn("changed", changed)


def delta_summary(rows: DataFrame, product: str) -> DataFrame:
    """One row: changed and unchanged rows, and distinct products with a change."""
    return rows.agg(
        F.count_if("changed").alias("changed_rows"), F.count_if(~F.col("changed")).alias("unchanged_rows"),
        F.countDistinct(F.when(F.col("changed"), F.col(product))).alias("changed_products"),
    )


def untouched_changes(rows: DataFrame, product: str, tracked) -> DataFrame:
    """One row: changed rows of ``rows`` (of deltas) of other products than the ``tracked`` one."""
    return rows.agg(F.count_if(F.col("changed") & (F.col(product) != F.lit(tracked))).alias("untouched_changed_rows"))


def direction(delta: Column) -> Column:
    return F.when(delta > 0, F.lit("increase")).when(delta < 0, F.lit("decrease")).when(delta == 0, F.lit("unchanged")).otherwise(F.lit("unknown"))


def outcome(expected: Column, changed: Column, delta: Column, control_changed: Column) -> Column:
    """confirmed, refuted or inconclusive. An expected "unchanged" can't be confirmed, as no change refutes first."""
    return (
        F.when(control_changed, F.lit("inconclusive"))
        .when(~changed, F.lit("refuted"))
        .when(expected == "change", F.lit("confirmed"))
        .when(expected == direction(delta), F.lit("confirmed"))
        .otherwise(F.lit("refuted"))
    )


def evaluate(rows: DataFrame, hypotheses: DataFrame, controls: DataFrame, keys: list[str]) -> DataFrame:
    """(experiment_id, outcome, changed, delta, control_unchanged) of every hypothesis.

    ``rows``: deltas of (keys, field). ``hypotheses``: experiment_id, keys, field, changed_field (what the experiment set), expected.
    ``controls``: experiment_id, changed_field, before_value, after_value; a control whose values differ fails the job. One
    that changed the hypothesis's own field makes it inconclusive; control_unchanged is null without a control.
    A hypothesis about a row that is not there fails the job.
    """
    same = F.col("before_value").eqNullSafe(F.col("after_value"))
    sound = controls.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("values of a control differ")).cast("boolean")))
    fields = sound.groupBy("experiment_id").agg(F.collect_set("changed_field").alias("_controls"))  # as many as fields
    told = hypotheses.join(rows.select(*keys, "field", "changed", "delta"), [*keys, "field"], "left").join(fields, "experiment_id", "left")
    found = told.where(F.when(F.col("changed").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a hypothesis has no row")).cast("boolean")))
    disturbed = F.coalesce(F.array_contains("_controls", F.col("changed_field")), F.lit(False))
    return found.select("experiment_id", outcome(F.col("expected"), F.col("changed"), F.col("delta"), disturbed).alias("outcome"), "changed", "delta", F.when(F.col("_controls").isNotNull(), F.lit(True)).alias("control_unchanged"))


def converged(reads: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, reads, converged): whether all consecutive reads agree; null for fewer than three reads."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    same = F.when(F.col("_n") > 1, F.col(value).eqNullSafe(F.col("_b")))
    rows = reads.withColumn("_b", before).withColumn("_n", number)
    return rows.groupBy(*keys).agg(F.count("*").alias("reads"), F.when(F.count("*") >= 3, F.bool_and(same)).alias("converged"))
