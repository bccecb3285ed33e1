"""Censuses of captured requests: endpoints, assets, routes, forms; first examples; partition manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import materialise

PART_SIZE = 60


def application_events(entries: DataFrame) -> DataFrame:
    """First-party requests that are not for static files; ``entries`` has first_party, path, resource_type."""
    from tessera.functions.normalise import is_static

    return entries.where(F.col("first_party") & ~is_static(F.col("path"), F.col("resource_type")))


def value_counts(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, facet, value, n): how often each value of each column stands in each group.

    All columns are unpivoted first, so one shuffle counts them all.
    """
    facets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")
    return rows.select(group, facets).groupBy(group, "f.facet", "f.value").agg(F.count("*").alias("n"))


def counts_as_text(counts: DataFrame, group: str) -> DataFrame:
    """(group, facet, counts): value counts of a facet as one text "value=n,..", in the order of values."""
    entry = F.struct(F.coalesce("value", F.lit("")).alias("value"), "n")
    listed = counts.groupBy(group, "facet").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ",")
    return listed.select(group, "facet", text.alias("counts"))


def endpoint_census(events: DataFrame, pattern: Column, keys: Column) -> DataFrame:
    """(path_pattern, count, query_keys): requests of each endpoint and the distinct query keys, sorted."""
    rows = events.select(pattern.alias("path_pattern"), keys.alias("keys"))
    counts = rows.groupBy("path_pattern").agg(F.count("*").alias("count"))
    distinct = rows.select("path_pattern", F.explode("keys").alias("key")).distinct()
    listed = distinct.groupBy("path_pattern").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("query_keys"))
    return counts.join(listed, "path_pattern", "left").select("path_pattern", "count", F.coalesce("query_keys", F.lit("")).alias("query_keys"))


def first_examples(rows: DataFrame, group: str, order: list[str], *, limit: int = 5) -> DataFrame:
    """The first ``limit`` rows of each group. Spark keeps ``limit`` rows a group and task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("example", rank).where(F.col("example") <= limit)


def route_census(tokens: DataFrame) -> DataFrame:
    """(pattern, count, captures, entries) from rows (capture, entry, token, pattern), one per token occurrence.

    A token counts once an entry; the captures of a pattern count its entries once each.
    """
    once = tokens.dropDuplicates(["capture", "entry", "token"])
    return once.groupBy("pattern").agg(
        F.count("*").alias("count"), F.countDistinct("capture").alias("captures"), F.countDistinct("capture", "entry").alias("entries")
    )


def form_dedup(forms: DataFrame) -> DataFrame:
    """(form_id, method, action, fields, observed, first_seen) of distinct forms from rows (form_id, method, action, fields, page)."""
    return forms.groupBy("form_id", "method", "action", "fields").agg(F.countDistinct("page").alias("observed"), F.min("page").alias("first_seen"))


def partition_manifest(rows: DataFrame, order: list[str], *, size: int = PART_SIZE) -> DataFrame:
    """(part, records, offset, first_key) of the parts of ``size`` rows in ``order``.

    Rows are numbered without gathering them: range partitions are counted, and each partition's rows
    are numbered from the count of those before it.
    """
    numbered = number_rows(rows.select(*order), order)
    part = F.floor((F.col("row") - 1) / size)
    parts = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("records"), F.min(F.struct("row", order[0])).alias("f"))
    return parts.select("part", "records", (F.col("f.row") - 1).alias("offset"), F.col(f"f.{order[0]}").alias("first_key"))


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with row, their number from 1 in ``order``, for any number of rows.

    The sort deals rows out by ranges; the sorted table is kept once, so that counting its partitions and
    numbering the rows in them see the same ones. Only the counts, one row a partition, are gathered.
    """
    kept = materialise(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = kept.withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return joined.withColumn("row", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_before")
