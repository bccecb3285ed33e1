"""What a page's structure offers: its links and inputs by pattern, without its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.normalise import route
from tessera.functions.pages import page_links
from tessera.functions.tables import page_rows


def link_inventory(pages: DataFrame, *, limit: int | None = None) -> DataFrame:
    """(page_id, pattern, n) of the origin-relative links of each page, the ``limit`` most frequent if one is given."""
    from pyspark.sql import Window

    each = pages.select("page_id", F.explode(page_links("html")).alias("href")).where(F.col("href").rlike("^/(?!/)"))
    counts = each.groupBy("page_id", route(F.col("href")).alias("pattern")).agg(F.count("*").alias("n"))
    if limit is None:
        return counts
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "pattern"))
    return counts.withColumn("_k", rank).where(F.col("_k") <= limit).drop("_k")


def input_inventory(pages: DataFrame) -> DataFrame:
    """(page_id, name, n) of the inputs in table cells, indexes in names left open."""
    values = F.explode(F.flatten(F.transform("cells", lambda c: F.map_keys(c["values"]))))
    found = page_rows(pages.select("page_id", "html")).select("page_id", values.alias("name"))
    return found.groupBy("page_id", F.regexp_replace("name", r"\[[0-9]+\]", "[n]").alias("name")).agg(F.count("*").alias("n"))


def identity_candidates(links: Column, pattern: str) -> Column:
    """Distinct identifiers that the links of a page name, in their order."""
    ids = F.transform(links, lambda h: F.regexp_extract(h, pattern, 1))
    return F.array_distinct(F.filter(ids, lambda i: i.rlike("^[1-9][0-9]{0,18}$")))
