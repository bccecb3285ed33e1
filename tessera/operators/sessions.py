"""Session roll-ups, comparison and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = (
    "event_count", "action_count", "http_request_count", "http_response_count", "strong_count", "probable_count", "temporal_count", "exact_count",
    "uncorrelated_count", "warning_count", "anomaly_count",
)


def is_action() -> Column:
    return F.col("source").isin("dom.action", "bas.action") & F.col("event_type").isin("dom.action", "bas.action")


def is_request() -> Column:
    return (F.col("source") == "cdp.network") & (F.col("event_type") == "http.request")


def uncorrelated_actions(events: DataFrame, links: DataFrame) -> DataFrame:
    """(session_id, event_id) of actions that no link names."""
    actions = events.where(is_action() & (F.col("event_id") != "")).select("session_id", "event_id").distinct()
    linked = links.select("session_id", F.col("action_event_id").alias("event_id"))
    return actions.join(linked, ["session_id", "event_id"], "left_anti")


def summaries(events: DataFrame, links: DataFrame, warnings: DataFrame) -> DataFrame:
    """The eleven counters of every session of ``events``.

    ``links``: (session_id, action_event_id, status) of correlations; ``warnings``: (session_id,
    warning_count). Sessions without links or warnings have zeros.
    """
    net = F.col("source") == "cdp.network"
    own = events.groupBy("session_id").agg(
        F.count("*").alias("event_count"),
        F.countDistinct(F.when(is_action() & (F.col("event_id") != ""), F.col("event_id"))).alias("action_count"),
        F.count_if(is_request()).alias("http_request_count"),
        F.count_if(net & (F.col("event_type") == "http.response")).alias("http_response_count"),
        F.count_if(net & (F.col("event_type") == "http.failed")).alias("anomaly_count"),
    )
    status = {"strong_count": "strong", "probable_count": "probable", "temporal_count": "temporal-only", "exact_count": "exact"}
    of_links = links.groupBy("session_id").agg(*[F.count_if(F.col("status") == s).alias(c) for c, s in status.items()])
    missed = uncorrelated_actions(events, links).groupBy("session_id").agg(F.count("*").alias("uncorrelated_count"))
    joined = own.join(of_links, "session_id", "left").join(missed, "session_id", "left").join(warnings, "session_id", "left")
    return joined.select("session_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def compare(rows: DataFrame, before: str, after: str) -> DataFrame:
    """One row: each counter's change from session ``before`` to ``after``, and whether each was found."""
    pick = rows.where(F.col("session_id").isin(before, after))
    one = lambda c, s: F.max(F.when(F.col("session_id") == s, F.col(c)))
    delta = [(one(c, after) - one(c, before)).alias(f"{c}_delta") for c in COUNTERS]
    found = [F.coalesce(F.bool_or(F.col("session_id") == s), F.lit(False)).alias(n) for n, s in (("before_found", before), ("after_found", after))]
    return pick.agg(*found, *delta)


def has_signal() -> Column:
    return (F.col("warning_count") > 0) | (F.col("anomaly_count") > 0) | (F.col("uncorrelated_count") > 0)


def keyset_page(rows: DataFrame, keys: list[str], *, limit: int, after: tuple | None = None) -> DataFrame:
    """The next ``limit`` rows in the order of ``keys`` behind ``after``, with has_more.

    One row more is fetched to know whether there are more; the plan is a top-k without a full sort.
    """
    if after is not None:
        behind = F.lit(False)
        for k in range(len(keys) - 1, -1, -1):
            behind = (F.col(keys[k]) > F.lit(after[k])) | ((F.col(keys[k]) == F.lit(after[k])) & behind)
        rows = rows.where(behind)
    page = rows.orderBy(*keys).limit(limit + 1)
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(*keys))  # over limit + 1 rows
    total = F.count("*").over(Window.partitionBy())
    return page.withColumn("_n", n).withColumn("has_more", total > limit).where(F.col("_n") <= limit).drop("_n")
