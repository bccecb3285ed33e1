"""Checks of published tables: keys, references, provenance, mirrors, and what must not leave the store."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that carry raw values. Fixed values of the policy; so is the ending of others.
FORBIDDEN = ("authorization", "cookie", "cookies", "headers", "raw_html", "websocket_payload", "cas_bytes", "request_body", "response_body", "query_value", "body_value", "form_value")
FORBIDDEN_END = "_value"


def _problem(rows: DataFrame, table: str, keys: list[str], problem: str) -> DataFrame:
    key = F.array_join(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), "/")
    return rows.select(F.lit(table).alias("table"), key.alias("key"), F.lit(problem).alias("problem"))


def repeated_keys(rows: DataFrame, table: str, keys: list[str]) -> DataFrame:
    return _problem(rows.groupBy(*keys).count().where("count > 1"), table, keys, "repeated key")


def dangling(rows: DataFrame, table: str, keys: list[str], column: str, target: DataFrame, to: str, *, absent: bool = True) -> DataFrame:
    """Rows whose ``column`` names nothing in ``target`` (or something, if not ``absent``)."""
    known = target.select(F.col(to).alias(column)).distinct()
    return _problem(rows.join(known, column, "left_anti" if absent else "left_semi"), table, keys, f"{column} is {'not ' if absent else ''}in {to}")


def bad_provenance(rows: DataFrame, table: str, keys: list[str], sessions: DataFrame) -> DataFrame:
    """Rows whose source_session_id is not replayed, or whose source_sequence is not below its event_count."""
    told = rows.where("source_session_id IS NOT NULL").join(sessions.select(F.col("session_id").alias("source_session_id"), "event_count"), "source_session_id", "left")
    unknown = _problem(told.where("event_count IS NULL"), table, keys, "source session is not replayed")
    return unknown.unionByName(_problem(told.where("event_count IS NOT NULL AND coalesce(source_sequence >= event_count, true)"), table, keys, "source sequence is out of range"))


def snapshot_problems(t: dict[str, DataFrame]) -> DataFrame:
    """(table, key, problem) of every broken rule of a snapshot; a sound one gives no rows.

    ``t``: sessions (session_id, event_count), companies (company_id), units (unit_id, company_id), products
    (product_id), unit_products and orphans (unit_id, product_id), surfaces (unit_id, surface); all but
    sessions and products with source_session_id and source_sequence.
    """
    keys = {"sessions": ["session_id"], "companies": ["company_id"], "units": ["unit_id"], "products": ["product_id"], "unit_products": ["unit_id", "product_id"], "orphans": ["unit_id", "product_id"], "surfaces": ["unit_id", "surface"]}
    found = [repeated_keys(t[n], n, k) for n, k in keys.items()]
    found += [bad_provenance(t[n], n, keys[n], t["sessions"]) for n in ("companies", "units", "unit_products", "orphans", "surfaces")]
    found.append(dangling(t["units"], "units", keys["units"], "company_id", t["companies"], "company_id"))
    for n in ("unit_products", "orphans"):
        found.append(dangling(t[n], n, keys[n], "product_id", t["products"], "product_id"))
        found.append(dangling(t[n], n, keys[n], "unit_id", t["units"], "unit_id", absent=n == "unit_products"))
    found.append(dangling(t["surfaces"], "surfaces", keys["surfaces"], "unit_id", t["units"], "unit_id"))
    return reduce(DataFrame.unionByName, found)


def ledger_problems(meta: DataFrame, sessions: DataFrame) -> DataFrame:
    """Where the one row of ``meta`` (session_count, last_session_id, last_sequence) disagrees with the replayed sessions.

    ``sessions``: session_id, started_at, last_sequence; the last one is that which started last, ties by id.
    """
    last = sessions.agg(F.count("*").alias("n"), F.max(F.struct("started_at", "session_id", "last_sequence")).alias("l"))  # one row
    both = meta.crossJoin(F.broadcast(last))  # one row with one row
    told = [("session_count", F.col("n")), ("last_session_id", F.col("l.session_id")), ("last_sequence", F.col("l.last_sequence"))]
    rows = F.explode(F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(is_), F.lit(c)) for c, is_ in told]), lambda x: x.isNotNull())).alias("problem")
    return both.select(F.lit("meta").alias("table"), F.lit("").alias("key"), rows)


def mirror_problems(records: DataFrame, mirror: DataFrame) -> DataFrame:
    """Rows, repeats counted, that only one of two tables of the same columns has; side is records or mirror."""
    cols = records.columns
    one = records.exceptAll(mirror.select(*cols)).withColumn("side", F.lit("records"))
    return one.unionByName(mirror.select(*cols).exceptAll(records).withColumn("side", F.lit("mirror")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def forbidden_paths(texts: pd.Series) -> pd.Series:
    """Paths of the fields of each JSON text that must not leave the store; "not JSON" for another text."""

    def walk(value, path):
        if isinstance(value, dict):
            for k, v in value.items():
                name = k.casefold()
                if name in FORBIDDEN or name.endswith(FORBIDDEN_END):
                    yield f"{path}.{k}"
                else:
                    yield from walk(v, f"{path}.{k}")
        elif isinstance(value, list):
            for k, v in enumerate(value):
                yield from walk(v, f"{path}[{k}]")
        elif isinstance(value, str) and "\0" in value:
            yield path

    def read(text):
        try:
            return list(walk(json.loads(text), "$"))
        except (TypeError, ValueError):
            return ["not JSON"]

    return texts.map(read)


def privacy_audit(documents: DataFrame, key: str, text: Column | str = "payload") -> DataFrame:
    """(key, path) of every field of the JSON documents that carries raw values; sound documents give no rows."""
    column = F.col(text) if isinstance(text, str) else text
    return documents.select(key, F.explode(forbidden_paths(column)).alias("path"))
