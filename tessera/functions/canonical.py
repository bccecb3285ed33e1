"""Canonical text and digests of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once a row however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def canonical_json(**fields: Column) -> Column:
    """JSON object with its names in order and nulls written out. Use for text and whole numbers."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def canonical_sha256(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def versioned_ref(namespace: str, identity: Column, prefix: str = "ts") -> Column:
    """Stable reference: the first 24 digits of the identity's digest under a versioned name."""
    return F.concat(F.lit(f"{prefix}.{namespace}.v1."), F.substring(F.sha2(identity, 256), 1, 24))


def rows_fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, fingerprint) that does not depend on the order of ``rows``.

    Each row's digest is taken as four numbers of 32 bits which are summed, so partial sums meet at the
    end and no row order or collected list is needed; equal multisets give equal digests.
    """
    digest = F.sha2(canonical_json(**{c: F.col(c) for c in columns}), 256)
    parts = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).alias(f"s{k}") for k, p in enumerate(parts)]
    total = rows.select(*columns).agg(F.count("*").alias("rows"), *sums)
    text = F.concat_ws("-", *[F.col(c).cast("string") for c in ("rows", "s0", "s1", "s2", "s3")])
    return total.select("rows", F.sha2(text, 256).alias("fingerprint"))


def values_fingerprint(rows: DataFrame) -> DataFrame:
    """One row (rows, fingerprint) over all values of all columns, as ``rows_fingerprint`` but without a text of each row.

    It tells tables apart that differ by accident; 128 bits of sums of XXH64 are no proof against intent. Nulls and
    negative zeros, which XXH64 passes over, are told by flags; arrays, structs and maps are hashed as JSON.
    """
    columns, flags = [], []
    for c in sorted(rows.columns):
        kind, value = rows.schema[c].dataType, F.col(f"`{c}`")
        if not isinstance(kind, T.AtomicType) or isinstance(kind, T.VariantType):
            value = F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))
        flag = F.when(value.isNull(), "0")
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            flag = flag.when((value == 0) & value.cast("string").startswith("-"), "2")
        columns.append(value)
        flags.append(flag.otherwise("1"))
    parts = [F.shiftrightunsigned(F.xxhash64(F.lit(k), F.concat(*flags), *columns), 32) for k in range(4)]
    total = rows.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"s{k}") for k, p in enumerate(parts)])
    return total.select("rows", F.sha2(F.concat_ws("-", *[F.col(c).cast("string") for c in total.columns]), 256).alias("fingerprint"))
