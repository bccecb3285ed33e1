"""Typed JSON artifacts: read strictly, and only if writing them again gives the same text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.canonical import once

#: Fields of a row of unit economics, whole numbers but the two qualities. Fixed values.
NUMBERS = ("city_price", "our_price", "product_numeric_id", "profit", "revenue", "sales_volume", "stock_qty", "supply_cost", "supply_qty")
_ROW = "city_price: bigint, city_quality: double, our_price: bigint, product_numeric_id: bigint, profit: bigint, revenue: bigint, sales_volume: bigint, stock_qty: bigint, stock_quality: double, supply_cost: bigint, supply_qty: bigint"
GOODS = f"contract_version int, coverage string, rows array<struct<{_ROW}>>, schema string, unit_id string"
#: Schema of unit economics, what all its versions begin with, its contract, its coverage, most rows. Fixed values.
SCHEMA, FAMILY, CONTRACT, OBSERVED, MOST_ROWS = "unit-economics/v1", "unit-economics/", 1, "observed", 512
#: Fields and versions of the artifact of a company's page. Fixed values.
PAGE = "media_type string, sanitizer_version int, schema_version string, text string, title string"
PAGE_SCHEMA, SANITIZER, HTML = "1.0", 2, "text/html"


def _written(page: Column) -> Column:
    return F.to_json(page, {"ignoreNullFields": "false"})


def unit_economics(text: Column, schema: str = SCHEMA) -> Column:
    """struct(page, problem): the page of a canonical artifact, or why it is none.

    Canonical text has sorted names and no spaces; so reading and writing it again shows unknown,
    repeated and missing names at once. "incompatible" is an artifact of the same family with another
    schema or contract, whatever else it holds.
    """
    return once(text, lambda t: once(F.from_json(t, GOODS, {"mode": "PERMISSIVE"}), lambda page: _judged(t, page, schema)))


def _judged(text: Column, page: Column, schema: str) -> Column:
    told, contract = F.get_json_object(text, "$.schema"), F.get_json_object(text, "$.contract_version")
    other = told.startswith(FAMILY) & ((told != schema) | ~F.coalesce(contract == str(CONTRACT), F.lit(False)))
    ids = F.transform(page["rows"], lambda r: r["product_numeric_id"])
    fine = F.forall(page["rows"], lambda r: (r["product_numeric_id"] > 0) & (r["city_quality"] >= 0) & (r["stock_quality"] >= 0) & (F.least(*[r[n] for n in NUMBERS]) >= 0))
    problem = (
        F.when(F.coalesce(other, F.lit(False)), F.lit("incompatible"))
        .when(page.isNull() | ~F.coalesce(_written(page) == text, F.lit(False)) | (page["schema"] != schema) | (page["coverage"] != OBSERVED), F.lit("not canonical"))
        .when(F.size(ids) > MOST_ROWS, F.lit("too many rows"))
        .when(F.size(F.array_distinct(ids)) != F.size(ids), F.lit("repeated product"))
        .when(~F.coalesce(fine, F.lit(False)), F.lit("out of range"))
    )
    return once(problem, lambda p: F.struct(F.when(p.isNull(), page).alias("page"), p.alias("problem")))


def unit_economics_text(unit_id: Column, rows: Column, schema: str = SCHEMA) -> Column:
    """The canonical artifact of a unit's rows (an array of structs with the fields of NUMBERS and the qualities)."""
    names = sorted([*NUMBERS, "city_quality", "stock_quality"])
    ordered = F.transform(rows, lambda r: F.struct(*[r[n].cast("double" if n.endswith("quality") else "long").alias(n) for n in names]))
    return _written(F.struct(F.lit(CONTRACT).alias("contract_version"), F.lit(OBSERVED).alias("coverage"), ordered.alias("rows"), F.lit(schema).alias("schema"), unit_id.cast("string").alias("unit_id")))


def company_page(text: Column) -> Column:
    """struct(title, text, problem) of a company page's artifact: its title and text, or why it is none."""
    return once(text, lambda t: once(F.from_json(t, PAGE, {"mode": "PERMISSIVE"}), lambda page: _judged_company(t, page)))


def _judged_company(text: Column, page: Column) -> Column:
    problem = (
        F.when(page.isNull() | ~F.coalesce(_written(page) == text, F.lit(False)), F.lit("not canonical"))
        .when((page["schema_version"] != PAGE_SCHEMA) | (page["sanitizer_version"] != SANITIZER), F.lit("incompatible"))
        .when(page["media_type"] != HTML, F.lit("other media type"))
        .when(page["text"].isNull(), F.lit("no text"))
    )
    sound = problem.isNull()
    return F.struct(F.when(sound, page["title"]).alias("title"), F.when(sound, page["text"]).alias("text"), problem.alias("problem"))


def company_page_text(title: Column, text: Column) -> Column:
    """The canonical artifact of a company's page."""
    return _written(F.struct(F.lit(HTML).alias("media_type"), F.lit(SANITIZER).alias("sanitizer_version"), F.lit(PAGE_SCHEMA).alias("schema_version"), text.alias("text"), title.alias("title")))


def ref(text: Column) -> Column:
    """The reference of an artifact: the digest of its bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))
