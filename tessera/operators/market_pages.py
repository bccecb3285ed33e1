"""Market and goods pages: typed rows out of table rows; a page with one bad row gives none.

``pages`` has page_id, html and what identifies the page. Each function returns (rows, problems): the
rows of sound pages, and one row for every page that is not, with the number of its bad rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.normalise import canonical_id, money, percent
from tessera.functions.tables import page_rows

#: Links of the pages. Fixed values.
GROUP_LINK = r"^/analitics/retailmarket/\?city=([0-9]+)&retailgroup=([0-9]+)$"
CITY_LINK = r"^/city/\?id=([0-9]+)$"
VENDOR_LINK = r"^/analitics/vendors/\?product=([0-9]+)$"
LEVEL = "Уровень цен:"


def _cell(k: int) -> Column:
    return F.try_element_at("cells", F.lit(k + 1))


def _link(k: int, pattern: str, group: int = 1) -> Column:
    """The identifier in a cell's only link; null otherwise."""
    href = F.when(F.size(_cell(k)["hrefs"]) == 1, _cell(k)["hrefs"][0])
    return canonical_id(F.regexp_extract(href, pattern, group))


def _sound(rows: DataFrame, good: Column, unique: list[str]) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    # Equal names lie next to each other in the order of their page, so that one shuffle and one sort serve both windows.
    beside, name = Window.partitionBy("page_id").orderBy(*unique), F.struct(*unique)
    again = F.lag(name).over(beside).eqNullSafe(name) | F.lead(name).over(beside).eqNullSafe(name)
    bad = F.count_if(~F.col("_good") | F.col("_again")).over(Window.partitionBy("page_id"))
    judged = marked.withColumn("_again", again).withColumn("_bad", bad)
    problems = judged.where("_bad > 0").groupBy("page_id").agg(F.max("_bad").alias("bad_rows"))
    return judged.where("_bad = 0").drop("_good", "_again", "_bad"), problems


def city_groups(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retail groups of a city: nine cells, two links to the same group, money and percentages. ``pages`` has city_id."""
    data = page_rows(pages).where((F.size("cells") == 9) & ~F.exists("cells", lambda c: c["colspan"] > 1))
    level = F.element_at(F.filter(_cell(8)["titles"], lambda t: t.startswith(LEVEL)), 1)
    typed = data.select(
        "page_id", "city_id", _link(0, GROUP_LINK, 1).alias("_city"), _link(0, GROUP_LINK, 2).alias("group_id"), _link(1, GROUP_LINK, 2).alias("_again_id"), _cell(1)["text"].alias("group_name"),
        money(_cell(2)["text"]).alias("sales_volume"), percent(_cell(4)["text"]).alias("delta_percent"), percent(_cell(5)["text"]).alias("share_percent"), percent(_cell(6)["text"]).alias("markup_percent"),
        percent(F.trim(F.substring(level, len(LEVEL) + 1, 100))).alias("price_level_percent"),
    )
    numbers = ["sales_volume", "delta_percent", "share_percent", "markup_percent", "price_level_percent"]
    whole = F.lit(True)
    for n in numbers:
        whole = whole & F.col(n).isNotNull()
    good = (F.col("_city") == F.col("city_id")) & (F.col("group_id") == F.col("_again_id")) & (F.col("group_name") != "") & whole
    rows, problems = _sound(typed, good, ["group_id"])
    return rows.drop("_city", "_again_id"), problems


def group_cities(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cities of a retail group: five cells, the first with the city's link, basket price and quality."""
    data = page_rows(pages).where((F.size("cells") == 5) & (F.size(_cell(0)["hrefs"]) > 0))
    value = lambda name: F.element_at(F.map_values(F.map_filter(_cell(0)["values"], lambda k, v: k.startswith(name))), 1)
    number = lambda c: F.when(c.rlike(r"^[0-9]+(\.[0-9]+)?$"), c.try_cast("double"))
    typed = data.select("page_id", "group_id", _link(0, CITY_LINK).alias("city_id"), _cell(0)["text"].alias("city_name"), number(value("basketPrice")).alias("price"), number(value("basketQuality")).alias("quality"))
    good = F.col("city_id").isNotNull() & (F.col("city_name") != "") & F.col("price").isNotNull() & F.col("quality").isNotNull()
    return _sound(typed, good, ["city_id"])


def carry_forward(rows: DataFrame, group: list[str], order: list[str], heading: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the last ``heading`` that was not null in the group, this row's own included."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(heading, ignorenulls=True).over(before))


def vendor_products(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products of the vendors page under the heading before them, which is carried forward over rows."""
    rows = page_rows(pages)
    grouped = carry_forward(rows, ["page_id", "table"], ["row"], "heading", "group_name")
    links = F.filter(F.flatten(F.transform("cells", lambda c: c["hrefs"])), lambda h: h.startswith("/analitics/vendors/"))
    typed = grouped.where(F.col("heading").isNull()).select("page_id", "group_name", F.explode(links).alias("href")).select("page_id", "group_name", canonical_id(F.regexp_extract("href", VENDOR_LINK, 1)).alias("product_id"))
    return _sound(typed, F.col("product_id").isNotNull() & (F.col("group_name") != ""), ["product_id"])


def goods(pages: DataFrame, link: str = r"[?&]product=([0-9]+)") -> tuple[DataFrame, DataFrame]:
    """Unit economics of a goods page: fifteen cells a row, two links that name the same product."""
    data = page_rows(pages).where(F.size("cells") >= 15)
    text = lambda k: _cell(k)["text"]
    leading = lambda k: F.replace(F.regexp_extract(text(k), "^[0-9]+(?: [0-9]{3})*", 0), F.lit(" "), F.lit("")).try_cast("long")
    quality = lambda k: F.regexp_extract(text(k), r"^[0-9]+(\.[0-9]+)?", 0).try_cast("double")
    pair = F.regexp_extract_all(text(3), F.lit(r"(?<![-−0-9])[0-9]+(?: [0-9]{3})*"), F.lit(0))
    amount = lambda k: F.replace(F.try_element_at(pair, F.lit(k)), F.lit(" "), F.lit("")).try_cast("long")
    given = lambda k, name, empty=None: F.element_at(F.transform(F.map_values(F.map_filter(_cell(k)["values"], lambda n, v: n.startswith(name))), lambda v: F.when(v == "", F.lit(empty).cast("long")).otherwise(v.try_cast("long"))), 1)
    typed = data.select(
        "page_id", "unit_id", _link(0, link).alias("product_id"), _link(1, link).alias("_same"), F.when(F.size(pair) == 2, amount(1)).alias("revenue"), F.when(F.size(pair) == 2, amount(2)).alias("profit"),
        leading(5).alias("stock_qty"), quality(6).alias("stock_quality"), given(9, "price").alias("our_price"), quality(10).alias("city_quality"), leading(11).alias("city_price"),
        leading(12).alias("sales_volume"), given(14, "purchaseQuantity").alias("supply_qty"), given(14, "vendorPrice", 0).alias("supply_cost"),
    )
    whole = F.col("product_id") == F.col("_same")
    for c in typed.columns[4:]:
        whole = whole & F.col(c).isNotNull()
    rows, problems = _sound(typed, whole, ["product_id"])
    return rows.drop("_same"), problems


def roster(pages: DataFrame, unit: str = r"^(.+) \(([0-9]+)\)$") -> tuple[DataFrame, DataFrame]:
    """Units of a company page (page_id, text): three lines in a row are city, unit with its id, and level."""
    lines = pages.select("page_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    w = Window.partitionBy("page_id").orderBy("at")
    around = lines.select("page_id", F.lag("line").over(w).alias("city"), "line", F.lead("line").over(w).alias("level"))
    found = around.where(F.col("line").rlike(unit)).select(
        "page_id", F.regexp_extract("line", unit, 2).alias("unit_id"), F.trim(F.regexp_extract("line", unit, 1)).alias("name"), F.trim("city").alias("city"), F.trim("level").try_cast("int").alias("level")
    )
    return _sound(found, (F.col("city") != "") & F.col("level").isNotNull() & (F.col("name") != ""), ["unit_id"])
