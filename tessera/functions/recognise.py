"""Predicates over captured entries and events: which of them a dataset or a projection takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths of the pages that carry goods and rosters. Fixed values.
GOODS_PATH, ROSTER_PATH, WIKI = "/units/", "/company/", "/wikihelp"
_POSITIVE = "^[1-9][0-9]{0,18}$"


def page_candidate() -> Column:
    """First-party HTML of status 200 with a body that is no help page."""
    return F.col("first_party") & (F.col("mime_type") == "text/html") & (F.col("status") == 200) & F.col("response_text_sha256").isNotNull() & ~F.col("path").startswith(WIKI)


def wiki_candidate() -> Column:
    return F.col("first_party") & (F.col("mime_type") == "text/html") & (F.col("status") == 200) & F.col("response_text_sha256").isNotNull() & F.col("path").startswith(WIKI)


def json_candidate() -> Column:
    return F.col("first_party") & (F.col("mime_type") == "application/json") & F.col("response_text_sha256").isNotNull()


def _one(query: Column, key: str) -> Column:
    """The only value of a key in a map of lists; null if there is none or more than one."""
    values = F.try_element_at(query, F.lit(key))
    return F.when(F.size(values) == 1, values[0])


def _body_event() -> Column:
    return (F.col("event_type") == "http.response_body") & (F.col("source") == "cdp.network") & (F.col("method") == "GET") & (F.col("status_code") == 200)


def goods_unit(path: str = GOODS_PATH) -> Column:
    """Unit of a goods event: its query has exactly id and tab=goods; null for other events."""
    q = F.col("query")
    fits = _body_event() & (F.col("url_path") == path) & (F.array_sort(F.map_keys(q)) == F.array(F.lit("id"), F.lit("tab"))) & (_one(q, "tab") == "goods")
    return F.when(fits & _one(q, "id").rlike(_POSITIVE), _one(q, "id"))


def roster_company(path: str = ROSTER_PATH) -> Column:
    """Company of a roster event: tab=units and one id, other keys allowed; null for other events."""
    q = F.col("query")
    fits = _body_event() & (F.col("url_path") == path) & (_one(q, "tab") == "units")
    return F.when(fits & _one(q, "id").rlike(_POSITIVE), _one(q, "id"))


def capture_plan(goods: str = GOODS_PATH, roster: str = ROSTER_PATH) -> Column:
    """Kind of body to keep of a finished request: unit-economics, company-roster, or null for none."""
    q, html = F.col("query"), F.lower(F.trim(F.substring_index("mime_type", ";", 1))) == "text/html"
    fits = (F.col("method") == "GET") & (F.col("status_code") == 200) & html & _one(q, "id").rlike(_POSITIVE)
    exact = F.array_sort(F.map_keys(q)) == F.array(F.lit("id"), F.lit("tab"))
    return F.when(fits & (F.col("url_path") == roster) & (_one(q, "tab") == "units"), F.lit("company-roster")).when(
        fits & (F.col("url_path") == goods) & exact & (_one(q, "tab") == "goods"), F.lit("unit-economics")
    )
