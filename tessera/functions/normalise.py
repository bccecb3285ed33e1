"""Column functions that bring captured values into canonical form. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field names that are dropped wherever they occur. Fixed values of the redaction policy.
DROP_FIELDS = (
    "(?:password|passwd|pwd)",
    "(?:(?:access|refresh|id|auth)[_-]?)?token",
    "(?:(?:client|api)[_-]?)?secret",
    "session(?:[_-]?(?:id|key|token))?",
    "csrf",
    "authorization",
    "cookie",
)
#: Extensions, path prefixes and resource types of static files. Fixed values.
STATIC_EXTENSIONS = (
    ".css", ".eot", ".gif", ".htm", ".html", ".ico", ".jpeg", ".jpg", ".js", ".map", ".mp3", ".mp4", ".png", ".svg", ".ttf", ".txt", ".webp",
    ".woff", ".woff2", ".xml",
)
STATIC_PREFIXES = ("/css/", "/img/", "/js/")
STATIC_TYPES = ("font", "script", "stylesheet")
#: Path rewrites of the endpoint census, first match wins. Fixed values.
ENDPOINT_RULES = (
    (r"^/user/check/message/r/.+$", "/user/check/message/r/{message_id}"),
    (r"^/user/splash/id/[^/]+/style/[^/]+$", "/user/splash/id/{splash_id}/style/{style_id}"),
    (r"^/user/splash/id/[^/]+$", "/user/splash/id/{splash_id}"),
    (r"^/wikihelp/topic/.+$", "/wikihelp/topic/{topic}"),
)
_METHOD = r"^[!#$%&'*+\-.^_`|~0-9A-Za-z]+$"


def url_path(url: Column) -> Column:
    """Path of a URL, "/" if it has none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def url_query(url: Column) -> Column:
    """The raw query string, without the question mark; "" if there is none."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_pairs(query: Column, *, drop: tuple[str, ...] = ()) -> Column:
    """Array of (key, value) of a query string in its order; blank values stay, repeated keys too."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        key = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        value = F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(F.coalesce(F.try_url_decode(key), key).alias("key"), F.coalesce(F.try_url_decode(value), value).alias("value"))

    pairs = F.transform(parts, pair)
    return F.filter(pairs, lambda p: ~p["key"].rlike("(?i)" + "|".join(drop))) if drop else pairs


def first_values(pairs: Column) -> Column:
    """The pairs whose key did not come before: the first value of each key."""
    return F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)


def method(value: Column) -> Column:
    """Upper-case HTTP method; null if it is not a token. White space is not trimmed."""
    return F.when(value.rlike(_METHOD), F.upper(value))


def is_origin_path(path: Column) -> Column:
    """Whether a path is origin-relative: starts with one slash, without query, fragment or control characters."""
    return path.rlike(r"^/(?!/)[^?#\x00-\x1f\x7f]*$")


def field_name(name: Column, drop: tuple[str, ...] = DROP_FIELDS) -> Column:
    """Structural name of a form or body field: digits become {numeric-key}, [7] becomes [n]; null if it is dropped."""
    value = F.trim(name)
    kept = F.when(value.rlike("^[0-9]+$"), F.lit("{numeric-key}")).otherwise(F.regexp_replace(value, r"\[[0-9]+\]", "[n]"))
    return F.when((value != "") & ~value.rlike("(?i)" + "|".join(drop)), kept)


def key_set(names: Column, drop: tuple[str, ...] = DROP_FIELDS) -> Column:
    """Sorted distinct structural names. A null array stays null: unknown is not empty."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: field_name(n, drop)), lambda n: n.isNotNull())))


def endpoint_pattern(path: Column, rules: tuple[tuple[str, str], ...] = ENDPOINT_RULES) -> Column:
    out = path
    for pattern, target in reversed(rules):
        out = F.when(path.rlike(pattern), F.lit(target)).otherwise(out)
    return out


def is_static(path: Column, resource_type: Column) -> Column:
    """Whether a request is for a static file: by its type, a prefix, or the extension of any segment."""
    extension = F.exists(
        F.split(path, "/"),
        lambda s: F.lower(F.regexp_extract(s, r"^.+?(\.[^.]*)$", 1)).isin(*STATIC_EXTENSIONS) & (F.instr(F.substring(s, 2, 1 << 30), ".") > 0),
    )
    prefixed = F.lit(False)
    for p in STATIC_PREFIXES:
        prefixed = prefixed | path.startswith(p)
    return F.coalesce(resource_type.isin(*STATIC_TYPES), F.lit(False)) | prefixed | extension


def route_path(path: Column) -> Column:
    """A route's path with the segment after id, r, style or topic as a placeholder."""
    segments = F.split(path, "/")
    last = F.size(segments) - 1

    def place(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(segments, F.greatest(i, F.lit(1))))
        splash = path.startswith("/user/splash/") & (i == last)
        named = F.when(before == "topic", F.lit("{topic}")).when((before == "id") & splash, F.lit("{splash_id}")).otherwise(F.lit("{id}"))
        return F.when((s != "") & before.isin("id", "r", "style", "topic"), named).otherwise(s)

    return F.array_join(F.transform(segments, place), "/")


def route_value(key: Column, value: Column, path: Column) -> Column:
    """A route's query value as a typed placeholder."""
    number = value.rlike("^[0-9]+$")
    of_id = F.when(path.startswith("/city/map/"), F.lit("{ID}")).when(number, F.lit("{id}")).otherwise(F.lit("{value}"))
    of_number = F.when(key == "product", F.lit("{product_id}")).when(key.isin("replace", "vendor"), F.lit("{vendor_id}")).otherwise(F.lit("{number}"))
    return F.when(key == "topic", F.lit("{value}")).when(key == "id", of_id).when(number, of_number).otherwise(value)


def route(path_and_query: Column) -> Column:
    """Normalised route: placeholders in the path, typed placeholders in the query."""
    path = F.substring_index(path_and_query, "?", 1)
    query = F.substring(path_and_query, F.length(path) + 2, F.length(path_and_query))
    values = F.transform(query_pairs(query), lambda p: F.concat(p["key"], F.lit("="), route_value(p["key"], p["value"], path)))
    joined = F.concat(route_path(path), F.lit("?"), F.array_join(values, "&"))
    return F.when(F.instr(path_and_query, "?") > 0, joined).otherwise(route_path(path))


def content_type(value: Column) -> Column:
    """Media type of a content-type header, without parameters."""
    return F.lower(F.trim(F.substring_index(value, ";", 1)))


def first_party(host: Column, *hosts: str) -> Column:
    """Whether a host is one of ``hosts`` or below it."""
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


#: Multipliers of money amounts by unit. Fixed values of the pages' wording.
MONEY_UNITS = {"тыс": 3, "млн": 6, "млрд": 9}


def money(text: Column, units: dict[str, int] = MONEY_UNITS) -> Column:
    """Whole amount of a text such as "819.94 млн p."; null unless it is a canonical, whole amount."""
    pattern = f"^([0-9]+(?: [0-9]+)*(?:\\.[0-9]+)?) ({'|'.join(units)}) p\\.$"
    found, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    number = F.when(found != "", F.replace(found, F.lit(" "), F.lit("")).try_cast("decimal(20,6)"))
    scale = F.lit(1).cast("long")
    for name, power in units.items():
        scale = F.when(unit == name, F.lit(10**power).cast("long")).otherwise(scale)
    amount = number * scale
    return F.when(amount == F.floor(amount), amount.cast("long"))


def percent(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?%$"), F.regexp_replace(text, "%$", "").try_cast("double"))


def canonical_id(text: Column) -> Column:
    """A positive identifier without leading zeros in 64 bits, else null."""
    return F.when(text.rlike("^[1-9][0-9]{0,18}$"), text.try_cast("long"))
