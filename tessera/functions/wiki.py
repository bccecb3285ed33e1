"""Help pages: their topic, article text and related topics."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words before the list of related topics, and characters that are searched behind them. Fixed values.
MARKER, REACH = "Читайте также", 2000


def topic(href: Column) -> Column:
    """Topic of a link: the rest of the path after /wikihelp/topic/, else the query's first topic; null for other links."""
    path = F.regexp_replace(F.regexp_replace(href, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    of_path = F.regexp_extract(path, "^/wikihelp/topic/(.+)$", 1)
    raw = F.regexp_extract(href, r"\?(?:[^#]*&)?topic=([^&#]+)", 1)
    # A plus sign in a path is itself; in a query it is a space.
    decoded = F.try_url_decode(F.replace(of_path, F.lit("+"), F.lit("%2B")))
    named = F.when(path.startswith("/wikihelp/topic/"), decoded).otherwise(F.try_url_decode(raw))
    return F.when(path.startswith("/wikihelp") & (named != ""), named)


def related_topics(html: Column) -> Column:
    """Topics of the links in the block behind the marker, each once, in their order."""
    after = F.substring_index(html, '<font class="text">', -1)
    rest = F.substring(after, F.greatest(F.instr(after, "</font>"), F.lit(1)), F.length(after))
    at = F.instr(rest, MARKER)
    block = F.substring_index(F.substring(rest, at, F.lit(REACH)), "</table>", 1)
    hrefs = F.regexp_extract_all(block, F.lit('href="([^"]+)"[^>]*>'), F.lit(1))
    return F.when(at > 0, F.array_distinct(F.filter(F.transform(hrefs, topic), lambda t: t.isNotNull()))).otherwise(F.array().cast("array<string>"))


class _Article(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.parts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        if tag == "font":
            self.depth += bool(self.depth) or dict(attrs).get("class") == "text"
        elif self.depth and tag in ("br", "p", "div", "li", "tr"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        if tag == "font" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def article_text(html: pd.Series) -> pd.Series:
    """Text of the article element, one line a block."""

    def read(text):
        a = _Article()
        a.feed(text or "")
        a.close()
        return "\n".join(x for x in (" ".join(line.split()) for line in "".join(a.parts).split("\n")) if x)

    return html.map(read)
