"""Rows of the tables of HTML pages, so that what they mean can be said in DataFrame expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIP = {"script", "style", "template", "noscript", "svg", "iframe", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_TEXTS = T.ArrayType(T.StringType())
_CELL = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("colspan", T.IntegerType()), T.StructField("hrefs", _TEXTS), T.StructField("titles", _TEXTS)]
    + [T.StructField("values", T.MapType(T.StringType(), T.StringType()))]
)
ROWS = T.ArrayType(T.StructType([T.StructField("table", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("cells", T.ArrayType(_CELL))]))

_LISTED = pa.list_(pa.string())
_ARROW_CELL = pa.struct([("text", pa.string()), ("colspan", pa.int32()), ("hrefs", _LISTED), ("titles", _LISTED), ("values", pa.map_(pa.string(), pa.string()))])
_ARROW = {"table": pa.int32(), "row": pa.int32(), "heading": pa.string(), "cells": pa.list_(_ARROW_CELL)}
#: Characters of a page that are parsed, and cells that are handed on, at a time.
PIECE, CELLS = 1 << 18, 20_000

#: Shapes of rows that a task learns, and characters of a row that is learned. Rows of other shapes are parsed one by one.
SHAPES, LEARNED = 16, 1 << 14
#: A tag that any reader of HTML takes alike: names in small letters, values in double quotes without markup.
_TAG = re.compile(r'<(/?)([a-z][a-z0-9]*)((?:[ \t\n\r\f]+[a-z][a-z0-9-]*="[^"&<>]*")*)([ \t\n\r\f]*/?)>')
_ATTR = re.compile(r'([ \t\n\r\f]+)([a-z][a-z0-9-]*)="([^"]*)"')
#: Elements that rows of a shape may have: they hold text and tags, and no table.
_PLAIN = set("tr td th a abbr b big br button center code div em font form h1 h2 h3 h4 h5 h6 hr i img input label li nobr ol p s small span strong sub sup u ul".split())
#: Attributes that the reader looks at, by element; of these values, those that it asks whether they are empty.
_READ = {("a", "href"), ("input", "name"), ("input", "value"), ("div", "id"), ("span", "id")}
_GIVEN = _READ - {("input", "value")}
#: Stands for the first value of a row while its shape is learned, the next characters for the others. None is white space.
_SPOT = 0xF0000


class _Tables(HTMLParser):
    """Innermost open row takes what comes; values are inputs by name and marked elements by id."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.tables, self.skip = [], [], 0, []
        self.heading = self.marked = None
        self.unclear = []  # open elements, from the outermost one whose attributes are ambiguous

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        # Which of two attributes of one name holds is not known: such an element, and all in it, says nothing by attributes.
        twice = len({k for k, _ in attrs}) < len(attrs)
        attrs = {} if twice or self.unclear else dict(attrs)
        if (twice or self.unclear) and tag not in _VOID:
            self.unclear.append(tag)
        if tag in _SKIP:
            self.skip.append(tag)
        if self.skip:
            return
        if tag == "table":
            self.tables += 1
            self.open.append({"table": self.tables - 1, "row": -1, "current": None})
        if not self.open:
            return
        top = self.open[-1]
        if tag == "tr":
            top["row"] += 1
            top["current"] = {"table": top["table"], "row": top["row"], "heading": None, "cells": []}
            self.rows.append(top["current"])
        row = top["current"]
        if row is None:
            return
        if tag in ("td", "th"):
            span = attrs.get("colspan") or "1"
            row["cells"].append({"text": "", "colspan": int(span) if span.isdigit() else 1, "hrefs": [], "titles": [], "values": {}})
        if tag == "h3":
            self.heading = row
            row["heading"] = ""
        if not row["cells"]:
            return
        cell = row["cells"][-1]
        if tag == "a" and attrs.get("href"):
            cell["hrefs"].append(attrs["href"])
        if attrs.get("title") is not None:
            cell["titles"].append(" ".join(attrs["title"].split()))
        if tag == "input" and attrs.get("name"):
            cell["values"][attrs["name"]] = attrs.get("value") or ""
        elif attrs.get("id") and tag in ("div", "span"):
            self.marked = (cell, attrs["id"], tag, row)
            cell["values"][attrs["id"]] = ""

    def handle_endtag(self, tag):
        if tag in self.unclear:
            while self.unclear.pop() != tag:
                pass
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag == "h3":
            self.heading = None
        if self.marked and tag == self.marked[2]:
            self.marked = None
        if tag == "table" and self.open:
            self.open.pop()
        if tag == "tr" and self.open:
            self.open[-1]["current"] = None

    def handle_data(self, data):
        if self.skip or not self.open or self.open[-1]["current"] is None:
            return
        row = self.open[-1]["current"]
        if self.heading is row:
            row["heading"] += data
        if not row["cells"]:
            return
        if self.marked:
            cell, name, _, _ = self.marked
            cell["values"][name] += data
        else:
            row["cells"][-1]["text"] += data

    def updatepos(self, i: int, j: int) -> int:
        """Lines are not counted: nobody asks for them."""
        return j

    def between_rows(self) -> bool:
        """Whether a table is open and nothing in it, so that the next row depends on nothing before it but its number."""
        busy = self.skip or self.unclear or self.marked or self.heading is not None or self.rawdata or self.cdata_elem
        return not busy and bool(self.open) and self.open[-1]["current"] is None

    def take(self) -> list[dict]:
        """The rows that nothing can be added to any more, cleaned; each is handed out once."""
        waiting = {id(t["current"]) for t in self.open} | ({id(self.marked[3])} if self.marked else set())
        done, self.rows = [r for r in self.rows if id(r) not in waiting], [r for r in self.rows if id(r) in waiting]
        return [_clean(r) for r in done]


def _clean(row: dict) -> dict:
    row["heading"] = None if row["heading"] is None else " ".join(row["heading"].split())
    for c in row["cells"]:
        c["text"] = " ".join(c["text"].split())
        c["values"] = {k: " ".join(v.split()) for k, v in c["values"].items()}
    return row


@F.pandas_udf(ROWS)
def table_rows(html: pd.Series) -> pd.Series:
    """All rows of all tables of each page with their cells: text, links, titles, and named values."""

    def read(text):
        reader = _Tables()
        reader.feed(text or "")
        reader.close()
        return [_clean(r) for r in reader.rows]

    return pd.Series([read(h) for h in html])


@dataclass
class _Shape:
    """Rows whose tags are the same: what differs are values at known spots, which one expression finds.

    Where a value goes is learned from the reader itself, which is given the row with a mark at each spot.
    """

    match: object  # of the pattern, which takes a row and the text behind it
    texts: list[bool]  # of each spot, whether it is text (with references) and not the value of an attribute
    row: dict  # as the reader made it of the marks
    twins: list[list[int]]  # spots of names in one cell, which must differ

    @classmethod
    def of(cls, row: str) -> _Shape | None:
        """The shape of a row; none if its markup is not plain throughout."""
        pattern, marked, texts, at, before, names = [], [], [], 0, None, []

        def spot(is_text: bool, expression: str) -> None:
            pattern.append(f"({expression})")
            marked.append(chr(_SPOT + len(texts)))
            texts.append(is_text)

        def same(markup: str) -> None:
            pattern.append(re.escape(markup))
            marked.append(markup)

        while at < len(row):
            tag = _TAG.match(row, at)
            if not tag or tag[2] not in _PLAIN or (tag[1] and (tag[3] or tag[4])) or (tag[2] == "tr") != (at == 0 or tag.end() == len(row)):
                return None
            same(f"<{tag[1]}{tag[2]}")
            for space, name, value in _ATTR.findall(tag[3]):
                same(f'{space}{name}="')
                if name == "title" or (tag[2], name) in _READ and (value or (tag[2], name) not in _GIVEN):
                    spot(False, '[^"&<>]++' if name != "title" and (tag[2], name) in _GIVEN else '[^"&<>]*+')
                elif name == "colspan" or (tag[2], name) in _GIVEN:
                    same(value)
                else:
                    pattern.append('[^"&<>]*+')
                same('"')
            same(f"{tag[4]}>")
            names.append(tag[1] + tag[2])
            at, before = tag.end(), tag
            end = row.find("<", at)
            end = end if end >= 0 else len(row)
            if end > at or (end < len(row) and not before[1] and before[2] not in _VOID and before[2] != "tr" and row[end + 1 : end + 2] == "/"):
                spot(True, "[^<]*+")
            at = end
        if names[0] != "tr" or names[-1] != "/tr":
            return None
        reader = _Tables()
        reader.feed("<table>" + "".join(marked))
        if not reader.between_rows() or len(reader.rows) != 1:
            return None
        learned = _clean(reader.rows[0])
        twins = [[ord(k) - _SPOT for k in c["values"]] for c in learned["cells"] if len(c["values"]) > 1]
        return cls(re.compile("".join(pattern) + "[^<]*+").match, texts, learned, twins)

    def rows(self, text: str, at: int) -> tuple[list[tuple], int]:
        """The values of the rows of this shape from ``at`` on, CELLS cells at most, and where the next row begins."""
        found, most = [], CELLS // (len(self.row["cells"]) + 1) + 1
        while len(found) < most and (m := self.match(text, at)):
            values = m.groups()
            if any(len({values[k] for k in t}) < len(t) for t in self.twins):
                break
            found.append(values)
            at = m.end()
        return found, at

    def arrays(self, rows: list[tuple]) -> tuple[pa.Array, pa.Array]:
        """Headings and cells of rows of this shape, column by column."""
        n, width = len(rows), len(self.row["cells"])
        spots = [_each(unescape, c) if is_text else c for is_text, c in zip(self.texts, zip(*rows))] if self.texts else []

        def column(marks: str, clean: bool):
            parts = [spots[ord(m) - _SPOT] for m in marks]
            joined = parts[0] if len(parts) == 1 else ["".join(p) for p in zip(*parts)] if parts else [""] * n
            return _each(lambda v: " ".join(v.split()), joined) if clean else joined

        def flat(marks: list[str], clean: bool) -> pa.Array:
            every = [None] * (n * len(marks))
            for k, m in enumerate(marks):
                every[k :: len(marks)] = column(m, clean)
            return pa.array(every, pa.string())

        def offsets(counts: list[int]) -> pa.Array:
            return pa.array(np.concatenate([[0], np.cumsum(np.tile(np.array(counts, np.int32), n))]).astype(np.int32))

        cells = self.row["cells"]
        of = lambda name: [m for c in cells for m in c[name]]
        counts = lambda name: offsets([len(c[name]) for c in cells])
        parts = [
            flat([c["text"] for c in cells], True), pa.array([c["colspan"] for c in cells] * n, pa.int32()), pa.ListArray.from_arrays(counts("hrefs"), flat(of("hrefs"), False)),
            pa.ListArray.from_arrays(counts("titles"), flat(of("titles"), True)),
            pa.MapArray.from_arrays(counts("values"), flat(of("values"), False), flat([m for c in cells for m in c["values"].values()], True)),
        ]
        heading = self.row["heading"]
        shown = pa.nulls(n, pa.string()) if heading is None else pa.array(column(heading, True), pa.string())
        return shown, pa.ListArray.from_arrays(offsets([width]), pa.StructArray.from_arrays(parts, fields=list(_ARROW_CELL)))


def _each(f, column):
    """``f`` of each value, computed once for equal ones."""
    made = {v: f(v) for v in set(column)}
    return [made[v] for v in column]


@dataclass
class _Run:
    """Rows of one shape that follow each other, by their values."""

    shape: _Shape
    table: int
    first: int
    values: list[tuple]


@dataclass
class _Shapes:
    """The shapes that a task has met, the last one used first."""

    known: list[_Shape] = field(default_factory=list)

    def rows(self, text: str, at: int) -> tuple[_Shape | None, list[tuple], int]:
        for k, shape in enumerate(self.known):
            values, end = shape.rows(text, at)
            if values:
                self.known.insert(0, self.known.pop(k))
                return shape, values, end
        end = text.find("</tr>", at, at + LEARNED)
        if end < 0 or len(self.known) >= SHAPES or not (shape := _Shape.of(text[at : end + 5])):
            return None, [], at
        values, end = shape.rows(text, at)
        if values:
            self.known.insert(0, shape)
        return shape, values, end


def _in_pieces(text: str, shapes: _Shapes | None = None) -> Iterator[dict | _Run]:
    """The rows of a page as they end. It is cut before tags only, so no text is split.

    With ``shapes``, rows that begin between rows and are of a known shape come as runs and don't pass the reader.
    """
    reader, at = _Tables(), 0
    while at < len(text):
        if shapes and text.startswith("<tr", at) and reader.between_rows():
            shape, values, at = shapes.rows(text, at)
            if values:
                top = reader.open[-1]
                yield _Run(shape, top["table"], top["row"] + 1, values)
                top["row"] += len(values)
                continue
        end = text.find("<tr", at + 1, at + PIECE) if shapes and not reader.rawdata else -1
        end = end if end > 0 else text.find("<", at + PIECE)
        end = end if end > 0 else len(text)
        reader.feed(text[at:end])
        at = end
        yield from reader.take()
    reader.close()
    yield from map(_clean, reader.rows)


def page_rows(pages: DataFrame) -> DataFrame:
    """A row for each table row of ``pages`` (html and other columns): those columns with table, row, heading and cells.

    As ``table_rows``, in any order; but a task holds the text of a batch of pages and no more of what it parsed than a
    piece of one page and the cells of one batch of rows, however large and many the pages are. Rows with the same
    tags are parsed once; of the others of that shape only the values are taken.
    """
    keep = [c for c in pages.columns if c != "html"]
    schema = T.StructType([pages.schema[c] for c in keep] + ROWS.elementType.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch in batches:
            rows, runs, cells = [], [], 0
            given, html = [batch.column(c) for c in keep], batch.column("html")
            for k in range(batch.num_rows):
                for r in _in_pieces(html[k].as_py() or "", shapes):
                    if isinstance(r, _Run):
                        runs.append((k, r))
                        cells += len(r.values) * (len(r.shape.row["cells"]) + 1)
                    else:
                        rows.append((k, r))
                        cells += len(r["cells"]) + 1
                    if cells >= CELLS:
                        yield from _batches(keep, given, rows, runs)
                        rows, runs, cells = [], [], 0
            yield from _batches(keep, given, rows, runs)

    return pages.select(*keep, "html").mapInArrow(read, schema)


def _batches(keep: list[str], given: list[pa.Array], rows: list[tuple[int, dict]], runs: list[tuple[int, _Run]]) -> Iterator[pa.RecordBatch]:
    """A batch of the rows that were parsed, and one of the runs of each shape; the numbers are those of the pages."""

    def batch(of, *columns: pa.Array) -> pa.RecordBatch:
        at = pa.array(of, pa.int64())
        return pa.RecordBatch.from_arrays([*[g.take(at) for g in given], *columns], names=[*keep, *_ARROW])

    if rows:
        for _, r in rows:
            for c in r["cells"]:
                c["values"] = list(c["values"].items())
        yield batch([k for k, _ in rows], *[pa.array([r[c] for _, r in rows], t) for c, t in _ARROW.items()])
    by_shape: dict[int, list[tuple[int, _Run]]] = {}
    for k, run in runs:
        by_shape.setdefault(id(run.shape), []).append((k, run))
    for same in by_shape.values():
        sizes = [len(run.values) for _, run in same]
        table = np.repeat([run.table for _, run in same], sizes)
        row = np.concatenate([np.arange(run.first, run.first + len(run.values)) for _, run in same])
        heading, cells = same[0][1].shape.arrays([v for _, run in same for v in run.values])
        yield batch(np.repeat([k for k, _ in same], sizes), pa.array(table, pa.int32()), pa.array(row, pa.int32()), heading, cells)
