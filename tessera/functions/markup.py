"""Open elements of an HTML page while its text passes by."""

from __future__ import annotations

from collections import defaultdict
from html.parser import HTMLParser

#: Elements that never have content. Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class OpenElements(HTMLParser):
    """A reader that knows which elements are open, and what each of them says about the text in it.

    ``opened`` gives the marks of an element that starts; text is handed to ``said`` with the marks of all
    open elements. An end tag closes the innermost element of its name and all that are open in it; one
    without such an element closes nothing.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self._names: list[str] = []
        self._marks: list[frozenset] = [frozenset()]
        self._depths: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each name

    def opened(self, tag: str, attrs: dict) -> frozenset:
        return frozenset()

    def closed(self, tag: str) -> None:
        pass

    def said(self, text: str, marks: frozenset) -> None:
        pass

    def handle_starttag(self, tag, attrs):
        marks = self.opened(tag, dict(attrs))
        if tag not in VOID:
            self._depths[tag].append(len(self._names))
            self._names.append(tag)
            self._marks.append(self._marks[-1] | marks)

    def handle_endtag(self, tag):
        if self._depths[tag]:
            depth = self._depths[tag][-1]
            for name in reversed(self._names[depth:]):
                self._depths[name].pop()
            del self._names[depth:], self._marks[depth + 1 :]
        self.closed(tag)

    def handle_data(self, data):
        self.said(data, self._marks[-1])

    def read(self, html: str | None):
        self.feed(html or "")
        self.close()
        return self
