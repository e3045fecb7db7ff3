"""An element tree of landed HTML, for the extractors of tables, listings and posts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag ends open elements of these kinds, up to the nearest element that may hold both.
ENDS = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "thead": ("tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
HOLDERS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
SILENT = frozenset(("script", "style"))


class Element:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def all(self, wanted: Callable[[Element], bool] | str) -> Iterator[Element]:
        """Elements below this one in page order: those for which ``wanted`` holds, or of a class ('.name') or tag."""
        if isinstance(wanted, str):
            name = wanted.removeprefix(".")
            wanted = (lambda e: name in e.classes) if name != wanted else (lambda e: e.tag == name)
        waiting = list(reversed(self.children))
        while waiting:
            e = waiting.pop()
            if isinstance(e, Element):
                if wanted(e):
                    yield e
                waiting.extend(reversed(e.children))

    def path(self, *wanted: str) -> Element | None:
        """The first element that matches the last of ``wanted`` below one that matches the one before, and so on."""
        if not wanted:
            return self
        return next((found for e in self.all(wanted[0]) if (found := e.path(*wanted[1:]))), None)

    def strings(self, leave_out: Callable[[Element], bool] = lambda e: False) -> Iterator[str]:
        waiting: list[Element | str] = list(reversed(self.children))
        while waiting:
            e = waiting.pop()
            if isinstance(e, str):
                yield e
            elif e.tag not in SILENT and not leave_out(e):
                waiting.extend(reversed(e.children))

    def text(self) -> str:
        """The strings below, each stripped, end to end."""
        return "".join(s.strip() for s in self.strings())

    def words(self) -> str:
        """The text below with white space as single spaces."""
        return " ".join("".join(self.strings()).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended, e = ENDS.get(tag, ()), self.at
        while ended and e.parent is not None and e.tag not in ("table", *HOLDERS.get(tag, ("ul", "ol", "div", "td", "th") if tag == "p" else ())):
            if e.tag in ended:
                self.at = e.parent
            e = e.parent
        new = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        e: Element | None = self.at
        while e is not None and e.tag != tag:
            if e.tag == "table":  # a stray end tag within a cell closes nothing outside its table
                return
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(page: str | None) -> Element:
    """The tree of a page; a null page is empty. End tags that are missing are supplied where HTML lets them be left out."""
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def _span(cell: Element, name: str, most: int) -> int:
    value = cell.attributes.get(name, "1").strip()
    return max(1, min(int(value), most)) if value.isascii() and value.isdigit() else 1


def grid(table: Element) -> tuple[list[list[str | None]], int]:
    """The cells of a table's own rows as a rectangle, and the number of header rows that it starts with.

    A cell that spans several rows or columns is repeated in each; places that no cell covers are null. Rows in a thead are
    headers, else leading rows of th only. Tables inside a cell are tables of their own, their text also that of the cell.
    """
    rows = [e for e in table.all("tr") if _table_of(e) is table]
    taken: dict[tuple[int, int], str] = {}
    heads = 0
    for r, row in enumerate(rows):
        cells = [e for e in row.children if isinstance(e, Element) and e.tag in ("td", "th")]
        if r == heads and cells and (row.parent.tag == "thead" or all(e.tag == "th" for e in cells)):
            heads += 1
        c = 0
        for cell in cells:
            while (r, c) in taken:
                c += 1
            text = cell.words()
            for down in range(_span(cell, "rowspan", len(rows) - r)):
                for right in range(_span(cell, "colspan", 1000)):
                    taken.setdefault((r + down, c + right), text)
            c += _span(cell, "colspan", 1000)
    width = 1 + max((c for _, c in taken), default=-1)
    return [[taken.get((r, c)) for c in range(width)] for r in range(len(rows))], heads


def _table_of(e: Element) -> Element | None:
    while e.parent is not None:
        e = e.parent
        if e.tag == "table":
            return e
    return None
