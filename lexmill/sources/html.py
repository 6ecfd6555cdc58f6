"""A small tree over the standard HTML parser, enough to read index tables and norm pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import regex

# Elements without an end tag, and those whose end may be left out before another of the same group.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "p": {"p"}, "option": {"option"}}


class Element:
    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def walk(self) -> Iterator[Element]:
        for child in self.children:
            if isinstance(child, Element):
                yield child
                yield from child.walk()

    def all(self, *tags: str) -> list[Element]:
        return [e for e in self.walk() if e.tag in tags]

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next((e for e in self.walk() if test(e)), None)

    def strings(self, without: frozenset[str] = frozenset()) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in without:
                yield from child.strings(without)

    def text(self, glue: str = "", without: frozenset[str] = frozenset()) -> str:
        """Trimmed strings, empty ones left out, joined by `glue`."""
        return glue.join(s for s in (x.strip() for x in self.strings(without)) if s)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and self.open[-1].tag in CLOSES.get(tag, ()):
            self.open.pop()
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(page: str) -> Element:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


_REFERENCE = regex.compile(r"(ref|abro)/([^/]+)\.htm$", regex.I)
_ABROGATED = regex.compile(r"\(Abroga[dr][ao][^)]*\)|Abrogad[ao]\s+[^(]+", regex.I)
INDEX_FIELDS = ("number", "file_id", "name", "dof_published", "dof_last_reform", "is_abrogated", "abrogation_note", "ref_href", "doc_href", "pdf_href")


def index_rows(page: str) -> list[dict]:
    """Rows of the largest table of an index page that link to a text, the first row of each file, by row number."""
    tables = parse(page).all("table")
    if not tables:
        return []
    rows, seen = [], set()
    for row in max(tables, key=lambda t: len(t.all("tr"))).all("tr"):
        cells = row.all("td")
        link = cells[1].first(lambda e: e.tag == "a" and bool(regex.match(r"(ref|abro)/[^/]+\.htm$", e.attributes.get("href", "").strip(), regex.I))) if len(cells) >= 2 else None
        if link is None:
            continue
        href = link.attributes["href"].strip()
        file_id = _REFERENCE.search(href)[2].upper()
        if file_id in seen:
            continue
        seen.add(file_id)
        hrefs = [a.attributes.get("href", "").strip() for a in cells[3].all("a")] if len(cells) >= 4 else []
        kind = lambda end, hrefs=hrefs: next((h for h in reversed(hrefs) if h.lower().endswith(end) and "pdf_mov" not in h.lower()), None)
        strong = cells[1].first(lambda e: e.tag in ("b", "strong"))
        text = cells[1].text(" ")
        published, note = regex.search(r"DOF\s+\d{2}/\d{2}/\d{4}", text), _ABROGATED.search(text)
        rows.append(
            dict(
                number=cells[0].text(), file_id=file_id, name=(strong or link).text(), dof_published=published[0] if published else "",
                dof_last_reform=cells[2].text(" ") if len(cells) >= 3 else "", is_abrogated=note is not None, abrogation_note=note[0].strip() if note else None,
                ref_href=href, doc_href=kind(".doc") or f"doc/{file_id}.doc", pdf_href=kind(".pdf") or f"pdf/{file_id}.pdf",
            )
        )
    return sorted(rows, key=lambda r: r["number"])


_HIDDEN = frozenset("nav header footer script style".split())


def norm_text(page: str, least: int = 100) -> str | None:
    """Text of a norm's page: its content block, without navigation and scripts; null if there is no block or too little text."""
    root = parse(page)
    block = (
        root.first(lambda e: e.tag == "div" and e.attributes.get("id") == "contenidoNorma")
        or root.first(lambda e: e.tag == "div" and bool(regex.search("content|norma|texto", e.attributes.get("class", ""), regex.I)))
        or root.first(lambda e: e.tag == "body")
    )
    text = block.text("\n", _HIDDEN) if block else ""
    return text if len(text) >= least else None


def norm_title(page: str) -> tuple[str, str]:
    """The first heading or bold text that begins with a norm's code (else empty), and the whole text of the page."""
    root = parse(page)
    titles = (e.text(" ") for e in root.walk() if e.tag in ("h1", "h2", "b", "strong"))
    return next((t for t in titles if regex.match(r"NOM-\d+", t, regex.I)), ""), " ".join(root.strings())
