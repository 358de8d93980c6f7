"""HTML pages read by tokens: elements with their parents, matched by selectors, in Arrow batches.

Tokens go through a stack of open elements: void elements never open, some end others of their kind (li, p, td ...), an end tag closes all up to its own,
and one without a start is passed over. Comments, unquoted attributes and entities are read as browsers do. Selectors are groups (a, b) of compounds (tag, #id,
.class, [attribute], [attribute=value]) that are descendants (blank) or children (>) of each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Pages that are read at once.
SOME = 128
SILENT = frozenset(("script", "style", "noscript", "template"))
#: What a start tag ends, if it is open and nothing of the second set lies between.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS |= {tag: ({"p"}, {"div", "section", "article", "td", "li", "body"}) for tag in "p div ul ol table h1 h2 h3 h4 h5 h6 section article form".split()}
PAGE = StructType([
    StructField("text", StringType()), StructField("title", StringType()), StructField("headings", ArrayType(StringType())), StructField("metas", MapType(StringType(), StringType())),
    StructField("records", ArrayType(StringType())), StructField("links", ArrayType(StructType([StructField("href", StringType()), StructField("label", StringType())]))),
])
PART = re.compile(r"""\s*(?P<child>>)?\s*(?P<compound>(?:[\w*-]|\#[\w-]|\.[\w-]|\[[^\]]*\])+)""")
SIMPLE = re.compile(r"""(?P<mark>[#.]?)(?P<name>[\w*-]+)|\[\s*(?P<key>[\w:-]+)\s*(?:=\s*["']?(?P<value>[^"'\]]*)["']?\s*)?\]""")


class Tree(HTMLParser):
    """The elements of a page in order: tags, attributes, parents, and each piece of text with its element."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = ["#page"]
        self.attributes: list[dict[str, str]] = [{}]
        self.parents: list[int] = [-1]
        self.pieces: list[tuple[int, str]] = []
        self.open = [0]
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended, walls = ENDS.get(tag, ((), ()))
        for depth in range(len(self.open) - 1, 0, -1):
            own = self.tags[self.open[depth]]
            if own in walls:
                break
            if own in ended:
                del self.open[depth:]
                break
        self.tags.append(tag)
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.attributes.append(first)
        self.parents.append(self.open[-1])
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[depth]] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.open[-1], data))

    def above(self, element: int) -> Iterator[int]:
        """The element's ancestors, the nearest first."""
        while (element := self.parents[element]) > 0:
            yield element

    def texts(self, elements: list[int], silent: bool = False) -> list[str]:
        """The text of each of some elements, its pieces joined by blanks; that of scripts and the like only if asked for."""
        found: dict[int, list[str]] = {e: [] for e in elements}
        for at, piece in self.pieces:
            path = [at, *self.above(at)] if at else [0]
            if silent or not any(self.tags[e] in SILENT for e in path):
                for e in {0, *path} & found.keys():
                    found[e].append(piece)
        return [" ".join(found[e]) for e in elements]

    def fits(self, element: int, compound: list[tuple[str, str, str | None]]) -> bool:
        own = self.attributes[element]
        for mark, name, value in compound:
            match mark:
                case "#":
                    good = own.get("id") == name
                case ".":
                    good = name in own.get("class", "").split()
                case "[":
                    good = name in own and (value is None or own[name] == value)
                case _:
                    good = name in ("*", self.tags[element])
            if not good:
                return False
        return True

    def select(self, selector: str) -> list[int]:
        """The elements that the selector fits, in page order."""
        groups = [compounds(x) for x in selector.split(",")]
        return [e for e in range(1, len(self.tags)) if any(self.reaches(e, g, len(g) - 1) for g in groups if g)]

    def reaches(self, element: int, parts: list[tuple[bool, list]], at: int) -> bool:
        child, compound = parts[at]
        if not self.fits(element, compound):
            return False
        if at == 0:
            return True
        above = list(self.above(element))
        return any(self.reaches(e, parts, at - 1) for e in (above[:1] if child else above))


def compounds(selector: str) -> list[tuple[bool, list[tuple[str, str, str | None]]]]:
    """(whether a child of the one before, its simple parts) of each compound of a selector."""
    found, at = [], 0
    selector = selector.strip()
    while at < len(selector):
        m = PART.match(selector, at)
        if not m:
            raise ValueError(f"not a selector: {selector!r}")
        simple = [("[", s["key"], s["value"]) if s["key"] else (s["mark"], s["name"] if s["mark"] else s["name"].lower(), None) for s in SIMPLE.finditer(m["compound"])]
        found.append((bool(m["child"]), simple))
        at = m.end()
    return found


def page_of(html: str | None) -> dict | None:
    """What listings are made of: text, title, h1 texts, metadata by name, JSON-LD scripts, links."""
    if html is None:
        return None
    tree = Tree(html)
    tagged = lambda tag: [e for e, t in enumerate(tree.tags) if t == tag]
    metas: dict[str, str] = {}
    for e in tagged("meta"):
        own = tree.attributes[e]
        for key in ("property", "name"):
            if own.get(key) and "content" in own:
                metas.setdefault(own[key].lower(), own["content"])
    scripts = [e for e in tagged("script") if tree.attributes[e].get("type", "").strip().lower() == "application/ld+json"]
    anchors = [e for e in tagged("a") if "href" in tree.attributes[e]]
    titles, headings = tagged("title")[:1], tagged("h1")
    texts = tree.texts([0, *titles, *headings, *anchors])
    at = 1 + len(titles)
    labels = texts[at + len(headings) :]
    return {
        "text": texts[0], "title": texts[1] if titles else None, "headings": texts[at : at + len(headings)], "metas": list(metas.items()), "records": tree.texts(scripts, silent=True),
        "links": [{"href": tree.attributes[e]["href"], "label": label} for e, label in zip(anchors, labels, strict=True)],
    }


@F.arrow_udf(PAGE)
def page(html: pa.Array) -> pa.Array:
    """struct(text, title, headings, metas, records, links) of pages."""
    link = pa.struct([("href", pa.string()), ("label", pa.string())])
    kind = pa.struct([("text", pa.string()), ("title", pa.string()), ("headings", pa.list_(pa.string())), ("metas", pa.map_(pa.string(), pa.string())), ("records", pa.list_(pa.string())), ("links", pa.list_(link))])
    return in_parts(html, lambda texts: pa.array([page_of(x) for x in texts], kind), kind)


def in_parts(html: pa.Array, read: Callable[[list[str | None]], pa.Array], kind: pa.DataType) -> pa.Array:
    """What read gives for all pages, some at once, so that Python holds the texts and results of those alone."""
    return pa.concat_arrays([pa.array([], kind), *(read(html.slice(at, SOME).to_pylist()) for at in range(0, len(html), SOME))])


@F.arrow_udf(PAGE["links"].dataType)
def page_links(html: pa.Array) -> pa.Array:
    """The links of page() alone."""
    def read(texts: list[str | None]) -> pa.Array:
        return pa.array([None if x is None else links_of(Tree(x)) for x in texts], kind)

    kind = pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())]))
    return in_parts(html, read, kind)


def links_of(tree: Tree) -> list[dict]:
    anchors = [e for e, tag in enumerate(tree.tags) if tag == "a" and "href" in tree.attributes[e]]
    return [{"href": tree.attributes[e]["href"], "label": label} for e, label in zip(anchors, tree.texts(anchors), strict=True)]


def selected_texts(html: Column, selector: str) -> Column:
    """The texts of the elements that a selector fits, in page order."""
    list(map(compounds, selector.split(",")))

    @F.arrow_udf(ArrayType(StringType()))
    def texts(pages: pa.Array) -> pa.Array:
        trees = (None if x is None else Tree(x) for x in pages.to_pylist())
        return pa.array([None if t is None else t.texts(t.select(selector)) for t in trees], pa.list_(pa.string()))

    return texts(html)


def links_within(html: Column, selector: str) -> Column:
    """array(struct(href, label)) of the links in, or that are, elements that a selector fits, each once."""
    list(map(compounds, selector.split(",")))

    @F.arrow_udf(PAGE["links"].dataType)
    def links(pages: pa.Array) -> pa.Array:
        out = []
        for html_text in pages.to_pylist():
            tree = Tree(html_text)
            scope = set(tree.select(selector))
            own = [e for e, t in enumerate(tree.tags) if t == "a" and "href" in tree.attributes[e] and scope & {e, *tree.above(e)}]
            out.append(None if html_text is None else [{"href": tree.attributes[e]["href"], "label": label} for e, label in zip(own, tree.texts(own), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())])))

    return links(html)
