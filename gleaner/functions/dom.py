"""Elements of an HTML page as an array in preorder, and CSS selectors over it as column expressions.

`parsed` is the one Python step: it reads a page into its elements, each with its number, the number of its last
descendant and its parent's, and the page's pieces of text with the number of the element that holds them. Selectors then
are conditions on intervals: a descendant's number lies between its ancestor's and that one's last.

Tags are lower-cased; void elements hold nothing; an end tag without its element is dropped; elements left open end where
their parent does, and those of CLOSES where one of the named tags begins. Formatting elements are not opened again after
a misplaced end tag.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, collapse

#: Fixed values of HTML: elements without content, and which start tags end an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {
    "p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "head": frozenset(["body"]),
}
#: Elements beyond which a start tag closes nothing: a list in a list item doesn't end that item.
SCOPES = frozenset("ul ol dl table td th select html".split())

PAGE = (
    "struct<elements: array<struct<n: int, last: int, parent: int, tag: string, id: string, classes: array<string>, attributes: array<struct<name: string, value: string>>>>, "
    "texts: array<struct<n: int, text: string>>>"
)


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements, self.texts, self.open = [], [], []

    def end(self, depth: int) -> None:
        """End all open elements from this depth on."""
        for n in self.open[depth:]:
            self.elements[n]["last"] = len(self.elements) - 1
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        for depth in range(len(self.open) - 1, -1, -1):
            above = self.elements[self.open[depth]]["tag"]
            if tag in CLOSES.get(above, ()):
                self.end(depth)
            elif above in SCOPES:
                break
        own: dict[str, str] = {}
        for name, value in attrs:
            own.setdefault(name, value or "")
        n = len(self.elements)
        self.elements.append({
            "n": n, "last": n, "parent": self.open[-1] if self.open else -1, "tag": tag, "id": own.get("id"), "classes": own.get("class", "").split(),
            "attributes": [{"name": k, "value": v} for k, v in own.items()],
        })
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):  # HTML knows no empty elements but the void ones
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[depth]]["tag"] == tag:
                self.end(depth)
                return

    def handle_data(self, data):
        self.texts.append({"n": self.open[-1] if self.open else -1, "text": data})


def read(html: str | None) -> dict | None:
    if html is None:
        return None
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.end(0)
    return {"elements": reader.elements, "texts": reader.texts}


def parsed(html: Column) -> Column:
    """A page as struct(elements, texts); null for a null page."""
    return F.udf(read, PAGE, useArrow=True)(html)


# selectors

STEP = re.compile(r"\s*(?P<join>[>\s])?\s*(?P<compound>(?:[\w*-]+|\.[\w-]+|#[\w-]+|\[[^\]]+\])+)")
PART = re.compile(r"""(?P<tag>^[\w*-]+)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<bare>[^\s\]]+))\s*)?\]""", re.X)


def steps_of(selector: str) -> list[tuple[bool, str]]:
    """Steps of one selector: whether the step is to a child, and its compound."""
    out, at = [], 0
    selector = selector.strip()
    while at < len(selector):
        m = STEP.match(selector, at)
        if not m or "".join(p[0] for p in PART.finditer(m["compound"])) != m["compound"]:
            raise ValueError(f"not a selector of tags, classes, ids, attributes, children and descendants: {selector}")
        out.append((selector[at : m.start("compound")].strip() == ">", m["compound"]))
        at = m.end()
    if not out or out[0][0]:
        raise ValueError(f"no selector: {selector!r}")
    return out


def attribute(element: Column, name: str) -> Column:
    """The element's attribute, or null."""
    return F.get(F.filter(element["attributes"], lambda a: a["name"] == name), F.lit(0))["value"]


def holds(element: Column, compound: str) -> Column:
    """Whether an element is what a compound selector asks for."""
    out = F.lit(True)
    for m in PART.finditer(compound):
        if m["tag"]:
            ok = F.lit(True) if m["tag"] == "*" else element["tag"] == m["tag"].lower()
        elif m["cls"]:
            ok = F.array_contains(element["classes"], m["cls"])
        elif m["id"]:
            ok = F.coalesce(element["id"] == m["id"], F.lit(False))
        else:
            value, wanted = attribute(element, m["name"].lower()), next((x for x in (m["q"], m["s"], m["bare"]) if x is not None), "")
            test = {
                None: lambda v, w: v.isNotNull(), "=": lambda v, w: v == w, "^=": lambda v, w: v.startswith(w) & F.lit(w != ""), "$=": lambda v, w: v.endswith(w) & F.lit(w != ""),
                "*=": lambda v, w: v.contains(w) & F.lit(w != ""), "~=": lambda v, w: F.array_contains(F.split(v, r"\s+"), w) & F.lit(w != ""), "|=": lambda v, w: (v == w) | v.startswith(w + "-"),
            }[m["op"]]
            ok = F.coalesce(test(value, wanted), F.lit(False))
        out = out & ok
    return out


def matching(elements: Column, selector: str) -> Column:
    """The elements that a selector (or several with commas) finds, in document order."""

    def one(steps: list[tuple[bool, str]], found: Column | None = None) -> Column:
        (child, compound), rest = steps[0], steps[1:]
        if found is None:
            at = F.filter(elements, lambda e: holds(e, compound))
        elif child:
            at = F.filter(elements, lambda e: holds(e, compound) & F.exists(found, lambda a: a["n"] == e["parent"]))
        else:
            at = F.filter(elements, lambda e: holds(e, compound) & F.exists(found, lambda a: (a["n"] < e["n"]) & (e["n"] <= a["last"])))
        return bound(at, lambda f: one(rest, f)) if rest else at

    several = [one(steps_of(s)) for s in re.split(r",(?![^\[]*\])", selector)]
    return several[0] if len(several) == 1 else F.array_sort(F.array_distinct(F.concat(*several)))


def part_of(elements: Column, container: Column) -> Column:
    """The elements of a container, itself included; all for a null container."""
    return F.when(container.isNull(), elements).otherwise(F.filter(elements, lambda e: (e["n"] >= container["n"]) & (e["n"] <= container["last"])))


def text_of(texts: Column, element: Column, clean: bool = True) -> Column:
    """All text in an element, pieces apart by spaces; white space collapsed, or only cut off at both ends."""
    own = F.filter(texts, lambda t: (t["n"] >= element["n"]) & (t["n"] <= element["last"]))
    joined = F.array_join(F.transform(own, lambda t: t["text"]), " ")
    return collapse(joined) if clean else F.regexp_replace(joined, r"^\s+|\s+$", "")
