"""CSS selectors and containers against a walk over nested elements."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from gleaner.functions import dom
from gleaner.operators import selectors
from gleaner.operators.selectors import Field

PAGES = [
    "<html><body><div class='a b' id=top><p>one<p>two <b>bold</p><span data-x='q r'>s</span></div><DIV CLASS=a><div class=b><p class='b a'>deep</p></div></div></body></html>",
    "<ul><li>1<li>2<ul><li class=item>2a<li>2b</ul><li>3</ul><br><img src=x.png alt='an image'/>tail",
    "<table><tr><td>a<td>b<tr><th>c</table><p>after<div>block</div>loose</p>",
    "<script>if (a < b) { '<p class=a>' }</script><!-- <p class=a> --><p class=a>&lt;x&gt; &amp; y</p><a href='/u?x=1&y=2' rel='nofollow me'>l</a><a href=\"http://h/b\">m</a>",
    "</p></div>unopened<p lang=en-US><em><i>open",
    "<p",
    "",
    "no elements at all",
    None,
    "<dl><dt>t<dd>d<dt>u<dd>e</dl><select><option selected>o<option value=2>p</select><p class='A'>case</p><x-y class='a'>custom</x-y>",
    "<div class=card><h2> Title \n one </h2><a class=buy href=/1>go</a></div><div class=card><h2></h2></div><div class='product-item'><h2>later</h2></div>",
]
SELECTORS = [
    "p", "*", ".a", ".a.b", "#top", "div", "div p", "div > p", "div.a > div.b p", "ul > li", "ul li ul li", "li li", "[data-x]", "[data-x~=r]", "[data-x='q r']", "a[href^='/u']", "a[href$=b]", "a[href*='x=1']", "[lang|=en]",
    "p, li", ".b, .a", "table td, th", "p.a", "P", "body  >  div>p", "x-y", "div a.buy", "option[selected]", "img[alt]", "[href^='']",
]


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, {}, parent, []
        for k, v in attrs:
            self.attrs.setdefault(k, v or "")

    def text(self):
        return " ".join(c if isinstance(c, str) else c.text() for c in self.children if isinstance(c, str) or c.children)

    def walk(self):
        for c in self.children:
            if not isinstance(c, str):
                yield c
                yield from c.walk()


class Nested(HTMLParser):
    """Elements nested in each other; ends left out are put in by the few rules the pages above need."""

    def __init__(self):
        super().__init__()
        self.root = self.now = Node("#", [], None)

    def handle_starttag(self, tag, attrs):
        ends = {"p": ["p"], "div": ["p"], "ul": ["p"], "table": ["p"], "dl": ["p"], "h2": ["p"], "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "td": ["td", "th"], "th": ["td", "th"], "tr": ["td", "th", "tr"], "option": ["option"]}
        while True:
            at = self.now
            while at.parent and at.tag not in ends.get(tag, []) and at.tag not in ("ul", "ol", "dl", "table", "td", "th", "select", "html"):
                at = at.parent
            if not at.parent or at.tag not in ends.get(tag, []):
                break
            self.now = at.parent
        node = Node(tag, attrs, self.now)
        self.now.children.append(node)
        if tag not in ("br", "img"):
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = self.now
        while at.parent and at.tag != tag:
            at = at.parent
        if at.parent:
            self.now = at.parent

    def handle_data(self, data):
        self.now.children.append(data)


def tree(html):
    parser = Nested()
    parser.feed(html)
    parser.close()
    return parser.root


def is_a(node, compound):
    def has(name, op, value):
        v = node.attrs.get(name)
        if v is None or op and not value and op != "=":
            return False
        return {"": True, "=": v == value, "^=": v.startswith(value), "$=": v.endswith(value), "*=": value in v, "~=": value in v.split(), "|=": v == value or v.startswith(value + "-")}[op]

    rest, first = compound, True
    while rest:
        cut = min([rest.find(c, 1) for c in ".#[" if rest.find(c, 1) > 0] or [len(rest)]) if rest[0] != "[" else rest.index("]") + 1
        part, rest = rest[:cut], rest[cut:]
        if part[0] == ".":
            ok = part[1:] in node.attrs.get("class", "").split()
        elif part[0] == "#":
            ok = node.attrs.get("id") == part[1:]
        elif part[0] == "[":
            name = part[1:-1]
            op = next((o for o in ("^=", "$=", "*=", "~=", "|=", "=") if o in name), "")
            name, value = name.split(op, 1) if op else (name, "")
            ok = has(name, op, value.strip("'\""))
        else:
            ok = first and part in ("*", node.tag) or part.lower() == node.tag
        if not ok:
            return False
        first = False
    return True


def by_hand(root, selector):
    out = []
    for node in root.walk():
        for one in selector.split(","):
            words = re.findall(r"(?:\[[^\]]*\]|[^\s>])+|>", one)

            def up(at, words):
                if not words:
                    return True
                if words[-1] == ">":
                    return at.parent is not None and at.parent.tag != "#" and is_a(at.parent, words[-2]) and up(at.parent, words[:-2])
                above = at.parent
                while above is not None and above.tag != "#":
                    if is_a(above, words[-1]) and up(above, words[:-1]):
                        return True
                    above = above.parent
                return False

            if is_a(node, words[-1]) and up(node, words[:-1]):
                out.append(node)
                break
    return out


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(4)
    tags = ["div", "p", "ul", "li", "b", "/div", "/p", "/ul", "/li", "/b", "div class=a", "p class='b a'", "li id=top", "br"]
    made = ["".join(f"<{r.choice(tags)}>{r.choice(['', 'x', ' y '])}" for _ in range(r.randint(1, 25))) for _ in range(150)]
    return list(enumerate(PAGES + made))


def test_selectors(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("page", dom.parsed(F.col("html")))
    e = F.col("page")["elements"]
    for k in range(0, len(SELECTORS), 10):
        some = SELECTORS[k : k + 10]
        got = {r["page_id"]: r for r in df.select("page_id", *[F.transform(dom.matching(e, s), lambda x: F.struct(x["tag"], dom.text_of(F.col("page")["texts"], x))).alias(f"s{n}") for n, s in enumerate(some)]).collect()}
        for page_id, html in pages:
            for n, s in enumerate(some):
                found = got[page_id][f"s{n}"]
                if html is None:
                    assert found is None
                    continue
                want = [(x.tag, " ".join(x.text().split())) for x in by_hand(tree(html), s)] if s != "[href^='']" else []
                assert [tuple(x) for x in found] == want, (html, s)


def test_items_and_fields(spark):
    df = spark.createDataFrame([(k, h, 1) for k, h in enumerate(PAGES)], "page_id long, html string, item_no int")
    fields = {"name": Field("h2", transform="upper"), "href": Field("a.buy", attribute="href", fallback=Field("a", attribute="href", transform="lower"), default="-"), "all": Field("h2, p", multiple=True), "n": Field("td", transform="int"), "raw": Field("h2", clean=False)}
    got = {}
    for r in selectors.items(df, fields).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert PAGES.index(None) not in got and len(got) == len(PAGES) - 1
    cards = sorted(got[10], key=lambda r: r["item"])
    assert [(r["selector"], r["item"], r["name"], r["href"], r["all"]) for r in cards] == [(".card", 0, "TITLE ONE", "/1", ["Title one"]), (".card", 1, "", "-", [""])]
    assert cards[0]["raw"] == "Title \n one" and cards[0]["item_no"] == 1
    (page,) = got[3]
    assert page["selector"] is None and page["href"] == "/u?x=1&y=2" and page["all"] == ["<x> & y"] and page["name"] is None
    assert [r["selector"] for r in got[1]] == [".item"] and got[1][0]["name"] is None
    assert got[2][0]["n"] is None  # no number
    assert selectors.items(df.limit(0), fields).count() == 0


@pytest.mark.parametrize("bad", ["", "> p", "p:hover", "p >", "a[b", "."])
def test_what_is_no_selector(bad):
    with pytest.raises(ValueError):
        dom.steps_of(bad)
