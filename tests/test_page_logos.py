from __future__ import annotations

import json
import random
import re
from html.parser import HTMLParser
from urllib.parse import urlparse

import pytest

from pulsegrid import fixed
from pulsegrid.functions.markup import VOID
from pulsegrid.operators.page_logos import ORGANISATIONS, TEXT_ELEMENTS, page_logos

URL = "https://www.initech.example/about"


class Node:
    def __init__(self, name, attrs, parent):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def all(self, *names):
        return [n for n in self.walk() if n.name in names]

    def text(self):
        return "".join(c.text() if isinstance(c, Node) else c.strip() for c in self.children)


class Tree(HTMLParser):
    """A plain tree of a page: end tags close back to the last open element of their name."""

    def __init__(self, html):
        super().__init__()
        self.root = self.at = Node("", {}, None)
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        node = Node(tag, own, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        kept = self.at
        self.handle_starttag(tag, attrs)
        self.at = kept

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def foreign(url, alt=""):
    return any(p in url.lower() for p in fixed.FOREIGN_LOGO_URLS) or any(p in alt.lower() for p in fixed.FOREIGN_LOGO_CAPTIONS)


def declared(data):
    if isinstance(data, dict):
        kinds = data.get("@type", "")
        if any(k in ORGANISATIONS for k in (kinds if isinstance(kinds, list) else [kinds])):
            logo = data.get("logo")
            if isinstance(logo, str) and logo:
                return logo
            if isinstance(logo, dict) and (logo.get("url") or logo.get("contentUrl")):
                return logo.get("url") or logo.get("contentUrl")
        data = list(data.values())
    if isinstance(data, list):
        return next((x for x in map(declared, data) if x), None)
    return None


def expected(html, url):
    """The definition, on a tree."""
    root = Tree(html).root
    for s in root.all("script"):
        if s.attrs.get("type") == "application/ld+json":
            try:
                logo = declared(json.loads("".join(s.children)))
            except ValueError:
                continue
            if logo and not foreign(logo):
                return logo, "jsonld"
    site = lambda u: urlparse(u).netloc.lower().lstrip("w.")
    home = lambda h: h in ("/", "#") or (urlparse(h).netloc and site(h) == site(url) and urlparse(h).path.rstrip("/") == "")
    said = lambda i: " ".join([i.attrs.get("alt", ""), i.attrs.get("class", ""), i.attrs.get("id", "")]).lower()
    good = lambda i: i.attrs.get("src") and not foreign(i.attrs["src"], i.attrs.get("alt", ""))
    named = lambda i: "logo" in said(i) or "brand" in said(i)
    for kind in ("header", "nav"):
        for top in root.all(kind):
            for a in top.all("a"):
                images = a.all("img")
                if home(a.attrs.get("href", "")) and images and good(images[0]):
                    return images[0].attrs["src"], "header"
            for i in top.all("img"):
                if named(i) and good(i):
                    return i.attrs["src"], "header"
    for i in root.all("img"):
        if named(i) and good(i):
            node, bad = i.parent, False
            for _ in range(5):
                if node is None:
                    break
                words = (node.attrs.get("class", "") + " " + node.attrs.get("id", "")).lower()
                heads = "".join(" " + c.text() for c in node.children if isinstance(c, Node) and c.name in TEXT_ELEMENTS)
                bad |= any(g in words for g in fixed.LOGO_GRID_CLASSES) or any(re.search(p, heads, re.I) for p in fixed.FOREIGN_SECTION_HEADINGS)
                node = node.parent
            if not bad:
                return i.attrs["src"], "body"
    for word in ("apple-touch-icon", "icon"):
        for x in root.all("link"):
            if word in x.attrs.get("rel", "").lower() and x.attrs.get("href") and not foreign(x.attrs["href"]):
                return x.attrs["href"], "favicon"
    previews = [m for m in root.all("meta") if m.attrs.get("property") == "og:image"]
    if previews and previews[0].attrs.get("content") and not foreign(previews[0].attrs["content"]):
        return previews[0].attrs["content"], "og_image"
    return None


def ld(data):
    return f'<script type="application/ld+json">{json.dumps(data)}</script>'


WALL = "".join(f'<div><img class="logo" src="/w{k}.png"></div>' for k in range(6))
CASES = [
    ld({"@graph": [{"@type": "WebSite", "publisher": {"@type": ["Thing", "Organization"], "logo": {"url": "", "contentUrl": "/deep.png"}}}, {"@type": "Organization", "logo": "/late.png"}]}),
    ld({"a": {"@type": "Corporation", "logo": "/inner.png"}, "@type": "Organization", "logo": "/outer.png"}),
    '<script type="application/ld+json">{broken</script>' + ld([{"@type": "Person", "logo": "/no.png"}]) + '<header><img alt="Our Brand" src="/h.png"></header>',
    ld({"@type": "Organization", "logo": "https://x.com/yc-logo.png"}) + '<nav><a href="https://initech.example/"><span><img src="/n.png"><img src="/n2.png"></span></a></nav><header><a href="/about"><img src="/a.png"></a></header>',
    '<header><a href="/"><img src=""><img src="/second.png"></a><a href="#"><b><img src="/third.png" alt="App Store"></b></a><img id="site-logo" src="/fourth.png"></header>',
    f'<section><h2>Trusted by</h2>{WALL}</section><main><div><div><div><div><div><img class="logo" src="/own.png"></div></div></div></div></div></main>',
    f'<section><div class="row">{WALL}</div><h3>Our <b>partners</b></h3></section><link rel="shortcut ICON" href="/i.ico"><link rel="apple-touch-icon" href="/t.png">',
    f'<div id="Logo-Wall">{WALL}</div><meta property="og:image" content="/og.png"><meta property="og:image" content="/og2.png">',
    '<div>As seen in<img class="logo" src="/direct.png"></div>',
    '<div><span>Backed</span><span>by</span><img class="logo" src="/spans.png"></div>',
    '<div><p>Backed<b>by</b></p><img class="logo" src="/glued.png"></div>',
    '<section><h2>Used by</h2><ul><li><p><a><b><i><img class="logo" src="/far.png"></i></b></a></p></li></ul></section>',
    '<div><p>Featured&nbsp;in<p>unclosed<img class="brand" src="/u.png"></div></p><div><img class="brand" src="/v.png"></div>',
    '</div><section><!-- trusted by --><h2>Awards &amp; Recognition</h2></section><img src="/z.png" alt="logo">',
    "<p>No logo at all</p>", "", None, "<img class=logo src=/bare.png/>", '<IMG CLASS="Logo" SRC="/upper.png">', '<img class="logo"><img src="/x/yc.png" class="logo">',
]


def check(spark, pages):
    rows = spark.createDataFrame([(k, URL, h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: (r.source_url, r.extraction_location) for r in page_logos(rows).collect()}
    for k, h in enumerate(pages):
        assert got.get(k) == (expected(h, URL) if h else None), h


def test_each_place(spark):
    check(spark, CASES)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_pages(spark, seed):
    """Nested and badly nested pages against the tree."""
    rng = random.Random(seed)
    bits = ["<div>", "</div>", "<p>", "</p>", "<section>", "</section>", "<span>", "</span>", '<a href="/">', '<a href="/x">', "</a>", "<header>", "</header>", "<nav>", "</nav>",
            '<div class="logo-grid">', "<br>", "text", " our ", "partners", " used by ", "<h2>Our clients</h2>", "<b>", "</b>", "</ul>"]
    pages = []
    for _ in range(150):
        n = 0
        page = ""
        for _ in range(rng.randrange(30)):
            page += rng.choice(bits)
            if rng.random() < .25:
                page += rng.choice(['<img class="logo" src="/{}.png">', '<img src="/{}.png">', '<img alt="brand" src="/yc.png?{}">']).format(n)
                n += 1
        pages.append(page)
    check(spark, pages)


def test_other_names(spark):
    rows = spark.createDataFrame([("a", URL, CASES[0])], "key string, jsonld string, header string")
    assert [tuple(r) for r in page_logos(rows, "key", "jsonld", "header").collect()] == [("a", "/deep.png", "jsonld")]
