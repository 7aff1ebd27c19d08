"""Pages of many layouts, each with the text that its writer marked; the marks are read by a parser of the test's own."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pytest

from shutterlake.llm import html_extract, queries

SF = "/root/testdata/sf0.1"


class Marked(HTMLParser):
    """Blocks of the elements that carry data-keep, which nothing else reads."""

    VOID = frozenset("br img input hr meta link".split())
    INLINE = frozenset("a b em i span strong label br".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks = [], [[]]

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.blocks.append([])
        if tag not in self.VOID:
            self.stack.append((tag, any(k == "data-keep" for k, _ in attrs)))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.blocks.append([])
        if self.stack and self.stack[-1][0] == tag:
            self.stack.pop()

    def handle_data(self, data):
        if any(k for _, k in self.stack):
            self.blocks[-1].append(data)


def kept(source):
    m = Marked()
    m.feed(source)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in m.blocks) if t)


def prose(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n)) + "."


def body(rng):
    return f"<h1 data-keep>{prose(rng, 6)}</h1>" + "".join(f"<p data-keep>{prose(rng, int(n))} <b>&amp; more</b></p>" for n in rng.integers(20, 60, 5))


def links(rng, n):
    return "<ul>" + "".join(f"<li><a href='/{x}'>{prose(rng, 2)}</a></li>" for x in range(n)) + "</ul>"


LAYOUTS = {
    "form around the page": lambda r: f"<form id='aspnetForm' method='post'><input type='hidden' value='x'><div>{links(r, 5)}</div><article>{body(r)}</article><button>Go</button></form>",
    "form without an article": lambda r: f"<form action='/'><div class='text'>{body(r)}</div></form><nav>{links(r, 4)}</nav>",
    "layout that has a sidebar": lambda r: f"<div class='layout has-sidebar'><div class='post'>{body(r)}</div><div class='sidebar'>{links(r, 6)}</div></div>",
    "layout without a menu": lambda r: f"<div class='page no-menu with-footer'>{body(r)}</div><footer>{prose(r, 8)}</footer>",
    "sidebar layout wrapper": lambda r: f"<div class='sidebar layout'><div>{body(r)}</div></div>",
    "article on social life": lambda r: f"<article><section id='social'>{body(r)}</section><section id='search'><p data-keep class='search'>{prose(r, 30)}</p><h2 data-keep class='menu'>{prose(r, 4)}</h2></section></article>",
    "article with its own parts": lambda r: f"<header>{prose(r, 5)}</header><article>{body(r)}<div class='share'>{prose(r, 4)}</div><div class='related'>{links(r, 4)}</div><form class='newsletter'><label>{prose(r, 3)}</label></form></article>",
    "article with comments": lambda r: f"<main>{body(r)}</main><section class='comments'><article><p>{prose(r, 40)}</p></article></section>",
    "more comments than article": lambda r: f"<div class='post'><h1 data-keep>{prose(r, 5)}</h1><p data-keep>{prose(r, 30)}</p></div><div id='comments'>{''.join(f'<p>{prose(r, 30)}</p>' for _ in range(9))}</div>",
    "plain divisions": lambda r: f"<div class='ad'>{prose(r, 10)}</div><div id='cookie-notice'>{prose(r, 9)}</div><div class='content'>{body(r)}</div><div class='site-footer'>{prose(r, 12)}</div>",
    "title apart from the text": lambda r: f"<div class='x7'><h1 data-keep>{prose(r, 8)}</h1></div><div class='x8'>{''.join(f'<p data-keep>{prose(r, 30)}</p>' for _ in range(4))}</div>",
    "table of the nineties": lambda r: f"<table><tr><td><nav>{links(r, 5)}</nav></td><td>{body(r)}</td></tr></table>",
    "menu, article, aside": lambda r: f"<div role='navigation'>{links(r, 8)}</div><article>{body(r)}</article><aside>{prose(r, 15)}</aside>",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layout_without_any_template(layout):
    """On a host of one page the lists alone decide."""
    rng = np.random.default_rng(len(layout))
    for _ in range(20):
        source = f"<html><head><title>t</title><style>p{{}}</style></head><body>{LAYOUTS[layout](rng)}</body></html>"
        assert html_extract.text_of(html_extract.parse(source), {}) == kept(source)


def test_layouts_over_hosts(spark):
    """Each layout on a host of its own, with texts that never recur: places and lists together."""
    rng = np.random.default_rng(1)
    rows = []
    for h, layout in enumerate(sorted(LAYOUTS)):
        for i in range(12):
            rows.append((100 * h + i, f"http://h{h}.example.com/{i}", f"<html><body>{LAYOUTS[layout](rng)}</body></html>"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [sorted(LAYOUTS)[i // 100] for i, _, s in rows if got[i] != kept(s)]
    assert wrong == []


def test_places_find_parts_that_no_list_names(spark):
    """Divisions without a telling name, whose texts differ from page to page, go by the place they fill; on a host of three pages they stay."""
    rng = np.random.default_rng(2)
    page = lambda keep: f"<body><div class='x1'>{prose(rng, 9)}</div><div class='x2'>{keep}</div><div class='x3'>{prose(rng, 12)}</div></body>"
    bodies = [body(rng) for _ in range(23)]
    rows = [(i, "http://many.example.com/" if i < 20 else "http://few.example.com/", page(b)) for i, b in enumerate(bodies)]
    for most in (html_extract.BROADCAST_HASHES, 0):
        got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_hashes=most).collect()}
        for i, b in enumerate(bodies):
            assert (got[i] == kept(b)) == (i < 20) and kept(b) in got[i]


def test_most_removed_text_is_counted(spark):
    """Ablation on the given pages: what templates alone remove, of all that goes besides scripts and heads."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    scratch = []
    keep = html_extract.Scratch.write

    def write(self, df, name):
        out = keep(self, df, name)
        scratch.append((name, out))
        return out

    try:
        html_extract.Scratch.write = write
        full = {r.page_id: r.text for r in queries.op3_html_extract(spark, SF).collect()}
    finally:
        html_extract.Scratch.write = keep
    marks = {}
    for r in dict(scratch)["templates"].collect():
        marks.setdefault(r.host, {})[r.hash] = r.mark
    whole = counted = removed = same = 0
    for r in rows:
        page = html_extract.parse(r.html or "")
        everything = len(html_extract.text_of(page, {}, lists=False))
        alone = html_extract.text_of(page, marks.get(r.url.split("/")[2], {}), lists=False)
        whole += everything - len(full[r.page_id])
        removed += everything - len(alone)
        same += alone == full[r.page_id]
    print(f"characters removed: {whole}, by templates alone {removed}; pages that templates alone bring to the same text: {same} of {len(rows)}")
    assert removed > 0.5 * whole
