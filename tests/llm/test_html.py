import itertools
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from snaptree.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{color:red}</style><script>var x = "<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li>About us</li></ul></nav><div class="cookie-notice">We use cookies, of course.</div>
<div class="content"><h1>A title &amp; more</h1>
<p>First   paragraph, with <b>bold</b>
text, commas, and a full stop. It is long enough to count as the article.</p><p>Second paragraph &#233;tait l&agrave;; it goes on, and on, until it ends here.</p>
<div class="ad-box">Buy now, everything must go, this week only!</div><ul><li>item one, which is short</li><li>item two</li></ul></div>
<div id="comments"><p>Reader: I disagree, strongly, with all of the above. And so on, and so on.</p></div>
<aside>Related stories</aside><form>Search <input></form><footer>Copyright, all rights reserved.</footer></body></html>"""
WANT = "\n\n".join([
    "A title & more", "First paragraph, with bold text, commas, and a full stop. It is long enough to count as the article.",
    "Second paragraph était là; it goes on, and on, until it ends here.", "item one, which is short", "item two",
])


def test_main_text():
    assert html.main_text(PAGE) == WANT
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> </p><!-- x -->") == ""
    assert html.main_text("plain text, no markup") == "plain text, no markup"
    assert html.main_text("<p>open, and never closed <b>bold") == "open, and never closed bold"


def test_wrappers_with_hints_keep_the_article():
    plain = PAGE.replace("<body>", "<body>@").replace("</body>", "~</body>")
    for start in ('<div class="content-sidebar-wrap">', '<div class="site has-sidebar">', '<div id="post" class="entry related">', '<form id="aspnetForm">', '<div class="site has-sidebar"><div class="widget">'):
        end = "".join(f"</{x.split()[0]}>" for x in reversed(start[1:].split("<")))
        assert html.main_text(plain.replace("@", start).replace("~", end)) == WANT, start
    inner = "<p>Part one of the article, with commas, and long enough.</p>"
    assert html.main_text(f'<div class="has-sidebar"><main>{inner}</main></div>' + "<p>Terms, and more terms, apply here, as they do, everywhere, and always.</p>" * 3).startswith("Part one")
    many = "".join(f'<div class="e-widget"><p>Part {i} of the article, with commas, and long enough.</p></div>' for i in range(5))
    assert html.main_text(f"<body><nav>Home</nav>{many}</body>").count("Part") == 5


def test_broken_and_long_pages_end():
    assert "x" in html.main_text("<div>" * 3000 + "x")
    for bad in ("<" * 20000, "<a b='" * 3000, "<!--" * 5000, "&" * 20000, "<p " + "a=1 " * 20000):
        html.main_text(bad)
    many = "<article>" + "".join(f"<p>Sentence {i}, as long as the others.</p>" for i in range(3000)) + "</article>"
    assert html.main_text(many).count("\n\n") == 2999


def test_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract(df).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", WANT, len(WANT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)]
    assert html.extract(df.limit(0)).count() == 0


LONG = "A sentence of some length, with a comma, and then another one; it goes on. "
P = lambda k: "<p>" + LONG * k + f"Part {k}.</p>"
T = lambda k: LONG * k + f"Part {k}."

#: (page, its main text as blocks): layouts without and with an article, wrappers, lists, tables, menus without tags of their own.
VARIED = {
    "div only": ("<body><div>Login here</div><div class=x><div>" + T(3) + "</div><div>" + T(4) + "</div></div><div>Site map</div></body>", [T(3), T(4)]),
    "paragraphs among divs": (f"<body><div>Login here</div>{P(2)}{P(3)}<div>Site map</div></body>", [T(2), T(3)]),
    "wrapped": (f"<body><div><div>Login here</div><div>{P(2)}{P(3)}</div><div>Site map</div></div></body>", [T(2), T(3)]),
    "heading before": (f"<body><div>Login here</div><h1>Title</h1>{P(2)}<h2>Next</h2>{P(3)}<div>Site map</div></body>", ["Title", T(2), "Next", T(3)]),
    "short paragraph": (f"<body><div>Login here</div>{P(2)}<p>Yes.</p>{P(3)}</body>", [T(2), "Yes.", T(3)]),
    "list inside": (f"<body>{P(3)}<ul><li>one</li><li>two</li></ul>{P(2)}<div>Site map</div></body>", [T(3), "one", "two", T(2)]),
    "list at the end": (f"<body><div>{P(3)}<ol><li>one</li><li>two</li></ol></div><div>Site map</div></body>", [T(3), "one", "two"]),
    "menu as a list": (f"<body><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul>{P(3)}<ul><li><a href=/c>More</a></li></ul></body>", [T(3)]),
    "menu in an article": (f"<article><div><a href=/>Home</a> <a href=/b>About</a></div><h1>Title</h1>{P(3)}</article>", ["Title", T(3)]),
    "table layout": (f"<table><tr><td><a href=/>Home</a><br><a href=/b>About</a></td><td>{P(2)}{P(3)}</td></tr></table>", [T(2), T(3)]),
    "nested tables": (f"<table><tr><td><table><tr><td>{P(2)}</td></tr></table></td></tr><tr><td><table><tr><td>{P(4)}</td></tr></table></td></tr></table>", [T(2), T(4)]),
    "data table": (f"<body>{P(3)}<table><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12</td></tr></table>{P(2)}</body>", [T(3), "Year", "Sum", "1999", "12", T(2)]),
    "several articles": (f"<body><article>{P(2)}</article><article>{P(3)}</article><article>{P(2)}</article><div>Site map</div></body>", [T(2), T(3), T(2)]),
    "small article beside the text": (f"<body><article><p>Teaser</p></article><div>{P(3)}{P(4)}</div></body>", [T(3), T(4)]),
    "quote": (f"<body>{P(2)}<blockquote>Said he.</blockquote>{P(3)}</body>", [T(2), "Said he.", T(3)]),
    "comments": (f"<body><div>{P(2)}</div><div id=comments>{P(3)}{P(3)}</div></body>", [T(2)]),
    "comments by many": (f"<main>{P(2)}</main><section class='comment-list'><div class=comment>{P(1)}</div><div class=comment>{P(2)}</div></section>", [T(2)]),
    "advert larger than the article": ("<body><div class=ad>Buy this, and that, and more, now, today!</div><article><p>Short one.</p></article></body>", ["Short one."]),
    "sidebar in a wrapper": (f"<div class='content-sidebar-wrap'><div class=main-text>{P(3)}</div><div class=sidebar><p>Links, and so on.</p></div></div>", [T(3)]),
    "form around all": (f"<form id=aspnetForm><div>{P(3)}</div><form class=search>Search</form></form>", [T(3)]),
    "one block": ("<div>Only this.</div>", ["Only this."]),
    "pre": (f"<body>{P(2)}<pre>a  =  1\nb = 2</pre>{P(2)}</body>", [T(2), "a = 1 b = 2", T(2)]),
}


@pytest.mark.parametrize("name", VARIED)
def test_varied_pages(name):
    page, want = VARIED[name]
    assert html.main_text(page).split("\n\n") == want


def test_threshold_and_width_decide():
    """On a page without an article the threshold picks the paths, and smoothing lifts short blocks beside long ones."""
    page = f"<body><div><p>{T(6)}</p></div><section><div>{T(2)}</div></section><div><span>x</span></div><dl><div>Not much here, is there.</div></dl></body>"
    texts = {t: html.main_text(page, threshold=t).count("\n\n") + 1 for t in (0.0, 0.01, 0.1, 0.5)}
    assert texts[0.0] == 4 and texts[0.5] == 1 and texts[0.0] > texts[0.01] >= texts[0.1] >= texts[0.5]
    mixed = f"<body><div>{T(6)}</div><section>Small, but near.</section><div>{T(6)}</div><div>{T(6)}</div></body>"
    assert [("Small" in html.main_text(mixed, threshold=0.05, width=w)) for w in (0, 2)] == [False, True]


class Plain(HTMLParser):
    """Leaf texts with their paths, of pages whose elements are all closed and all blocks."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.found = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)

    def handle_endtag(self, tag):
        assert self.stack.pop() == tag

    def handle_data(self, data):
        if data.strip():
            self.found.append((" ".join(data.split()), tuple(self.stack)))


def edits(a, b):
    if not a or not b:
        return len(a) + len(b)
    return min(edits(a[1:], b) + 1, edits(a, b[1:]) + 1, edits(a[1:], b[1:]) + (a[0] != b[0]))


def plain_scores(found, width):
    """Each path's score, from its definition."""
    ratio = {}
    for path in {p for _, p in found}:
        own = [t for t, p in found if p == path]
        ratio[path] = sum(map(len, own)) / len(own), sum(sum(c in ".,;:!?" for c in t) for t in own) / len(own)
    fused = []
    for i, (_, p) in enumerate(found):
        near = [(4.0 ** -edits(p, found[j][1]) * 0.5 ** abs(i - j), ratio[found[j][1]]) for j in range(max(0, i - width), min(len(found), i + width + 1))]
        total = sum(w for w, _ in near)
        fused.append(sum(w * r[0] for w, r in near) / total * (1 + sum(w * r[1] for w, r in near) / total))
    return {p: sum(own := [f for f, (_, q) in zip(fused, found, strict=True) if q == p]) / len(own) for p in ratio}


@pytest.mark.parametrize("seed", range(20))
def test_path_scores_against_their_definition(seed):
    r, number = random.Random(seed), itertools.count()

    def element(depth):
        tag = r.choice(["div", "p", "section", "li", "h2", "td", "blockquote"])
        if tag == "p" or depth == 3 or r.random() < 0.4:
            return f"<{tag}>" + "Word, and more. " * r.randint(1, 12) + f"No {next(number)}</{tag}>"
        return f"<div><{tag}>" + "".join(element(depth + 1) for _ in range(r.randint(1, 4))) + f"</{tag}></div>" if tag in ("div", "section") else f"<div>{element(depth + 1)}</div>"

    page = "<body>" + "".join(element(0) for _ in range(r.randint(2, 8))) + "</body>"
    found, width = Plain(page).found, r.randint(0, 3)
    mine = html.blocks(page)
    assert [(t, tuple(p.split("/"))) for t, p, *_ in mine] == found
    want, got = plain_scores(found, width), html.path_scores(mine, width)
    assert {tuple(p.split("/")): pytest.approx(x) for p, x in got.items()} == want
    # every block of a path over the threshold is in the text, and no other div or section is
    top, text = max(want.values()), html.main_text(page, width=width).split("\n\n")
    sure = [t for t, p in found if want[p] >= html.THRESHOLD * top]
    assert set(sure) <= set(text) and all(p[-1] in html.ATTACHED for t, p in found if t in text and t not in sure)
