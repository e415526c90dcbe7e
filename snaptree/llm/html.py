"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with the path of block tags above it.  Text length and
punctuation are summed for each root-to-leaf path and divided by its number of blocks.  Along the page both
ratios are smoothed, where a neighbour counts the less the more its path differs, and fused; the mean over a
path's blocks is the path's score, and paths over a threshold are content.  Their blocks are the text, with
the headings, list items, cells and quotes among them.  If most of it lies in one article or main element, that
element is the text.  Tags that are never content are left out beforehand; names of classes and forms are
evidence only: what they mark is left out unless it holds most of the content.
"""
from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements of HTML by their role (fixed values).
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head nav header footer aside button select menu dialog search svg math canvas object audio video map".split())
#: Start tags that end an open element of the same kind (fixed values).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPE = frozenset("ul ol dl table html body article section main div".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names that mark what is not the article (fixed values).
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent notice notices popup modal overlay "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer colophon copyright comment comments commentlist respond reply replies discussion disqus "
    "social share sharing related recommended recommendations newsletter subscribe subscription signup login search toolbar pagination pager widget widgets skip".split()
)
#: Those of readers' replies, which are often longer than the article, and of adverts and notices, which wrap no article (fixed values).
STRONG = frozenset(
    "comment comments commentlist respond reply replies discussion disqus ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent popup newsletter subscribe subscription breadcrumb breadcrumbs pagination copyright".split()
)
SAFE = frozenset("html body main article".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[^a-z]+")
_PUNCTUATION = re.compile(r"""[.,;:!?…،。、！？]""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Share of the largest path score from which a path is content; width of the smoothing, in blocks on each side.
THRESHOLD, WIDTH = 0.25, 2
#: A neighbour's weight is divided by this for each step of the paths' edit distance.
DECAY = 4.0
#: Leaves that belong to the blocks of content around them, though they are short (fixed values).
ATTACHED = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th blockquote pre figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _marks(tag: str, attrs: str) -> tuple[bool, frozenset]:
    """(whether an element is never content, the hints that it may not be: words of its class and id, or that it is a form)."""
    if tag in NEVER:
        return True, frozenset()
    hints = {"form"} if tag == "form" else set()
    if not attrs or tag in SAFE:
        return False, frozenset(hints)
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, frozenset()
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, frozenset()
        if name == "role" and value.lower() in ROLES:
            return True, frozenset()
        if name in ("class", "id"):
            hints |= HINTS.intersection(_NAME.split(_CAMEL.sub(" ", value).lower()))
    return False, frozenset(hints)


def blocks(html: str):
    """(text, path, chain, hinted, linked) of each text block that may be content.

    chain: numbers of the elements above it; hinted: place in chain and hints of those that have any; linked: most
    of the text is that of links.
    """
    stack: list[tuple[str, int, bool, frozenset]] = []  # elements that are open: tag, number, excluded, hints
    out, parts, n, at = [], [], 0, 0
    link, linked = False, 0

    def flush():
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join(unescape(raw).split())
            if text and not (stack and stack[-1][2]):
                out.append((text, "/".join(s[0] for s in stack), tuple(s[1] for s in stack), tuple((k, s[3]) for k, s in enumerate(stack) if s[3]), 2 * linked > len(raw)))
            parts.clear()
        linked = 0

    size = len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
            linked += (m.start() - at) * link
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "a":
            link = not closing
        if closing:
            if tag in BLOCK or any(s[0] == tag for s in stack):
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            parts.append(" ")
            continue
        off, hints = _marks(tag, attrs)
        if tag in BLOCK or (off or hints) and tag not in VOID:
            flush()
            if tag in BLOCK and any(s[0] == "p" for s in stack[-1:]):
                stack.pop()  # a block ends an open paragraph
            ends = CLOSES.get(tag)
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE:
                        break
            if tag not in VOID and not attrs.endswith("/"):
                n += 1
                stack.append((tag, n, off or bool(stack and stack[-1][2]), hints))
    flush()
    return out


def _distance(a: tuple, b: tuple) -> int:
    """Edit distance of two paths."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _fused(found: list, width: int) -> list[float]:
    """The fused ratio of each block: smoothed length of its path times one and the smoothed punctuation."""
    sums: dict[str, list[float]] = {}
    for text, path, *_ in found:
        s = sums.setdefault(path, [0.0, 0.0, 0.0])
        s[0] += len(text)
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += 1
    weights: dict[tuple, float] = {}

    def weight(p: str, q: str) -> float:
        if p == q:
            return 1.0
        if (p, q) not in weights:
            a, b = p.split("/"), q.split("/")
            k = 0  # what both start with does not count
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            z = 0  # nor what both end in
            while z < min(len(a), len(b)) - k and a[-1 - z] == b[-1 - z]:
                z += 1
            # very different paths, which a deep page may have many of, count for nothing
            far = max(len(a), len(b)) - k - z > 16
            weights[p, q] = weights[q, p] = 0.0 if far else DECAY ** -_distance(tuple(a[k : len(a) - z]), tuple(b[k : len(b) - z]))
        return weights[p, q]

    out = []
    for i, (_, path, *_) in enumerate(found):
        total = length = points = 0.0
        for j in range(max(0, i - width), min(len(found), i + width + 1)):
            s = sums[found[j][1]]
            w = weight(path, found[j][1]) * 0.5 ** abs(i - j)
            total += w
            length += w * s[0] / s[2]
            points += w * s[1] / s[2]
        out.append(length / total * (1 + points / total))
    return out


def path_scores(found: list, width: int) -> dict[str, float]:
    """Mean fused ratio of the blocks of each path."""
    sums: dict[str, list[float]] = {}
    for (_, path, *_), f in zip(found, _fused(found, width), strict=True):
        s = sums.setdefault(path, [0.0, 0.0])
        s[0] += f
        s[1] += 1
    return {p: a / n for p, (a, n) in sums.items()}


def _unhinted(found: list, threshold: float, width: int) -> list:
    """The blocks outside hinted elements; hints count for nothing where most content, or the page's main element, lies.

    Content is weighed by the ratios of all blocks.  Elements with the same hints are weighed together, the outermost first;
    strong ones must outweigh all other text tenfold.
    """
    if not any(b[3] for b in found):
        return found
    fused = _fused(found, width)
    top = max(fused)
    mass = [len(b[0]) if f >= threshold * top else 0 for b, f in zip(found, fused, strict=True)]
    mains = set()  # hinted elements around a main element
    for _, path, chain, hinted, _ in found:
        tags = path.split("/") if path else []
        if hinted and "main" in tags:
            last = len(tags) - 1 - tags[::-1].index("main")
            mains.update(chain[k] for k, _ in hinted if k < last)
    live = [[(chain[k], h) for k, h in hinted if chain[k] not in mains] for _, _, chain, hinted, _ in found]
    while True:
        free = sum(m for m, x in zip(mass, live, strict=True) if not x)
        text = sum(len(b[0]) for b, x in zip(found, live, strict=True) if not x)
        groups: dict[frozenset, int] = {}
        for m, x in zip(mass, live, strict=True):
            if x:
                groups[x[0][1]] = groups.get(x[0][1], 0) + m
        heavy = [g for g, m in groups.items() if m > (10 * text if g <= STRONG else free)]
        if not heavy:
            return [b for b, x in zip(found, live, strict=True) if not x]
        best = max(heavy, key=lambda g: groups[g])
        live = [x[1:] if x and x[0][1] == best else x for x in live]


def _element(found: list, content: list[int]) -> tuple:
    """The chain of the one article or main element that holds most of the content's text, the outermost; else an empty one."""
    weight: dict[tuple, int] = {}
    for i in content:
        text, path, own, *_ = found[i]
        for k, tag in enumerate(path.split("/") if path else []):
            if tag in ("article", "main"):
                weight[own[: k + 1]] = weight.get(own[: k + 1], 0) + len(text)
                break
    total = sum(len(found[i][0]) for i in content)
    best = max(weight, key=lambda c: weight[c], default=())
    return best if best and 2 * weight[best] >= total else ()


def main_text(html: str | None, threshold: float = THRESHOLD, width: int = WIDTH) -> str:
    """The article's text, its blocks joined by a blank line; empty for null, empty and text-free pages."""
    if not html:
        return ""
    found = _unhinted(blocks(html), threshold, width)
    if not found:
        return ""
    scores = path_scores(found, width)
    least = threshold * max(scores.values())
    content = [i for i, b in enumerate(found) if scores[b[1]] >= least]
    element = _element(found, content)
    if element:
        # in an article only menus without a tag of their own are left out: links on paths that are not content
        kept = [b for b in found if b[2][: len(element)] == element and not (b[4] and scores[b[1]] < least)]
        return "\n\n".join(b[0] for b in kept)
    # the smallest element that holds all content
    chain = found[content[0]][2]
    for i in content:
        other = found[i][2]
        k = 0
        while k < min(len(chain), len(other)) and chain[k] == other[k]:
            k += 1
        chain = chain[:k]
    tags = found[content[0]][1].split("/")
    while chain and tags[len(chain) - 1] in ATTACHED and tags[len(chain) - 1] not in ("td", "th"):
        chain = chain[:-1]  # a single block stands for what it is in
    inside = [b[2][: len(chain)] == chain for b in found]
    leaf = [b[1].rsplit("/", 1)[-1] for b in found]
    attached = [inside[i] and not b[4] and leaf[i] in ATTACHED for i, b in enumerate(found)]
    chosen = set(content)
    first, last = content[0], content[-1]
    while first > 0 and attached[first - 1] and leaf[first - 1] in HEADINGS:
        first -= 1
    # items right behind the last block are its list's
    while last + 1 < len(found) and attached[last + 1] and leaf[last + 1] not in HEADINGS:
        last += 1
    chosen.update(i for i in range(first, last + 1) if attached[i])
    return "\n\n".join(found[i][0] for i in sorted(chosen))


def extract(pages: DataFrame, html: str = "html", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages; null and empty pages give an empty text.

    Repeated rows each get their own row; further columns are left out.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(h, threshold, width) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.select("page_id").schema[0].dataType.simpleString()
    return pages.select("page_id", "url", html).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
