"""Main text of web pages by composite text density.

Every element gets its characters per tag, adjusted for links: with C characters, T tags, LC characters and LT tags in
links (each 1 at least, of its whole subtree), its density is C / T times the logarithm of (C / LC) * (T / LT) to the
base ln(C * LC / (C - LC) + C * LC_body / C_body + e). An element's score is the sum of its children's densities; that
of the largest score (the first of equals) is the main one. The thinnest element on the path from the body down to it
gives the threshold: the main element and every subtree beside that path that is at least as dense are the text, each
with the headings right before it; what is thinner goes, unless it is the small rest (`NEARLY`) of an element that is
otherwise text, and no links. Tags decide nothing here: an article element wins by its
densities or not at all.

What a page declares as no part of its text (menus, headers and footers of the page, asides, forms, scripts, adverts,
notices, reader comments) is taken out first and counts nowhere. A class or id declares it only by whole names, and
never for article, main or an element that holds most of the body's text. A header stays where it heads a part of the
page: in article or main, or below another element with a heading, without menu or form and not mostly links.
Every step is linear in the page, whatever its nesting.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartosea.llm.common import column, sliced

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=>"'/]++)\s*+=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold a page's own text.
_OUT = frozenset("script style textarea title noscript template iframe head nav aside footer form button select option svg canvas object menu dialog audio video map noembed noframes".split())
_OUT_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of class and id that mark what isn't the article, and whole names that do.
_OUT_WORD = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|rail|widget|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|footer|masthead|topbar|copyright|hidden)\d*",
    re.I,
)
_OUT_WHOLE = frozenset("side-bar site-header page-header skip-link".split())
#: Words that may stand beside them in a name for furniture; with any other word (has-sidebar, comments-open) it is a
#: state or a topic.
_BESIDE = re.compile(
    r"(?:site|page|main|global|top|bottom|left|right|primary|secondary|header|bar|box|block|container|wrapper|wrap|inner|outer|area|section|list|links?|buttons?|btn|icons?|posts?|articles?|stories|story|items?|form|unit|slot|space|google|text|mobile|desktop|sticky|fixed|floating|group|row|column|col|panel|zone|thread|media|bars?|the|and|by|on|us|follow|blog|user|reader|email|mail|accept|policy|\d+)\d*",
    re.I,
)
#: Those that name no layout: they may outgrow a short article, and count as the page's text only if next to nothing else does.
_NEVER = re.compile(r"comments?|commentlist|disqus|replies|respond|ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|newsletter|breadcrumbs?|pagination|pager|copyright", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The share of an element's text that may be thinner than the threshold where all of it is taken as the article's.
NEARLY = 0.2
_SCOPE = frozenset("table ul ol dl article section div main body html blockquote figure".split())
#: Open elements that a start tag may close, or that keep it from closing others.
_EDGE = _SCOPE.union(*_CLOSES.values())


class _Node:
    __slots__ = ("tag", "up", "kids", "out", "chars", "tags", "link_chars", "link_tags", "density", "span", "named", "inside", "para", "edge")

    def __init__(self, tag: str, up: _Node | None, out: bool, at: int, depth: int = 0):
        self.tag, self.up, self.out, self.kids = tag, up, out, []
        # whether an article or main holds it; depths of the nearest p or scope, and of the nearest edge, itself included
        self.inside = tag in ("article", "main") or up is not None and up.inside
        self.para = depth if tag == "p" or tag in _SCOPE or up is None else up.para
        self.edge = depth if tag in _EDGE or up is None else up.edge
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density, self.span, self.named = 0.0, [at, at], 0.0


def _is_out(tag: str, attributes: str) -> bool:
    if tag in _OUT:
        return True
    if not attributes.strip() or tag in ("body", "html"):
        return bool(re.search(r"\bhidden\b", attributes)) if attributes.strip() and tag not in ("body", "html") else False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.strip().lower() in _OUT_ROLE or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"""=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", attributes), re.I))


def _named(tag: str, attributes: str) -> float:
    """The share of the body's text up to which class or id mark the element as no part of the article; 0: they don't."""
    share = 0.0
    if tag in ("body", "html", "article", "main") or not attributes.strip():
        return share
    for name, value in _ATTRIBUTE.findall(attributes):
        for token in value.strip("\"'").split() if name.lower() in ("class", "id") else ():
            parts = [x for x in re.split(r"[-_]+", token) if x]
            marks = [x for x in parts if _OUT_WORD.fullmatch(x)]
            if token.lower() in _OUT_WHOLE or marks and all(_OUT_WORD.fullmatch(x) or _BESIDE.fullmatch(x) for x in parts):
                share = max(share, 0.98 if any(_NEVER.fullmatch(x) for x in marks) else 0.5)
    return share


def _drop_declared(root: _Node, flow: list[tuple[str, _Node | None]]) -> None:
    """Take out headers of the page, and the elements that a name marks unless most of the body's text is theirs."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.kids
    if not any(n.named or n.tag == "header" for n in order):
        return
    size, links, titled, menus = dict.fromkeys(order, 0), dict.fromkeys(order, 0), set(), set()
    for s, n in flow:
        if n is not None:
            size[n] += len("".join(s.split()))
    for n in reversed(order):
        if n.tag == "a":
            links[n] = size[n]
        if n.up is not None:
            size[n.up] += size[n]
            links[n.up] += links[n]
            if n.tag in _HEADINGS or n in titled:
                titled.add(n.up)
            if n.tag in ("nav", "menu", "form") or n in menus:
                menus.add(n.up)
    body = size[next((k for k in root.kids if k.tag == "body"), root)]
    for n in order:
        head = n.tag == "header" and not n.inside and (n.up.tag in ("html", "body") or n not in titled or n in menus or 2 * links[n] > size[n])
        n.out = n.out or n.up is not None and n.up.out or head or 0 < n.named and size[n] <= n.named * body


def _parse(page: str) -> tuple[_Node, list[tuple[str, _Node | None]]]:
    """The element tree, and the page's flow: texts with their element, or a block edge ("", None)."""
    root = _Node("html", None, False, 0)
    stack, flow, at, size, opened = [root], [], 0, len(page), Counter(["html"])

    def text(s: str) -> None:
        if s and not stack[-1].out:
            flow.append((html.unescape(s), stack[-1]))

    def pop(n: int) -> None:
        for node in stack[n:]:
            node.span[1] = len(flow)
            opened[node.tag] -= 1
            if node.tag in _BLOCK:
                flow.append(("", None))
        del stack[n:]

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if opened[tag] else 0
            if found:
                pop(found)
            elif tag == "p" or tag == "br":
                flow.append(("", None))
            continue
        if tag in ("html", "body"):
            if tag == "html" or opened["body"]:
                continue
            pop(1)
        if tag in _BLOCK:
            flow.append(("", None))
        if tag in _BLOCK and tag != "br":
            p = stack[-1].para
            if stack[p].tag == "p":
                pop(p)
        i = stack[-1].edge if tag in _CLOSES else 0
        while i > 0:
            if stack[i].tag in _CLOSES[tag]:
                pop(i)
                if tag in ("li", "dt", "dd", "option"):
                    break
            elif stack[i].tag in _SCOPE and not (tag in ("li", "dt", "dd") and stack[i].tag == "div"):
                break
            i = stack[i - 1].edge
        up = stack[-1]
        node = _Node(tag, up, up.out or _is_out(tag, m[3]), len(flow), len(stack))
        node.named = 0.0 if node.out else _named(tag, m[3])
        up.kids.append(node)
        if tag in _VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            node.span[1] = len(flow)
            continue
        stack.append(node)
        opened[tag] += 1
    pop(1)
    root.span[1] = len(flow)
    _drop_declared(root, flow)
    return root, [("" if n is not None and n.out else s, n) for s, n in flow]


def _measure(root: _Node, flow: list[tuple[str, _Node | None]]) -> list[_Node]:
    """Sums over subtrees; the nodes in page order."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += reversed([k for k in n.kids if not k.out])
    for s, n in flow:
        if n is not None:
            n.chars += len("".join(s.split()))
    for n in reversed(order):
        for k in n.kids:
            if not k.out:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    return order


def _densities(order: list[_Node], body: _Node) -> None:
    share = body.link_chars / max(1, body.chars)
    for n in order:
        if n.chars:
            c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
            base = math.log(c * lc / max(1, c - n.link_chars) + c * share + math.e)
            n.density = c / t * max(0.0, math.log(c * t / (lc * lt)) / math.log(base)) if base > 1.0 + 1e-12 else c / t
            if base <= math.e and base > 1 and math.log(base) < 1e-9:
                n.density = c / t


def extract(page: str | None) -> str:
    """The main text: blocks in page order joined by one newline; empty if a page has none."""
    if not page:
        return ""
    root, flow = _parse(page)
    body = next((k for k in root.kids if k.tag == "body"), root)
    if body.out:
        return ""
    order = _measure(root, flow)
    _densities(order, body)
    best, top = body, -1.0
    for n in order:
        score = sum(k.density for k in n.kids if not k.out)
        if score > top and n is not root or n is body and top < 0:
            best, top = n, score
    parts = _dense(best, body)
    blocks, now = [], []
    for s, n in [x for part in parts for x in [*flow[part.span[0] : part.span[1]], ("", None)]]:
        if n is not None:
            now.append(s)
        elif now:
            line = " ".join("".join(now).split())
            if line:
                blocks.append(line)
            now = []
    return "\n".join(blocks)


def _dense(best: _Node, body: _Node) -> list[_Node]:
    """In page order, the main element and the subtrees beside its path that are as dense as the path's thinnest."""
    path, p = [best], best
    while p is not body and p.up is not None:
        p = p.up
        path.append(p)
    least = min(n.density for n in path)
    parts = [_with_heading(best, body)]
    while parts[-1] is not body and parts[-1].up is not None:
        parts.append(parts[-1].up)
    kept, above = parts[:1], parts[1:]
    chars, links = parts[0].chars, parts[0].link_chars
    for n, on in zip(above, parts):
        kids = [k for k in n.kids if not k.out and k.chars]
        after, more = False, []
        for k in reversed(kids):
            heading = k.tag in _HEADINGS or k.tag in ("header", "hgroup")
            if k is not on:
                after = after if heading else k.density >= least
                if after:
                    more.append(k)
            else:
                after = True
        # an element nearly all of whose text is the article's is whole, but for rests of links: short lines belong to it
        chars, links = chars + sum(k.chars for k in more), links + sum(k.link_chars for k in more)
        if n is not body and n.chars - chars <= NEARLY * n.chars and 2 * (n.link_chars - links) <= n.chars - chars:
            kept, chars, links = [n], n.chars, n.link_chars
        else:
            kept += more
    return sorted(kept, key=lambda n: n.span)


def _with_heading(node: _Node, body: _Node) -> _Node:
    """The highest ancestor below the body that adds nothing but headings and text that is mostly no links."""
    while node is not body and node.up is not None and node.tag != "html":
        up = node.up
        rest = up.chars - node.chars
        if node.tag in _BLOCK and (rest == 0 or any(k.tag in ("h1", "h2") for k in up.kids if not k.out)) and up.link_chars - node.link_chars <= 0.5 * rest:
            node = up
        elif node.tag not in _BLOCK or node.tag in ("p", "li", "h1", "h2", "h3"):
            node = up
        else:
            break
    return node


def _run(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_html"):
            text = [extract(x) for x in b.column("_html").to_pylist()]
            yield pa.record_batch([*[b.column(f) for f in fields], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=[*fields, "_text", "_n"])

    return run


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of the html column; null, empty and text-free pages give "".

    Other columns pass through; those named text or n_chars are replaced.
    """
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    fields = [f"_c{i}" for i in range(len(keep))]
    slim = pages.select(*[column(pages, c).alias(f) for c, f in zip(keep, fields)], column(pages, html).alias("_html"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("_text", T.StringType()), T.StructField("_n", T.LongType())])
    out = slim.mapInArrow(_run(fields), schema)
    return out.select(*[F.col(f).alias(c) for f, c in zip(fields, keep)], F.col("_text").alias("text"), F.col("_n").alias("n_chars"))
