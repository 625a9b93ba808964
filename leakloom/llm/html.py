"""Main text of web pages by tree scoring.

A page becomes a tree (end tags that HTML lets authors omit are implied). Paragraphs pass points
for their length and commas to their ancestors, fewer the farther up; an element's points are
discounted by its link density. The best container and those of its siblings that score like it
are kept, without the menus, notices, adverts, forms and comments inside.

Defined cases: null, empty and text-free pages give an empty text; a page without any scored
element gives the text of its body; null and repeated ids are kept; an empty table gives no rows;
other columns are ignored; elements nested deeper than ``MAX_DEPTH`` become siblings, as in browsers, so no text goes;
a tag ends at the first ``>`` outside quotes, however long it is, and at the first one at all where a quote is never closed; a ``<`` that no ``>`` follows is text; numeric references beyond Unicode become U+FFFD. Memory is that of one
page's tree, and time is in proportion to the page, whatever it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_SIGN = re.compile("[>\"']")
#: Open elements around an element.
MAX_DEPTH = 512
_NUMBER = re.compile(r"&#(?:0*+([0-9]*+)|[xX]0*+([0-9a-fA-F]*+));?")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the key ends where an element of the value starts.
CLOSES_P = BLOCK - {"option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html", "frameset"}
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"})}
SIBLING |= {"thead": SIBLING["tbody"], "tfoot": SIBLING["tbody"]}

DROPPED = frozenset("head script style noscript template iframe object embed svg canvas math audio video form button input select option textarea fieldset nav footer aside dialog menu search noembed noframes xmp".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of class and id names of what isn't the article.
UNLIKELY = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot adsense banner breadcrumb breadcrumbs comment comments commentlist disqus respond cookie cookies consent gdpr notice notices notification alert disclaimer footer footnav header masthead topbar menu nav navbar navigation pager pagination popup modal overlay promo promotion promoted related recommended recommendations rss share sharing shares shoutbox sidebar sidebars rail widget widgets skip social sponsor sponsored sponsors subscribe subscription newsletter signup login toolbar tags taglist hidden paywall outbrain taboola".split())
LIKELY = frozenset("article main content post entry story body text".split())
PARAGRAPH = frozenset("p pre td blockquote dd".split())
BONUS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "address": -3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "h1": -5.0, "h2": -5.0, "h3": -5.0, "h4": -5.0, "h5": -5.0, "h6": -5.0, "th": -5.0}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "depth", "score", "size", "linked", "commas")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent is not None else 0
        self.score: float | None = None
        self.size = self.linked = self.commas = 0


def decoded(text: str) -> str:
    """A text with its character references decoded, numbers of any length included."""

    def short(m: re.Match[str]) -> str:
        digits, most = (m[1], 7) if m[2] is None else (m[2], 6)
        if len(digits) > most:
            return "\ufffd"
        return f"&#{'' if m[2] is None else 'x'}{digits or 0};" if len(m[0]) > 12 else m[0]

    return unescape(_NUMBER.sub(short, text) if "&#" in text else text)


def tag_end(html: str, at: int, dead: set[int]) -> int:
    """The place of the first ``>`` outside quotes from ``at`` on, or -1.

    ``dead`` keeps the quotes that searches without an end opened; a later search that comes to one of them
    has no end either. At a place a search is outside quotes or inside one of two kinds, so a page is searched three times at most.
    """
    opened = []
    while (m := _SIGN.search(html, at)) is not None:
        if m[0] == ">":
            return m.start()
        if m.start() in dead:
            break
        opened.append(m.start())
        close = html.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    dead.update(opened)
    return -1


def parse(html: str) -> Node:
    """The page's tree; text nodes are strings with character references decoded."""
    root = Node("html", "", None)
    at, node, end, lower = 0, root, len(html), None
    dead: set[int] = set()

    def text(s: str) -> None:
        if s:
            node.children.append(decoded(s) if "&" in s else s)

    def close(stop_at: frozenset | set, tags: frozenset | set) -> Node:
        """Ends open elements up to the outermost of ``tags`` above the nearest of ``stop_at``."""
        found, up = None, node
        while up is not None and up.tag not in stop_at:
            if up.tag in tags:
                found = up
            up = up.parent
        return found.parent if found is not None and found.parent is not None else node

    scope_p = {"table", "td", "th", "caption", "button", "object", "html"}
    while at < end:
        m = _OPEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            stop = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            found = html.find(stop, at)
            if m[0] == "<![CDATA[":
                text(html[at : found if found >= 0 else end])
            at = end if found < 0 else found + len(stop)
            continue
        close_at = tag_end(html, at, dead)
        if close_at < 0:
            close_at = html.find(">", at)
        if close_at < 0:
            text(html[m.start() :])
            break
        attrs, at = html[at:close_at], close_at + 1
        tag = m[2].lower()
        if m[1]:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            elif tag == "br":
                node.children.append(Node("br", "", node))
            continue
        if tag in ("html", "body", "head"):
            if tag == "body":
                while node.tag == "head":
                    node = node.parent
            if tag == "html":
                continue
        elif node.tag == "head" and tag not in RAW and tag not in ("meta", "link", "base", "template"):
            node = node.parent
        if tag in CLOSES_P:
            node = close(scope_p, {"p"})
        if tag in SIBLING:
            closed, scope = SIBLING[tag]
            node = close(scope | {"html"}, closed)
        opens = tag not in RAW and (tag not in VOID and not attrs.rstrip().endswith("/") or tag in ("p", "div", "a", "span", "article", "section"))
        if opens and node.depth >= MAX_DEPTH and node.parent is not None:
            node = node.parent
        child = Node(tag, attrs, node)
        node.children.append(child)
        if tag in RAW:
            lower = html.lower() if lower is None else lower
            if len(lower) != end:  # a character whose lower case is longer: find the end with a pattern
                found = re.compile(rf"</{tag}\b", re.I).search(html, at)
                stop = found.start() if found else end
            else:
                stop = lower.find(f"</{tag}", at)
                stop = end if stop < 0 else stop
            close_at = html.find(">", stop)
            at = end if close_at < 0 else close_at + 1
        elif opens:
            node = child
    return root


def names(attrs: str) -> tuple[set[str], dict[str, str]]:
    found = {}
    for k, v in _ATTRIBUTE.findall(attrs):
        found.setdefault(k.lower(), v.strip("\"'"))
    words = _SPLIT.split(_CAMEL.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").lower())
    return set(words) - {""}, found


def dropped(node: Node) -> bool:
    """Whether an element is no part of any article."""
    if node.tag in DROPPED:
        return True
    inside = False
    if node.tag == "header":
        up = node.parent
        while up is not None and not inside:
            inside = up.tag in ("article", "main")
            up = up.parent
        if not inside:
            return True
    if not node.attrs:
        return False
    words, attrs = names(node.attrs)
    if attrs.get("role", "").lower() in DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if node.tag in ("article", "main", "body", "html"):
        return False
    return bool(words & UNLIKELY) and not (words & LIKELY and not words & {"ad", "ads", "comment", "comments", "sidebar", "related", "sponsored", "footer", "nav", "menu"})


def score(root: Node) -> list[Node]:
    """Prune what is no article, add up sizes, and pass points upwards; the elements with points."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not dropped(c)]
        stack.extend(c for c in node.children if not isinstance(c, str))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c.strip()) if "  " not in c and "\n" not in c else len(" ".join(c.split()))
                node.commas += c.count(",") + c.count("，") + c.count("、")
            else:
                node.size += c.size
                node.commas += c.commas
                node.linked += c.size if c.tag == "a" else c.linked
    scored = []
    for node in order:
        if node.tag in PARAGRAPH:
            own = node
            if any(not isinstance(c, str) and (c.tag in PARAGRAPH) for c in node.children):
                continue  # its own paragraphs pass the points
        elif node.tag in ("div", "section", "article", "main", "body") and any((c.strip() if isinstance(c, str) else c.tag in ("b", "i", "em", "strong", "span", "font", "a", "u") and c.size) for c in node.children):
            own = node
        else:
            continue
        inner = own.size if own.tag in PARAGRAPH else sum(len(c.strip()) if isinstance(c, str) else c.size for c in own.children if isinstance(c, str) or c.tag not in BLOCK)
        if not inner:
            continue
        points = (1.0 if inner >= 25 else 0.2) + (own.commas if own.tag in PARAGRAPH else sum(c.count(",") for c in own.children if isinstance(c, str))) + min(inner / 100, 3.0)
        points *= 1 - own.linked / max(own.size, 1)
        up, level = (own.parent, 0) if own.tag in PARAGRAPH else (own, 0)
        while up is not None and level < 5:
            if up.score is None:
                words = names(up.attrs)[0] if up.attrs else set()
                up.score = BONUS.get(up.tag, 0.0) + 10.0 * bool(words & LIKELY)
                scored.append(up)
            up.score += points / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1
    for node in scored:
        node.score *= 1 - node.linked / max(node.size, 1)
    return scored


def main_nodes(root: Node) -> list[Node]:
    """The best container with those siblings that read like a part of it, in page order."""
    scored = [n for n in score(root) if n.size]
    best = max(scored, key=lambda n: n.score, default=None)
    if best is None:
        return [root]
    if best.parent is None:
        return [best]
    least, out = max(10.0, 0.2 * best.score), []
    for n in best.parent.children:
        if isinstance(n, str):
            continue
        density = n.linked / max(n.size, 1)
        same = n.tag == best.tag and n.attrs and n.attrs == best.attrs
        if n is best or (n.score is not None and n.score + 0.2 * best.score * bool(same) >= least and density < 0.33 and n.tag not in ("ul", "ol", "dl")) or n.tag == "p" and (n.size > 80 and density < 0.25 or n.size and not n.linked and n.commas):
            out.append(n)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """The text of block after block; inline elements run on, white space becomes one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        s = " ".join("".join(run).split())
        if s:
            out.append(s)
        run.clear()

    for top in nodes:
        stack: list[tuple[Node | str, bool]] = [(top, False)]
        while stack:
            node, done = stack.pop()
            if isinstance(node, str):
                run.append(node)
                continue
            if node.tag in ("td", "th"):
                run.append(" ")
            elif node.tag in BLOCK:
                flush()
            elif node.tag == "br":
                run.append(" ")
            if done:
                continue
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
        flush()
    return out


def main_text(html: str | None) -> str:
    return "\n\n".join(blocks(main_nodes(parse(html)))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    bound_batches(pages.sparkSession, 128)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(main_text, batch.column(2).to_pylist()), pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
