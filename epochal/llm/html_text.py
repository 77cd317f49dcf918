"""Main text of web pages by composite text density.

A page becomes a tree of elements. Subtrees that are never an article (scripts,
menus, forms, footers, and elements whose class, id or role says sidebar, advert,
notice, comments and the like) are cut off first. For every other node the
composite text density relates its characters to its tags and discounts links:

    D = C/T * log_base((C/LC) * (T/LT)),  base = ln(C/NC * LC + LCb/Cb * C + e)

with C characters, T tags, LC and LT those in links, NC characters outside
links, b the body with all its parts, 1 for every zero below a fraction bar, and
a floor under the base, which near 1 would make small nodes dense. Block elements
and links count as tags; other inline elements belong to the text around them. A
node's density sum is the sum over its children, own text counting as a child.
The node with the largest sum sets a threshold, the least density on its path
from the body; in every node that reaches the threshold, the descendant with the
largest sum is content with all that it holds. If the node with the largest sum
stands in an article element, content is widened to that element and ends there.

Blocks: the text between the boundaries of block elements, white space turned
into one blank, trimmed, empty ones left out, joined by line feeds in page order.
Line breaks inside a block are white space. Character references are decoded.

Defined results: a null or empty page, or one without an article, gives the empty
text; broken markup is read as far as it goes, missing end tags are implied. An
empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import mapped, pick

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

#: Kinds of elements by name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head script style title textarea noscript template iframe object svg canvas math nav footer aside form button select input dialog menu audio video map noembed noframes".split())
OUTER = frozenset("html body main article".split())
#: Words in a class or id, and roles, of what is not part of an article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu topbar toolbar "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login search share sharing social comment comments disqus discussion reply replies respond pagination pager copyright".split()
)
#: Parts of a class that say a page has or lacks such a box, and parts that follow the word in the name of the box itself.
ABOUT = frozenset("no not non has have with without hide hidden show".split())
BOX = frozenset("area areas bar block box boxes column container content form group holder inner item items left right links list menu nav panel section slot top bottom unit wrap wrapper".split())
#: An element with a larger part of the body's characters outside links is not cut for its class.
LARGER = 0.6
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: An open element that a start tag ends, and where the look for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NO_P_INSIDE = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "legend", "summary"} | {"li", "dd", "dt"}
P_STOPS = frozenset({"table", "td", "th", "button", "object", "body", "html"})

#: Least base of the logarithm in the density.
BASE_FLOOR = 2.0


def _not_article(token: str, framed: bool) -> bool:
    """Whether a class or id names a box beside the article: it ends with such a word, or goes on with parts of a box only."""
    parts = [x for x in re.split("[^a-z0-9]+", token) if x]
    if not parts or not ABOUT.isdisjoint(parts):
        return False
    while len(parts) > 1 and (parts[-1] in BOX and parts[0] in NOT_ARTICLE or parts[-1].isdigit()):
        parts.pop()
    return parts[-1] in NOT_ARTICLE and not (framed and parts[-1] == "header")


class Page:
    """The elements of a page in order: tag, parent and whether cut off; and its runs of text with their elements."""

    def __init__(self, source: str):
        self.tags, self.parents, self.cut = ["html"], [-1], [False]
        self.named: set[int] = set()  # to be cut for their class or id
        self.events: list[tuple[int, str | None]] = []  # (node, text), or None at the boundary of a block
        self.open = Counter({"html": 1})  # elements that are open, by name
        stack, at, size = [0], 0, len(source)
        while at < size:
            found = TAG.search(source, at)
            if not found:
                self._text(stack[-1], source[at:])
                break
            if found.start() > at:
                self._text(stack[-1], source[at : found.start()])
            at = max(found.end(), found.start() + 1)
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(stack, tag)
                continue
            self._start(stack, tag, found[3] or "")
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(source, at)
                at = end.end() if end else size
                self._drop(stack, len(stack) - 1)
            elif tag in VOID or (found[3] or "").rstrip().endswith("/") and tag in ("svg", "path", "use"):
                self._drop(stack, len(stack) - 1)

        self._cut_named()

    def _cut_named(self) -> None:
        """Cuts what class or id name, but no element that holds the larger part of the text."""
        if not self.named:
            return
        n = len(self.tags)
        linked, plain = [False] * n, [0] * n
        for i in range(1, n):
            linked[i] = self.tags[i] == "a" or linked[self.parents[i]]
        for node, text in self.events:
            if text and not self.cut[node] and not linked[node]:
                plain[node] += len(" ".join(text.split()))
        for i in range(n - 1, 0, -1):
            plain[self.parents[i]] += plain[i]
        for i in range(1, n):
            self.cut[i] = self.cut[i] or self.cut[self.parents[i]] or i in self.named and plain[i] <= LARGER * plain[0]

    def _text(self, node: int, raw: str) -> None:
        self.events.append((node, html.unescape(raw)))

    def _start(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.open[tag]:
            self._push(stack, stack[-1])  # a second one adds nothing; the end tag or the end of the page closes it
            return
        if tag in NO_P_INSIDE:
            self._implied(stack, {"p"}, P_STOPS)
        if tag in CLOSES:
            self._implied(stack, *CLOSES[tag])
        parent = stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        node = len(self.tags) - 1
        self.cut.append(self.cut[parent] or self._never(tag, attributes, node))
        self._push(stack, node)
        if tag in BLOCK:
            self.events.append((node, None))
        elif tag == "br":
            self.events.append((parent, " "))

    def _push(self, stack: list[int], node: int) -> None:
        stack.append(node)
        self.open[self.tags[node]] += 1

    def _drop(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self.open[self.tags[node]] -= 1
        del stack[k:]

    def _end(self, stack: list[int], tag: str) -> None:
        if not self.open[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == tag:
                self._pop(stack, k)
                return
            if tag not in BLOCK and self.tags[stack[k]] in BLOCK:
                return  # an inline end tag does not end the block around it

    def _implied(self, stack: list[int], ends: set[str], stops) -> None:
        if not any(self.open[tag] for tag in ends):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in ends:
                self._pop(stack, k)
                return
            if tag in stops:
                return

    def _pop(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            if self.tags[node] in BLOCK:
                self.events.append((node, None))
                break
        self._drop(stack, k)

    def _never(self, tag: str, attributes: str, node: int) -> bool:
        if tag in NEVER:
            return True
        framed = self.open["article"] + self.open["main"] > 0
        if tag == "header" and not framed:
            return True
        if not attributes or tag in OUTER:
            return False
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id") and any(_not_article(token, framed) for token in value.split()):
                self.named.add(node)
            if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        return False

    def content(self) -> set[int]:
        """The nodes whose whole subtrees are content."""
        n = len(self.tags)
        body = next((i for i in range(n) if self.tags[i] == "body"), 0)
        chars, link_chars, tags, link_tags, own = ([0] * n for _ in range(5))
        linked, all_chars, all_links = [False] * n, 0, 0
        for i in range(n):
            linked[i] = self.tags[i] == "a" or i > 0 and linked[self.parents[i]]
        for node, text in self.events:
            size = len(" ".join(text.split())) if text else 0
            all_chars += size
            all_links += size * linked[node]
            if size and not self.cut[node]:
                own[node] += size
                chars[node] += size
                link_chars[node] += size * linked[node]
        counted = [t in BLOCK or t == "a" for t in self.tags]
        for i in range(n - 1, 0, -1):
            if not self.cut[i]:
                p = self.parents[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + counted[i]
                link_tags[p] += link_tags[i] + (self.tags[i] == "a")
                own[p] += 0 if counted[i] else own[i]
        if not chars[body]:
            body = 0
        if not chars[body]:
            return set()
        around = all_links / (all_chars or 1)

        def density_of(c: int, lc: int, t: int, lt: int) -> float:
            base = max(BASE_FLOOR, math.log(c / ((c - lc) or 1) * lc + around * c + math.e))
            return c / (t or 1) * max(0.0, math.log(c / (lc or 1) * ((t or 1) / (lt or 1)), base)) if c else 0.0

        density = [0.0 if self.cut[i] else density_of(chars[i], link_chars[i], tags[i], link_tags[i]) for i in range(n)]
        total = [density_of(own[i], own[i] * linked[i], 1, linked[i]) if counted[i] or i == 0 else 0.0 for i in range(n)]
        around_of = [0] * n  # the nearest element around that counts
        for i in range(1, n):
            p = self.parents[i]
            around_of[i] = p if counted[p] else around_of[p]
            if counted[i] and not self.cut[i]:
                total[around_of[i]] += density[i]
        best = list(range(n))  # in each subtree, the node with the largest sum; of equals the outermost
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            if not self.cut[i] and total[best[i]] > total[best[p]]:
                best[p] = best[i]
        at, least, article = best[body], math.inf, None
        while at > 0:
            least = min(least, density[at])
            article = at if self.tags[at] == "article" else article
            if at == body:
                break
            at = self.parents[at]
        if article is not None:
            return {article}
        least = min(least, density[body])
        inside = [i == body for i in range(n)]
        for i in range(body + 1, n):
            inside[i] = inside[self.parents[i]] and not self.cut[i]
        return {best[i] for i in range(n) if inside[i] and counted[i] and chars[i] and density[i] >= least}

    def text(self) -> str:
        marked = self.content()
        if not marked:
            return ""
        inside = [False] * len(self.tags)
        for i in range(len(self.tags)):
            inside[i] = not self.cut[i] and (i in marked or i > 0 and inside[self.parents[i]])
        blocks: list[str] = []
        run: list[str] = []
        for node, text in [*self.events, (0, None)]:
            if text is None:
                if block := " ".join("".join(run).split()):
                    blocks.append(block)
                run = []
            elif inside[node]:
                run.append(text)
        return "\n".join(blocks)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pick(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [rows.schema[n].dataType.simpleString() for n in ("page_id", "url")]
    return mapped(rows, run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
