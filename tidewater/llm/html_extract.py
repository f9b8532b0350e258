"""Main text of web pages by composite text density.

Each page is read into its element tree (void, raw-text and implied-end rules of HTML, unclosed and stray tags).  What
is no article by its element, role or name goes first: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments.  Then, for every node, the composite text density is the characters for each tag,
adjusted by link characters and link tags against those of the whole body.  A node's density sum adds its children's
densities.  The node of the largest sum holds the main text; the least density on the path from it to the body is the
threshold: ancestors with further children of at least that density belong to the article, too (without their
link-dominated parts), and if the node lies in an ``article`` element, all of that element does.

Blocks are runs of text between block elements; white space (of any kind, ``br`` included) becomes one space.

Defined results: null and empty pages, and pages without text, give the empty text; text beyond an unclosed comment,
script or tag is part of it; a stray ``<`` is text; equal sums go to the node that comes first; repeated rows each get
a row; null ids and urls stay null; work is linear in the length of a page; an empty table gives no rows; only page_id,
url and html are read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "page_id long, url string, text string, n_chars long"
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

# HTML elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr br".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
IN_HEAD = set("base link meta noscript script style template title".split())
NO_P_END = INLINE | IN_HEAD | set("audio button canvas embed iframe input label map math object select svg textarea video option".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
# Elements, roles and words of class or id that mark what is no article.
AWAY = set("aside audio button canvas datalist dialog footer form head iframe input menu nav noscript object option select "
           "script style svg template textarea title video".split())
AWAY_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
AWAY_WORDS = set("ad ads adbox adslot adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment "
                 "commentlist comments consent cookie cookies copyright disclaimer discussion disqus dropdown footer gdpr masthead menu "
                 "menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo "
                 "promoted promotion reactions recommendations recommended related replies respond responses share sharing sidebar "
                 "signup skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget".split())
# A class such as "has-sidebar" or "comments-open" says what a page has, not what the element is.
STATE_WORDS = set("closed enabled disabled has no not off on open with without".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# Comments, end and start tags, other declarations; a quoted attribute value may hold ">".
TAG = re.compile(r"""<(?:!--(?P<note>)|(?P<other>[!?]|/[^a-zA-Z>])|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)
                      (?P<attrs>(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|/>)""", re.X)
OPEN = re.compile(r"</?[a-zA-Z]")
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|itemprop)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?(?=[\s/]|$)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """The element tree of a page: parallel lists by node, and its text pieces in order (None: a block ends)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.away, self.main = ["#"], [-1], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []
        self.stack, self.open = [0], {}
        self.inline_open: list[dict[str, int]] = [{}]     # by block on the stack
        self.read(source)

    def read(self, source: str) -> None:
        at, end, last = 0, len(source), source.rfind(">")
        while at < end:
            lt = source.find("<", at)
            if lt < 0:
                lt = end
            if lt > at:
                self.text(source[at:lt])
            if lt == end:
                return
            m = TAG.match(source, lt) if lt < last else None
            if m is None:
                if lt < last and OPEN.match(source, lt):
                    # No ">" outside quotes up to the end: quotes mean nothing from here on.
                    source, at = source.replace('"', " ").replace("'", " ") if '"' in source or "'" in source else source, lt
                    if TAG.match(source, lt) is None:
                        return
                    continue
                if OPEN.match(source, lt) or source.startswith("<!", lt):
                    return                                      # the page ends inside a tag
                self.text("<")
                at = lt + 1
                continue
            if m["note"] is not None:
                close = source.find("-->", lt + 2)
                at = end if close < 0 else close + 3
            elif m["name"] is None:
                close = source.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                name, at = m["name"].lower(), m.end()
                if m["end"]:
                    self.close(name)
                elif name in RAW:
                    close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                    gt = source.find(">", close.end()) if close else -1
                    at = end if gt < 0 else gt + 1
                else:
                    self.start(name, m["attrs"])

    def text(self, raw: str) -> None:
        self.pieces.append((self.stack[-1], html.unescape(raw) if "&" in raw else raw))

    def boundary(self) -> None:
        if self.pieces and self.pieces[-1][1] is not None:
            self.pieces.append((0, None))

    def start(self, name: str, attrs: str) -> None:
        if name in ("html", "body"):
            self.pop_to("head")
            return
        if name not in IN_HEAD:
            self.pop_to("head")
        if name not in NO_P_END:
            self.pop_to("p")
        if name in CLOSES:
            same, bounds = CLOSES[name]
            for held in reversed(self.stack):
                if self.tag[held] in bounds:
                    break
                if self.tag[held] in same:
                    self.pop_to(self.tag[held])
                    break
        node, parent = len(self.tag), self.stack[-1]
        away, main = _judged(name, attrs, any(self.open.get(x) for x in ("article", "main")))
        self.tag.append(name)
        self.parent.append(parent)
        self.away.append(away)
        self.main.append(main)
        inline = name in INLINE
        if not inline:
            self.boundary()
        elif name == "br":
            self.pieces.append((node, " "))
        if name in VOID:
            return
        self.stack.append(node)
        if inline:
            held = self.inline_open[-1]
            held[name] = held.get(name, 0) + 1
        else:
            self.open[name] = self.open.get(name, 0) + 1
            self.inline_open.append({})

    def close(self, name: str) -> None:
        if name in INLINE:
            if self.inline_open[-1].get(name):
                while self._pop() != name:
                    pass
        else:
            self.pop_to(name)

    def pop_to(self, name: str) -> None:
        if self.open.get(name):
            while self._pop() != name:
                pass

    def _pop(self) -> str:
        name = self.tag[self.stack.pop()]
        if name in INLINE:
            self.inline_open[-1][name] -= 1
        else:
            self.open[name] -= 1
            self.inline_open.pop()
            self.boundary()
        return name


def _judged(name: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element goes, and whether it is marked as an article.  A header inside an article stays."""
    away, main = name in AWAY or (name == "header" and not inside), name == "article"
    if attrs and not attrs.isspace():
        for key, value in ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                names = [{w.lower() for w in WORD.findall(x)} for x in value.split()]
                words = set().union(*[x for x in names if not x & STATE_WORDS])
                away = away or bool(words & AWAY_WORDS) or ("header" in words and not inside)
            elif key == "role":
                away, main = away or value.lower() in AWAY_ROLES, main or value.lower() == "article"
            elif key == "itemprop":
                main = main or value.lower() == "articlebody"
            elif key == "hidden" or (key == "style" and UNSHOWN.search(value)):
                away = True
    return away, main


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters for each tag, times a logarithm that falls with the share of links."""
    if not chars:
        return 0.0
    tags, linked, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars * linked / max(chars - link_chars, 1) + body_ratio * chars + math.e)
    return max(0.0, chars / tags * math.log(chars / linked * tags / link_tags) / math.log(base))


def main_text(source: str) -> str:
    """The article of a page as blocks joined by line feeds."""
    page = Page(source)
    n, tag, parent = len(page.tag), page.tag, page.parent
    # A wrapper is not judged by its name when it holds the page's heading or an article of its own.
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        if holds[i] or tag[i] == "main" or ((tag[i] == "h1" or page.main[i]) and not page.away[i]):
            holds[parent[i]] = True
    gone, link = [False] * n, [False] * n
    for i in range(1, n):
        p = parent[i]
        gone[i] = gone[p] or (page.away[i] and (tag[i] in AWAY or tag[i] == "header" or not holds[i] or page.main[i]))
        link[i] = link[p] or tag[i] == "a"
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for i, piece in page.pieces:
        if piece is not None and not gone[i]:
            size = sum(map(len, piece.split()))
            chars[i] += size
            if link[i]:
                link_chars[i] += size
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            p = parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tag[i] == "a")
    ratio = link_chars[0] / max(chars[0], 1)
    density = [composite_density(*x, ratio) for x in zip(chars, tags, link_chars, link_tags)]
    sums = [0.0] * n
    for i in range(1, n):
        if not gone[i]:
            sums[parent[i]] += density[i]
    best = max(range(n), key=sums.__getitem__)
    chosen, dropped = _chosen(page, gone, chars, link_chars, density, best)
    inside = [False] * n
    for i in range(n):
        inside[i] = not gone[i] and i not in dropped and (i == chosen or (i > 0 and inside[parent[i]]))
    blocks, held = [], []
    for i, piece in [*page.pieces, (0, None)]:
        if piece is None:
            if held:
                block = " ".join("".join(held).split())
                if block:
                    blocks.append(block)
                held = []
        elif inside[i]:
            held.append(piece)
    return "\n".join(blocks)


def _chosen(page: Page, gone: list[bool], chars: list[int], link_chars: list[int], density: list[float], best: int) -> tuple[int, set[int]]:
    """The node of the article and the nodes in it that are left out, from the node of the largest density sum."""
    path = [best]
    while path[-1]:
        path.append(page.parent[path[-1]])
    marked = [i for i in path if page.main[i]]
    if marked:
        return next((i for i in reversed(marked) if page.tag[i] == "article"), marked[-1]), set()
    threshold = min(density[i] for i in path)
    on_path = set(path)
    beside: dict[int, list[int]] = {}
    for i in range(1, len(gone)):
        if page.parent[i] in on_path and i not in on_path and not gone[i] and chars[i]:
            beside.setdefault(page.parent[i], []).append(i)
    chosen = best
    for i in path[1:]:
        if any(density[k] >= threshold or page.tag[k] in HEADINGS for k in beside.get(i, ())):
            chosen = i
    dropped = {k for i in path[1:path.index(chosen) + 1] for k in beside.get(i, ())
               if 2 * link_chars[k] > chars[k] and page.tag[k] not in HEADINGS}
    return chosen, dropped


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; one pass without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x or "") for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_PAGE)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(rows, PAGE)
