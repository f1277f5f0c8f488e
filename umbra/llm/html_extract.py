"""Main text of HTML pages by tag-path ratios.

Blocks of text are grouped by their root-to-leaf tag path (inline elements are
no part of it, but blocks that are nothing but links have a path of their own;
class and id hints count). Every path has its mean text length and mean
punctuation per block and the spread of both. The two ratios are fused, the
value of the sequence of blocks is smoothed with a Gaussian window, and a path
is content when the mean smoothed value of its blocks reaches a share of the
spread over the page. The content's container is the deepest element that holds
all blocks of content paths, but a whole article or main element and never a
list, table or quotation; short blocks inside it (headings, list items, one-word
paragraphs) belong to the article and are kept with it, as are the headings
beside it and what stands between them and it.

Elements that are never part of an article (nav, aside, page headers and footers,
forms, scripts, styles, what is hidden) are left out wherever they stand. Those
that only their class, id or role marks (menus, sidebars, adverts, notices,
reader comments), and lists of nothing but links, are scored with the page and
left out where they score low. Inline elements marked as adverts are left out.

The page is read once from left to right; the work is linear in its length and
in the number of its elements, however they are nested or left open.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import whole_ids
from umbra.llm.markup import attributes, raw_ends, walk

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select button canvas audio video noframes xmp".split())
DROPPED = frozenset("nav aside footer form menu dialog fieldset head".split()) | RAW
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTION = frozenset("article main section body html div td table ul ol dl blockquote".split())
#: Elements that can be the container of an article; one that is a list, table or quotation has its heading and intro beside it.
HOLDERS = frozenset("article main section body html div center".split())
#: Class, id or role values (each blank-separated one as a whole) that mark what may be no part of an article.
HINT_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside related recommended recommendations share sharing social footer masthead topbar toolbar pagination pager comment comments commentlist disqus replies discussion widget login signup skip complementary contentinfo search".split())
ARTICLE_HINT = re.compile(r"(?:^|[^a-z0-9])(?:article|articlebody|content|entry|post|story|main)(?:$|[^a-z0-9])")

#: Of these, inline elements are left out for too.
INLINE_ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: Kinds of elements that a start tag of one of them ends, with the elements that shield those outside.
SCOPES = ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("tr", "td", "th"), ("table",)), (("td", "th"), ("tr", "table")))
#: Place in SCOPES of what a start tag ends.
ENDS = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3}
LISTS = frozenset("ul ol menu dl".split())
#: Elements that change what a start tag ends.
SCOPED = SECTION | {"p"} | {t for kinds, bounds in SCOPES for t in kinds + bounds}

RAW_END = raw_ends(RAW)
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")

SMOOTH = (0.25, 0.5, 1.0, 0.5, 0.25)
#: Share of the standard deviation over the page's blocks that a path must reach.
THRESHOLD = 0.3


class _Node:
    """An open element. What holds for all inside it is handed down, so no one climbs."""

    __slots__ = ("article", "depth", "dropped", "hinted", "marked", "marker", "parent", "path", "scopes", "tag", "listed")

    def __init__(self, tag: str, parent, path: int):
        self.tag, self.parent, self.path = tag, parent, path
        self.depth = parent.depth + 1 if parent else 0
        self.article = self.dropped = self.hinted = self.marked = False
        self.marker = self.listed = None  # nearest marked element and list
        self.scopes = parent.scopes if parent else (None,) * (len(SCOPES) + 1)


class _Block:
    __slots__ = ("linked", "node", "parts", "path", "text")

    def __init__(self, node: _Node):
        self.node, self.path, self.parts, self.text, self.linked = node, node.path, [], "", True


def _hints(text: str) -> tuple[str, bool]:
    """Class, id and role values in lower case, and whether the element is hidden."""
    words, hidden = [], False
    for name, value in attributes(text):
        if name in ("class", "id", "role"):
            words.append(value.lower())
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
    return " ".join(words), hidden


class _Page:
    """The page's elements in order and its blocks of text outside dropped elements, in page order."""

    def __init__(self, page: str):
        self.paths: dict[tuple, int] = {}
        self.above: list[int] = []  # of a path
        self.root = _Node("", None, self._path(-1, ""))
        self.nodes = [self.root]
        self.blocks: list[_Block] = []
        self.at = self.root
        self.open: dict[str, int] = {}
        self.current: _Block | None = None
        self.links = 0
        self.unheard: list[str] = []  # inline adverts that are open
        self._read(page)

    def _path(self, above: int, step: str) -> int:
        found = self.paths.setdefault((above, step), len(self.above))
        if found == len(self.above):
            self.above.append(above)
        return found

    def _add(self, text: str) -> None:
        if not text or self.at.dropped or self.unheard:
            return
        if self.current is None:
            if text.isspace():
                return
            self.current = _Block(self.at)
        self.current.parts.append(text)
        if not self.links and self.current.linked and not text.isspace():
            self.current.linked = False

    def _end(self) -> None:
        block, self.current = self.current, None
        self.unheard.clear()
        if block is not None:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                if block.linked:
                    block.path = self._path(block.path, "a")
                self.blocks.append(block)

    def _close(self, node: _Node) -> None:
        """End ``node``, which is open, and all inside it."""
        while True:
            self.open[self.at.tag] -= 1
            last, self.at = self.at, self.at.parent
            if last is node:
                return

    def _start(self, tag: str, about: str) -> None:
        if tag == "body":
            while self.at.parent is not None and self.at.tag != "html":
                self._close(self.at)
        if tag in CLOSES_P and self.at.scopes[-1] is not None:
            self._close(self.at.scopes[-1])
        if tag in ENDS and self.at.scopes[ENDS[tag]] is not None:
            self._close(self.at.scopes[ENDS[tag]])
        up = self.at
        hint, hidden = _hints(about) if about.strip() else ("", False)
        marked = tag not in ("body", "html", "article", "main") and not HINT_WORDS.isdisjoint(hint.split())
        node = _Node(tag, up, self._path(up.path, f"!{tag}" if marked else tag))
        node.article = up.article or tag in ("article", "main")
        node.dropped = up.dropped or tag in DROPPED or hidden or (tag == "header" and not up.article)
        node.hinted = up.hinted or tag in ("article", "main") or bool(ARTICLE_HINT.search(hint))
        node.marked = marked
        node.marker = node if marked else up.marker
        node.listed = node if tag in LISTS else up.listed
        if tag in SCOPED:
            scopes = list(up.scopes)
            for i, (kinds, bounds) in enumerate(SCOPES):
                if tag in bounds:
                    scopes[i] = None
                if tag in kinds and scopes[i] is None:
                    scopes[i] = node
            scopes[-1] = node if tag == "p" else None if tag in SECTION else scopes[-1]
            node.scopes = tuple(scopes)
        self.nodes.append(node)
        self.at = node
        self.open[tag] = self.open.get(tag, 0) + 1

    def _read(self, page: str) -> None:
        for text, tag, closes, about, _ in walk(page, RAW_END):
            self._add(text)
            if not tag:
                continue
            if tag == "br":
                self._add(" ")
            elif tag in INLINE and tag not in RAW:
                self._inline(tag, closes, about)
            elif closes:
                self._end()
                if self.open.get(tag):
                    while self.at.tag != tag:
                        self._close(self.at)
                    self._close(self.at)
            else:
                self._end()
                if tag not in VOID and (tag not in RAW or about.endswith("/")):
                    self._start(tag, about)
        self._end()

    def _inline(self, tag: str, closes: bool, about: str) -> None:
        if tag == "a":
            self.links = 0 if closes else 1
        if self.unheard:
            if tag == self.unheard[-1]:
                self.unheard.pop() if closes else self.unheard.append(tag)
        elif not closes and about.strip() and not INLINE_ADVERTS.isdisjoint(_hints(about)[0].split()):
            self.unheard.append(tag)

    def under(self, nodes) -> dict[_Node, int]:
        """How many of ``nodes`` each element holds."""
        held: dict[_Node, int] = {}
        for x in nodes:
            held[x] = held.get(x, 0) + 1
        for x in reversed(self.nodes):  # elements follow those they are in
            if x.parent is not None and x in held:
                held[x.parent] = held.get(x.parent, 0) + held[x]
        return held


def _scores(page: _Page, found: list[_Block]) -> dict[int, float]:
    """Mean smoothed value of every tag path: the fused ratios of its text and punctuation."""
    by: dict[int, list[_Block]] = {}
    for b in found:
        by.setdefault(b.path, []).append(b)
    value = {}
    for name, own in by.items():
        lengths = [len(b.text) for b in own]
        marks = [len(PUNCTUATION.findall(b.text)) for b in own]
        ratio, punct = sum(lengths) / len(own), sum(marks) / len(own)
        spread = math.sqrt(sum((x - ratio) ** 2 for x in lengths) / len(own))
        spread_marks = math.sqrt(sum((x - punct) ** 2 for x in marks) / len(own))
        value[name] = (ratio + spread) * math.log2(2 + punct + spread_marks)
    # Neighbours are siblings; what is marked as no part of an article is no sibling of what isn't.
    line, above = [value[b.path] for b in found], [b.path if b.node.marked else page.above[b.path] for b in found]
    sums: dict[int, list[float]] = {}
    half = len(SMOOTH) // 2
    for i, b in enumerate(found):
        near = [(line[j], SMOOTH[j - i + half]) for j in range(max(0, i - half), min(len(line), i + half + 1)) if above[j] == above[i]]
        sums.setdefault(b.path, []).append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return {name: sum(v) / len(v) for name, v in sums.items()}


def _limit(score: dict[int, float], pool: list[_Block]) -> float:
    values = [score[b.path] for b in pool]
    mean = sum(values) / len(values)
    return THRESHOLD * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def _unmarked(page: _Page, pool: list[_Block]) -> tuple[list[_Block], set[_Node]]:
    """``pool`` without marked elements, and lists of links, in which no path scores as high as the mean of the blocks outside them; and these elements."""
    count: dict[_Node, int] = {}
    plain: dict[_Node, int] = {}
    for b in pool:
        if b.node.listed is not None:
            count[b.node.listed] = count.get(b.node.listed, 0) + 1
            plain[b.node.listed] = plain.get(b.node.listed, 0) + (not b.linked)
    suspects = {x for x in page.nodes if x.marked} | {x for x in count if count[x] > 1 and not plain[x]}
    if not suspects:
        return pool, set()
    score = _scores(page, pool)
    # Of the blocks an element holds: how many, the sum and the most of their scores.
    held: dict[_Node, tuple] = {}
    for b in pool:
        n, total, most = held.get(b.node, (0, 0.0, 0.0))
        held[b.node] = n + 1, total + score[b.path], max(most, score[b.path])
    for x in reversed(page.nodes):
        if x.parent is not None and x in held:
            n, total, most = held.get(x.parent, (0, 0.0, 0.0))
            held[x.parent] = n + held[x][0], total + held[x][1], max(most, held[x][2])
    every, whole, _ = held[page.root]
    low: set[_Node] = set()
    for x in page.nodes:
        n, total, most = held.get(x, (0, 0.0, 0.0))
        if x.parent in low or (x in suspects and 0 < n < every and most < (whole - total) / (every - n)):
            low.add(x)
    return [b for b in pool if b.node not in low], low


def _chosen(page: _Page, pool: list[_Block]) -> list[_Block]:
    """The blocks of the paths that reach the threshold."""
    score = _scores(page, pool)
    limit = _limit(score, pool)
    return [b for b in pool if score[b.path] >= limit]


def content(text: str | None) -> str:
    """Main text: blocks joined by an empty line; empty if there is none."""
    page = _Page(text or "")
    if not page.blocks:
        return ""
    pool, low = _unmarked(page, page.blocks)
    chosen = _chosen(page, pool)
    holder = _container(page, chosen)
    if (holder.tag in ("", "html", "body") or holder.marker is not None) and (hinted := [b for b in pool if b.node.hinted]) and len(hinted) < len(pool):
        # The ratios name no single place, or one marked as no part of an article: one that is marked as an article decides if it holds most of the unmarked text chosen.
        plain = [b for b in chosen if b.node.marker is None] or [b for b in pool if b.node.marker is None]
        if 2 * sum(len(b.text) for b in plain if b.node.hinted) > sum(len(b.text) for b in plain):
            pool = hinted
            chosen = _chosen(page, pool)
            holder = _container(page, chosen)
    content_paths = {b.path for b in chosen}
    if holder.tag in ("", "html", "body"):
        # No container of its own: from the first to the last chosen block.
        within = [i for i, b in enumerate(pool) if b.path in content_paths]
    else:
        inside = {holder}
        for x in page.nodes:
            if x.parent in inside:
                inside.add(x)
        own = {id(b) for b in pool}
        pool = [b for b in page.blocks if id(b) in own or (b.node.marker is None and b.node not in low)]
        within = [i for i, b in enumerate(pool) if b.node in inside]
    return "\n\n".join(b.text for b in pool[_headed(pool, within[0], holder) : within[-1] + 1])


def _container(page: _Page, chosen: list[_Block]) -> _Node:
    """The deepest element that holds all chosen blocks, an article or main element as a whole; never a part of a list, table or quotation."""
    held = page.under(b.node for b in chosen)
    holder = page.root
    for x in page.nodes:  # those that hold all are in a line, from the outside in
        if x.parent is holder and held.get(x) == len(chosen) and x.tag in HOLDERS:
            holder = x
            if x.tag in ("article", "main"):
                break
    return holder


def _headed(pool: list[_Block], first: int, holder: _Node) -> int:
    """Where the text starts: at the headings that stand beside the container or one around it, with what follows them."""
    if holder.tag in ("article", "main"):
        return first
    around, x = set(), pool[first].node.parent
    while x is not None:
        around.add(x)
        x = x.parent
    beside = [(-b.node.depth, i) for i, b in enumerate(pool[:first]) if b.node.tag in HEADINGS and b.node.parent in around]
    if beside:
        return min(beside)[1]
    return first - (first > 0 and pool[first - 1].node.tag in HEADINGS)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = [content(page.as_py()) for page in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (main text of the whole html), n_chars (its code points).

    Null html counts as empty; pages without text give an empty text. Broken
    markup is read as far as it goes: unclosed elements end where HTML lets them
    end, an unclosed comment or script runs to the end. Repeated pages each get
    a row; null ids stay null; paths of one score are chosen or left together;
    pages of any length are taken whole, in time linear in it; other columns are
    not read; an empty table gives no rows.
    """
    rows = pages.select(whole_ids(pages, id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
