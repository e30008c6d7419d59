"""Main text of web pages, with site templates removed by counting.

A page is read once into text blocks and element subtrees.  A subtree has two hashes: one of its tag, class, id and
everything below it with the text, and one of its shape alone, tags, classes and ids without text, links or repetitions,
by which menus, notices and advert boxes whose words change from page to page are still the same.  A page's main element
is the innermost one with more than half of its text; without one, its <article> and <main>.  Spark counts, per host, on
how many different pages (equal ones count once) each subtree occurs outside the main element, and each shape inside it.
What occurs outside on MIN_PAGES pages or more, and on more than inside, is the site's template and is deleted wherever
it stands.  No text decides by its words, and <article>, <main> and paragraphs, headings, quotations and preformatted
text by their shape, never; nor are they by their text inside an <article> or <main>, where pages quote from one another.

HTML's own marks go on every page: menus, headers and footers of the page, sidebars, forms, hidden elements, scripts, and
elements whose class or id says that they hold readers' comments; but none that holds an <article> or <main>.  On hosts
of fewer than SURE_PAGES pages, where counts say little, elements go by the words of their class or id as well, and if
<article> and <main> hold more than half of what is left, only they count.

Defined cases: null or empty html has empty text; null url belongs to the host ''; unclosed and misnested tags close as
browsers close them (a new block ends an open paragraph); a page without main text has text ''; repeated rows stay; a
subtree on just MIN_PAGES pages goes; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

MIN_PAGES = 10
#: Different pages of a host from which counts alone tell its template.
SURE_PAGES = 30
#: Template hashes that are sent to every task; above, each page gets its own by a join of its subtrees.
BROADCAST_HASHES = 500_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
_NAME = re.compile(r"[a-z]+")
_MARKUP = re.compile(r"<[^>]*>")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "math", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: What HTML itself marks as no main text.
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "object", "canvas", "audio", "video", "fieldset", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog"}
HOLDERS = {"article", "main"}
PROSE = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre"}
#: Elements that are a box of the page by their tag; others have a shape only with a class, an id or a link.
BOXES = {"nav", "header", "footer", "aside", "form"}
COMMENTS = frozenset("comment comments disqus replies respond".split())
NOISE = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended"
    " footer header masthead widget toolbar login signup copyright pagination pager skip".split()
)
#: Words beside one of NOISE that leave a class or id what it is: site-footer is one, has-sidebar and related-work aren't.
NEUTRAL = frozenset("site page main top bottom left right box container wrap wrapper list bar section block area inner outer primary secondary global item items link links unit slot column col content text post posts article articles entry user reader fixed sticky".split())


class _Node:
    __slots__ = ("tag", "sign", "kind", "muted", "in_article", "parts", "shape", "named", "holds", "first")

    def __init__(self, tag: str, sign: str, kind: str, muted: bool, in_article: bool, first: int) -> None:
        self.tag, self.sign, self.kind, self.muted, self.in_article, self.first = tag, sign, kind, muted, in_article, first
        self.parts: list[str] = []
        self.shape: list[str] = []
        self.named = bool(sign) or tag in BOXES
        self.holds = tag in HOLDERS


def _kind(tag: str, attrs: str) -> tuple[str, str]:
    """What of the attributes counts for the hashes, and what they tell: 'gone', 'noise' or nothing."""
    if not attrs or attrs.isspace():
        return "", ""
    sign, kind = [], ""
    for name, a, b, c, alone in _ATTR.findall(attrs):
        name, value = (name or alone).lower(), a or b or c
        if name in ("class", "id"):
            sign.append(f"{name}={value}")
            if tag not in HOLDERS and tag not in ("html", "body"):
                for words in map(_NAME.findall, value.lower().split()):
                    if not NOISE.isdisjoint(words) and all(w in NOISE or w in NEUTRAL for w in words):
                        kind = "gone" if kind == "gone" or not COMMENTS.isdisjoint(words) else "noise"
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            kind = "gone"
    return " ".join(sign), kind


@dataclass
class Page:
    """Blocks in page order: their texts, and whether each stands in an article; ranges of blocks of elements."""

    blocks: list[tuple[str, bool]]
    exact: list[tuple[int, int, int]]  # hash, first block, block after the last: subtrees that text can mark as template
    shapes: list[tuple[int, int, int]]  # the same of those that shape can
    boxes: list[tuple[int, int]]  # containers, inner ones first
    gone: list[tuple[int, int]]  # never main text
    noise: list[tuple[int, int]]  # no main text by the words of class or id

    def free(self, *lists: list[tuple[int, int]]) -> list[bool]:
        """Whether each block stands in none of these ranges."""
        edge = [0] * (len(self.blocks) + 1)
        for a, b in (x for some in lists for x in some):
            edge[a] += 1
            edge[b] -= 1
        return [depth == 0 for depth in accumulate(edge[:-1])]

    def main(self) -> list[tuple[int, int]]:
        """The ranges of the main element."""
        upto = [0, *accumulate(len(text) * free for (text, _), free in zip(self.blocks, self.free(self.gone), strict=True))]
        most = [(upto[b] - upto[a], i) for i, (a, b) in enumerate(self.boxes) if 2 * (upto[b] - upto[a]) > upto[-1]]
        if most:
            return [self.boxes[min(most)[1]]]
        return [(i, i + 1) for i, (_, inside) in enumerate(self.blocks) if inside]

    def counted(self) -> tuple[list[int], list[int]]:
        """The hashes that occur outside the main element, and the shapes inside it; without one, texts only."""
        outside, inside = {h for h, _, _ in self.exact}, set()
        if main := self.main():
            free = [0, *accumulate(self.free(main))]
            for h, a, b in self.shapes:
                (outside if free[b] - free[a] == b - a else inside).add(h)
        return sorted(outside), sorted(inside)


def read_page(html: str) -> Page:
    page = Page([], [], [], [], [], [])
    blocks = page.blocks
    stack = [_Node("", "", "", False, False, 0)]
    opened: Counter = Counter()
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                stack[-1].parts.append(text)
                blocks.append((text, stack[-1].in_article))

    def put(text: str) -> None:
        if not stack[-1].muted:
            run.append(text)

    def close() -> None:
        flush()
        node, up = stack.pop(), stack[-1]
        opened[node.tag] -= 1
        tag = node.tag
        if node.parts or tag not in INLINE:
            digest = xxhash.xxh64_intdigest("\x1f".join((tag, node.sign, *node.parts)).encode("utf-8", "surrogatepass"))
            up.parts.append(f"{digest:x}")
        up.holds = up.holds or node.holds
        up.named = up.named or node.named or tag == "a"
        if tag in INLINE:
            return
        form = f"{tag} {node.sign}({' '.join(node.shape)})"
        shape = xxhash.xxh64_intdigest(form.encode("utf-8", "surrogatepass"), 1)
        if (short := f"{shape:x}") != (up.shape[-1] if up.shape else ""):
            up.shape.append(short)
        a, b = node.first, len(blocks)
        if b == a:
            return
        if not node.holds:
            if node.kind == "gone" or tag in DROPPED and not (tag == "header" and node.in_article):
                page.gone.append((a, b))
            elif node.kind == "noise":
                page.noise.append((a, b))
        if tag in ("html", "body"):
            return
        if tag not in PROSE:
            page.boxes.append((a, b))
        if node.holds:
            return
        if not (node.in_article and tag in PROSE):
            page.exact.append((digest - (1 << 63), a, b))
        if node.named and tag not in PROSE:
            page.shapes.append((shape - (1 << 63), a, b))

    def open_(tag: str, attrs: str) -> None:
        up = stack[-1]
        sign, kind = _kind(tag, attrs)
        opened[tag] += 1
        stack.append(_Node(tag, sign, kind, up.muted or bool(kind) and tag in INLINE, up.in_article or tag in HOLDERS, len(blocks)))

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if not m:
            put(html[at:])
            break
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag not in INLINE:
                flush()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if opened[tag] else 0
            while depth and len(stack) > depth:
                if stack[-1].tag in INLINE and tag in INLINE:
                    stack[-2].parts += stack[-1].parts
                    stack[-2].named = stack[-2].named or stack[-1].named or stack[-1].tag == "a"
                    opened[stack.pop().tag] -= 1
                else:
                    close()
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            inner, at = html[at : over.start() if over else end], over.end() if over else end
            if tag == "math":
                put(_MARKUP.sub("", inner))
            elif tag == "xmp":
                flush()
                put(inner.replace("&", "&amp;"))
                flush()
            continue
        if tag == "br":
            put(" ")
        if tag in INLINE:
            if tag not in VOID:
                open_(tag, m[3])
            continue
        flush()
        if tag in VOID:
            continue
        # what a new block ends: an open paragraph, the item, cell or option before it
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i].tag
            if t == "p" or t in ends:
                while len(stack) > i:
                    close()
            elif t not in INLINE and not (ends and t not in ("ul", "ol", "dl", "table", "select")):
                break
        open_(tag, m[3])
    while len(stack) > 1:
        close()
    flush()
    return page


def main_text(html: str, template: set[int], sure: bool = False) -> str:
    """sure: whether the page's host has SURE_PAGES pages."""
    page = read_page(html)
    deleted = [(a, b) for h, a, b in (*page.exact, *page.shapes) if h in template]
    free = page.free(page.gone, deleted) if sure else page.free(page.gone, deleted, page.noise)
    left = [x for x, f in zip(page.blocks, free, strict=True) if f]
    if not sure and 2 * sum(len(t) for t, inside in left if inside) > sum(len(t) for t, _ in left):
        left = [x for x in left if x[1]]
    return "\n".join(text for text, _ in left)


def _with_host(pages: DataFrame, *names: str) -> DataFrame:
    """Those columns, the host, and page: the html's hash."""
    host = F.lower(F.coalesce(F.regexp_extract(F.trim("url"), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1), F.lit("")))
    return C.pick(pages, *names).withColumns({"host": host, "page": F.xxhash64(F.coalesce("html", F.lit("")))})


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, outside, inside): the hashes of each page's subtrees."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 500):
            own = [read_page(html or "").counted() for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in own], pa.list_(pa.int64())) for i in (0, 1))], ["host", "page", "outside", "inside"])

    rows = _with_host(pages, "url", "html").select("host", "page", "html")
    return C.stored(rows.mapInArrow(task, "host string, page long, outside array<long>, inside array<long>"), "trees")


def _pages(trees: DataFrame) -> DataFrame:
    """(host, page, n, outside, inside): each different page of a host once, and its rows."""
    return trees.groupBy("host", "page").agg(F.count(F.lit(1)).alias("n"), F.first("outside").alias("outside"), F.first("inside").alias("inside"))


def templates(trees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, tree, pages): the subtrees that recur outside the main element on so many pages of the host, and on more than inside.

    Counted by (host, tree), so that a hot host's subtrees are combined before the shuffle and spread over all tasks.
    """
    each = F.explode(F.concat(F.transform("outside", lambda t: F.struct(t.alias("tree"), F.lit(1).alias("o"))), F.transform("inside", lambda t: F.struct(t.alias("tree"), F.lit(0).alias("o")))))
    counts = _pages(trees).select("host", each.alias("t")).groupBy("host", "t.tree").agg(F.sum("t.o").alias("pages"), F.sum(1 - F.col("t.o")).alias("inside"))
    return counts.where((F.col("pages") >= min_pages) & (F.col("pages") > F.col("inside"))).select("host", "tree", "pages")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, few: int = BROADCAST_HASHES, sure_pages: int = SURE_PAGES) -> DataFrame:
    """Per page of pages (page_id, url, html): page_id, url, text, n_chars."""
    trees = subtrees(pages)
    known = C.stored(templates(trees, min_pages), "templates")
    sure = C.stored(_pages(trees).groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n")).where(F.col("pages") >= sure_pages), "hosts")
    size = known.count() + sure.count()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 500):
            texts = [main_text(html or "", set(hashes or ()), bool(many)) for html, hashes, many in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = _with_host(pages, "page_id", "url", "html")
    if not size:
        joined = rows.withColumns({"hashes": F.array().cast("array<long>"), "many": F.lit(False)})
    elif size <= few:
        own = known.groupBy("host").agg(F.collect_list("tree").alias("hashes")).join(sure.select("host", F.lit(True).alias("many")), "host", "full_outer")
        joined = rows.join(F.broadcast(own), "host", "left")
    else:
        # each page's own templates: its subtrees meet the counted ones, those of hot hosts without a shuffle on their key
        each = _pages(trees).select("host", "page", F.explode(F.array_union("outside", "inside")).alias("tree"))
        met = C.join_spread(each, known.withColumn("yes", F.lit(True)), ["host", "tree"], "pages", each.count(), "page").where("yes")
        own = met.groupBy("host", "page").agg(F.collect_list("tree").alias("hashes"))
        own = C.join_spread(_pages(trees).select("host", "page", "n").join(own, ["host", "page"], "left"), sure.drop("pages").withColumn("many", F.lit(True)), ["host"], "n", sure.agg(F.sum("n")).first()[0] or 0, "page")
        joined = C.join_spread(rows, C.stored(own, "own-templates"), ["host", "page"], "n", trees.count(), "page_id", "url")
    return joined.select("page_id", "url", "html", "hashes", "many").mapInArrow(task, "page_id long, url string, text string, n_chars long")
