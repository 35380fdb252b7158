"""HTML extraction: a site's pages merged into a style tree, and branches of low importance removed."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.materialize import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Elements of HTML, by what they mean for text (fixed values).
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rtc rp s samp small span strike strong sub sup time tt u var".split())
# Elements whose role is never main text, and words that say so in class, id or role (fixed values).
ASIDE = frozenset("nav header footer aside form button menu dialog".split())
HEADS = "header masthead banner".split()
ROLES = (
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer footer form login menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary "
    "contentinfo dialog disqus respond replies alert".split())
MAIN = ("article", "main")
# Implied ends: a start of the first closes an open one of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BARRIER = frozenset("ul ol dl table td th article section div main aside nav header footer blockquote body html".split())
ROOMS = BARRIER - {"td", "th"}
BREAK = re.compile(r"[-_\s]+")
# Inside an article a word above has to be a whole token of class or role, or one of these compounds (fixed values).
COMPOUNDS = frozenset(
    "ad-banner ad-container ad-slot ad-unit alert-box comment-form comment-list comments-area comments-section cookie-banner cookie-consent cookie-notice login-form newsletter-form newsletter-signup "
    "page-navigation popup-overlay post-comments post-navigation related-articles related-links related-posts related-stories search-box search-form share-bar share-buttons share-links sharing-buttons "
    "sidebar-widget signup-form social-buttons social-icons social-links social-media social-share sponsored-content subscribe-form".split())


def _says_aside(kind: str, own: str, role: str, main: bool) -> bool:
    """Whether class, id or role say that an element is no main text; inside an article an id, made from a heading's words perhaps, says nothing."""
    if main:
        tokens = f"{kind} {role}".lower().split()
        return any(x in ROLES or x.replace("_", "-") in COMPOUNDS for x in tokens)
    words = set(BREAK.split(f"{kind} {own} {role}".lower()))
    return not words.isdisjoint(ROLES) or not words.isdisjoint(HEADS)


def _path(parent: int, style: str) -> int:
    return xxhash.xxh64_intdigest(style, parent)


class Page:
    """A page's blocks (path of styles, aside, main, text) in order, and the shape (child styles) of each element."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[int, bool, bool, str]] = []
        self.shapes: list[tuple[int, int]] = []
        # Of open elements: name, path, aside, main, children so far as one number.
        self.open: list[list] = [["", 0, False, False, 0]]
        self.held: list[str] = []
        self._read(html)
        self._end_block()
        self._drop(1)

    def _end_block(self) -> None:
        text = " ".join(unescape("".join(self.held)).split())
        self.held.clear()
        if text:
            # A block belongs to the element around it that is not inline.
            _, path, aside, main, _ = next(x for x in reversed(self.open) if x[0] not in INLINE)
            self.blocks.append((path, aside, main, text))

    def _drop(self, at: int) -> None:
        self.shapes += [(x[1], x[4]) for x in self.open[at:] if x[0] not in INLINE]
        del self.open[at:]

    def _start(self, name: str, attributes: str) -> None:
        around = self.open[-1]
        if name in INLINE:
            self.open.append([name, around[1], around[2], around[3], 0])
            return
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        kind = found.get("class", "")
        style = ".".join([name, *sorted(kind.lower().split())])
        around[4] = _path(around[4], style)
        main = around[3] or name in MAIN or found.get("role", "").lower() == "main"
        own, role = found.get("id", ""), found.get("role", "")
        hidden = "hidden" in attributes.lower().split() or "display:none" in found.get("style", "").replace(" ", "").lower()
        aside = around[2] or hidden or name in ASIDE and not (name == "header" and main) or bool(kind or own or role) and _says_aside(kind, own, role, main)
        self.open.append([name, _path(around[1], style), aside, main, 0])

    def _close(self, names: tuple[str, ...], barrier: frozenset[str]) -> None:
        """Close the innermost open element of these, looking no further than a barrier."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in names:
                self._drop(i)
                return
            if self.open[i][0] in barrier:
                return

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            sign = html.find("<", at)
            self.held.append(html[at:sign if sign >= 0 else n])
            if sign < 0:
                return
            found = TOKEN.match(html, sign)
            at = found.end()
            closing, name, attributes = found.groups()
            if name is None:
                if found.group() == "<":
                    self.held.append("&lt;")
                continue
            name = name.lower()
            if name in ("br", "wbr"):
                self.held.append(" " if name == "br" else "")
                continue
            if name not in INLINE:
                self._end_block()
            if closing:
                self._close((name,), BARRIER - {name} if name in INLINE or name in ("p", "li") else frozenset())
            elif name in RAW:
                # What is inside is not markup: go on after its end.
                self.open[-1][4] = _path(self.open[-1][4], name)
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            elif name not in VOID:
                if name in ENDS_P:
                    self._close(("p",), BARRIER)
                if name in CLOSES:
                    self._close(CLOSES[name], ROOMS)
                self._start(name, attributes)


def host(url: Column) -> Column:
    """Host of an address in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _parsed(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[Page]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            yield part, [Page(x or "") for x in part.column(at).to_pylist()]


def style_tree(pages: DataFrame, weight: float = 0.9) -> DataFrame:
    """host, path, importance of every node of each site's merged tree.

    Elements of a host's pages with equal paths (names and classes from the root) are
    one node. The importance of what it shows is the entropy of the texts of its
    blocks over all pages, of how it shows it the entropy of its child styles, each
    divided by the greatest that so many could have: 0 where all are alike, 1 where
    all differ. Pages of a host with the same blocks and shapes count once, and a node
    that only one such page has has importance 1.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, parsed in _parsed(batches, 1):
            # Of every page: the number of its blocks, then the paths and then the values of blocks and shapes.
            held = [np.array([len(x.blocks), *(b[0] for b in x.blocks), *(s[0] for s in x.shapes), *(xxhash.xxh64_intdigest(b[3]) for b in x.blocks), *(s[1] for s in x.shapes)], np.uint64).tobytes() for x in parsed]
            page = np.array([xxhash.xxh64_intdigest(x) for x in held], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(page), pa.array(held, pa.binary())], ["host", "page", "held"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, pages = Counter(), Counter()
            for site, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, *both = np.frombuffer(held, np.int64).tolist()
                paths, values = both[:len(both) // 2], both[len(both) // 2:]
                nodes = [(site, path, at < blocks, value) for at, (path, value) in enumerate(zip(paths, values, strict=True))]
                found.update(nodes)
                # A page counts once at a node, with the first of what it shows there.
                pages.update({x[:3]: x for x in reversed(nodes)}.values())
            if found:
                site, path, content, value = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(site, pa.string()), pa.array(path, pa.int64()), pa.array(content), pa.array(value, pa.int64()),
                    pa.array(list(found.values()), pa.int64()), pa.array([pages[x] for x in found], pa.int64())], ["host", "path", "content", "value", "n", "pages"])

    # Copies of a page say nothing about its site: each distinct page counts once.
    distinct = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(read, "host string, page long, held binary").dropDuplicates(["host", "page"])
    counts = distinct.select("host", "held").mapInArrow(count, "host string, path long, content boolean, value long, n long, pages long")
    values = counts.groupBy("host", "path", "content", "value").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    nodes = values.groupBy("host", "path", "content").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.ln("n")).alias("inner"), F.sum("pages").alias("pages"))
    spread = F.when(F.col("pages") > 1, (F.ln("all") - F.col("inner") / F.col("all")) / F.ln("all")).otherwise(1.0)
    both = nodes.groupBy("host", "path").agg(F.max(F.when(F.col("content"), spread)).alias("text"), F.max(F.when(~F.col("content"), spread)).alias("shape"))
    return both.select("host", "path", (F.lit(weight) * F.coalesce("text", "shape") + F.lit(1 - weight) * F.coalesce("shape", "text")).alias("importance"))


def extract_text(pages: DataFrame, least: float = 0.2) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    The pages of a host are merged into a style tree (``style_tree``), and the blocks
    of nodes with an importance under ``least`` are removed from each page: texts
    that a site repeats. Elements whose name, class, id or role says what they are
    need no statistics: menus, headers, footers, sidebars, notices, adverts, forms
    and comments have importance 0 with all below them, and what is inside of an
    article or main element has 1 unless it is one of these. Where a page has such an
    element with text, only its blocks are main text.

    Scripts, styles and markup give no text; character references are decoded; white
    space within a block, line breaks too, becomes one space; blocks are joined in
    order by two newlines.

    Defined cases: null, empty or textless pages give an empty text; text that isn't
    HTML is one block; pages without a host form a site of their own; unclosed
    elements end where HTML implies it or with the page; repeated rows give repeated
    results; only page_id, url and html are read; an empty table gives no rows.
    """
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    dull = style_tree(held).where(F.col("importance") < least).groupBy("host").agg(F.collect_list("path").alias("dull"))
    # Written down, so that Spark knows its size and chooses the join by it.
    dull = materialize(dull)
    joined = held.withColumn("host", host(F.col("url"))).join(dull, "host", "left").select("page_id", "url", "html", "dull")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, parsed in _parsed(batches, 2):
            texts = [_main_text(page, set(x or ())) for page, x in zip(parsed, part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = joined.mapInArrow(clean, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def _main_text(page: Page, dull: set[int]) -> str:
    own = [(main, text) for path, aside, main, text in page.blocks if not aside and (main or (path - (1 << 64) if path >> 63 else path) not in dull)]
    if any(main for main, _ in own):
        own = [x for x in own if x[0]]
    return "\n\n".join(text for _, text in own)
