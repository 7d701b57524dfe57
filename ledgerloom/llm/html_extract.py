"""HTML extraction (operator 7): site template removal.

A page is parsed once into elements and text blocks. Every block-level subtree
that holds text - of menus, footers and sidebars as of the article - is hashed
with its tags and text, Spark counts the hashes over the pages of a host (pages
with equal html once), and subtrees that recur on at least ``min_pages`` pages are
deleted, however many pages the host has: a section's own template goes on a large
host, too. Inside an article or main element that holds for div, section, list
and other elements with parts; a single paragraph, heading, list item, cell or
quotation there may be a line that many articles quote, and must recur on
``line_pages`` pages. There, and on pages without such an element, pages with the
same h1 (without one, with equal text) count once, so that the versions of an
article do not make its text a template; where a site has one h1 for all its
articles, nothing inside them recurs. The html, body, article and main elements
themselves are never templates.

What stands on few pages of its host cannot be counted. There the elements decide
whose kind the contract names: nav, header and footer of the page, aside, form,
script and the like, hidden parts, and elements one of whose class, id or role
names says so: a name does if it consists of such a word (``MARKS``), alone or
with words of layout (``LAYOUT``): "cookie-banner" or "share-buttons", but not
"share-prices". Of the blocks left, those inside article or main elements are the
text if they hold at least half of its characters, else all blocks are: an article
element may be a teaser beside the text.

Blocks: text between the borders of block-level elements, character references
decoded, white space (line breaks and <br> too) turned into single spaces,
trimmed; empty blocks vanish, the others are joined by two line feeds.

Defined results: null or empty html, and pages without text, give ''; cut-off
markup is read as far as it goes; a null url is a host of its own; repeated rows
get a row each; other columns are ignored.

Scale: the parser is linear in the page and keeps its own stack, so depth does
not matter. Counting shuffles (host, hash) with a map-side sum, so a hot host is
no hot task; pages themselves move only if more than ``broadcast_rows`` pages
hold template subtrees.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common as C
from ledgerloom.llm.order_minhash import broadcast_if_small

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never article text.
NEVER = frozenset("head script style template noscript svg math iframe object embed canvas audio video nav aside footer form button select option datalist input textarea label dialog menu search title".split())
#: Words that name such elements in class, id and role; and words of layout that may stand beside them.
MARKS = frozenset(
    "nav navbar navigation menu sidebar aside ad ads adv advert adverts advertisement advertising banner promo promoted sponsor sponsored cookie cookies consent gdpr notice notices "
    "popup modal newsletter subscribe subscription signup login comment comments commentlist disqus reply replies share sharing breadcrumb breadcrumbs "
    "pagination pager related recommended toolbar footer contentinfo complementary search form dialog".split()
)
LAYOUT = frozenset(
    "site main top bottom left right side upper lower inner outer primary secondary global local page post posts article articles blog content social box bar block button buttons list links link "
    "item items container wrapper wrap widget section area row col column panel group holder slot unit text header head body title overlay the my js is has mobile desktop sticky fixed".split()
)
OUTSIDE = frozenset("header masthead topbar".split())
#: What marks an article element as none; elements that are never templates.
ARTICLES = frozenset("comment comments reply ad ads advert sponsored promo".split())
WHOLE = frozenset("html body article main".split())
#: Single lines, which articles may share without a template.
LINES = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th tr".split())
#: A start tag of the first kind ends an open element of the second.
ENDS_P = BLOCK - frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"))
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = frozenset(("table", "ul", "ol", "dl", "select", "article", "section", "div", "aside", "nav", "main", "body", "td", "th", "blockquote", "form", "header", "footer"))

_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"</?([A-Za-z][^\s/>]*)([^>]*+)>")
_MARK = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@functools.lru_cache(10_000)
def marked(names: str) -> bool:
    """Whether a name of class, id or role says that its element is no article text."""
    for name in names.split():
        words = set(_WORDS.findall(name))
        if words & MARKS and words <= MARKS | LAYOUT:
            return True
    return False


class Page:
    """Blocks of a page, (text, number of the block-level element around it, inside an article, left out by its kind), and the hashes of its elements."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[str, int, bool, bool]] = []
        self._parts: tuple[list[str], list[str]] = ([], [])  # of the open block: text that counts, text left out
        self._hash: list[int] = [0]
        self._parent: list[int] = [0]
        self._tag: list[str] = ["#"]
        self._within: list[bool] = [False]  # is the element inside an article, which it is not itself
        self._count: Counter[str] = Counter()  # open elements by tag
        # Open elements: (tag, number, left out, inside an article, pieces to hash)
        self._open: list[tuple[str, int, bool, bool, list[bytes]]] = [("#", 0, False, False, [])]
        self._has_article = False
        self._read(html)
        self._border()
        while len(self._open) > 1:
            self._close()

    def hashes(self) -> tuple[set[int], set[int], set[int]]:
        """Of the block-level subtrees that hold text: those outside an article of a page that has one, parts, and single lines of an article."""
        seen, outer, parts, lines = {0}, set(), set(), set()
        for _, n, _, _ in self.blocks:
            while n not in seen:
                seen.add(n)
                if self._tag[n] not in WHOLE:
                    own = outer if self._has_article and not self._within[n] else lines if self._has_article and self._tag[n] in LINES else parts
                    own.add(self._hash[n])
                n = self._parent[n]
        return outer, parts, lines

    def key(self) -> int:
        """Hash of the article's, or the page's, first h1; of the text where there is none."""
        import xxhash

        own = [(t, n) for t, n, inside, out in self.blocks if not out and (inside or not self._has_article)]
        name = next((t for t, n in own if self._tag[n] == "h1"), None)
        text = "\n\n".join(t for t, _ in own) if name is None else name
        return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))

    def without(self, templates: set[int] | frozenset[int]) -> tuple[list[str], int]:
        """Texts of the main text's blocks around which no subtree is a template, and the number of blocks of the page in templates."""
        gone = [False] * len(self._hash)
        if templates:
            for n in range(1, len(gone)):  # parents have smaller numbers
                gone[n] = gone[self._parent[n]] or (self._hash[n] in templates and self._tag[n] not in WHOLE)
        left = [(t, inside) for t, n, inside, out in self.blocks if not out and not gone[n]]
        main = [t for t, inside in left if inside]
        if 2 * sum(map(len, main)) < sum(len(t) for t, _ in left):
            main = [t for t, _ in left]
        return main, sum(gone[n] for _, n, _, _ in self.blocks)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                return
            if lt > at:
                self._text(html[at:lt])
            after = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif after in ("!", "?"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            elif after == "/" or after.isalpha():
                m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
                if m is None:
                    if after != "/" or html[lt + 2 : lt + 3].isalpha():
                        return  # a tag that the page's end cuts off
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                    continue
                tag, at = m[1].lower(), m.end()
                if after == "/":
                    self._end(tag)
                    continue
                self._start(tag, m[2])
                if tag in RAW and not m[2].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                    at = n if end is None else end.start()
            else:
                self._text("<")
                at = lt + 1

    def _text(self, raw: str) -> None:
        top = self._open[-1]
        text = unescape(raw) if "&" in raw else raw
        if top[0] not in RAW:
            self._parts[top[2]].append(text)
        if text and not text.isspace():
            top[4].append(" ".join(text.split()).encode("utf-8", "surrogatepass"))

    def _border(self) -> None:
        for out, parts in enumerate(self._parts):
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((text, self._around(), self._open[-1][3], bool(out)))
                parts.clear()

    def _around(self) -> int:
        for _, n, *_ in reversed(self._open):
            if n:
                return n
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._parts[self._open[-1][2]].append(" ")
            return
        if tag in BLOCK:
            self._border()
            if tag in ENDS_P:
                self._end_open(("p",))
            if tag in SIBLINGS:
                self._end_open(SIBLINGS[tag])
        if tag in VOID:
            return
        _, _, out, inside, _ = self._open[-1]
        within, within_main = inside, False
        mark = ""
        if attributes:
            for m in _MARK.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "style":
                    out = out or bool(_HIDDEN.search(value))
                elif name == "hidden" or name == "aria-hidden":
                    out = out or name == "hidden" or value == "true"
                elif name == "role" and value == "main":
                    mark += " main"
                    inside = within_main = True
                else:
                    mark += f" {value}"
            if mark and tag not in WHOLE and not within_main:
                out = out or marked(mark) or (not inside and not OUTSIDE.isdisjoint(mark.split()))
            elif tag == "article":
                out = out or not ARTICLES.isdisjoint(_WORDS.findall(mark))
            if within_main and not out:
                self._has_article = True
        if tag in NEVER or (tag == "header" and not inside):
            out = True
        if tag in ("article", "main") and not out:
            inside = self._has_article = True
        number = 0
        if tag in BLOCK:
            number = len(self._hash)
            self._hash.append(0)
            self._parent.append(self._around())
            self._tag.append(tag)
            self._within.append(within)
        self._count[tag] += 1
        self._open.append((tag, number, out, inside, [f"<{tag}{mark}>".encode()]))

    def _end_open(self, tags: tuple[str, ...]) -> None:
        """Closes the nearest of these elements, and what is open in it, unless another scope is nearer."""
        if not any(self._count[t] for t in tags):
            return
        for k in range(len(self._open) - 1, 0, -1):
            tag = self._open[k][0]
            if tag in tags:
                while len(self._open) > k:
                    self._close()
                if len(tags) > 1:
                    self._end_open(tags)
                return
            if tag in SCOPES:
                return

    def _end(self, tag: str) -> None:
        if tag == "br":
            return self._start("br", "")
        if tag in BLOCK:
            self._border()
        if not self._count[tag]:
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == tag:
                while len(self._open) > k:
                    self._close()
                return
            if tag not in BLOCK and self._open[k][0] in BLOCK:
                return  # an inline end tag does not reach out of its block

    def _close(self) -> None:
        import xxhash

        if self._open[-1][0] in BLOCK:
            self._border()
        tag, number, _, _, pieces = self._open.pop()
        self._count[tag] -= 1
        h = xxhash.xxh3_64_intdigest(b"\x00".join(pieces))
        self._open[-1][4].append(h.to_bytes(8, "little"))
        if number:
            self._hash[number] = _signed(h)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def main_text(html: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text without what stands in a template subtree."""
    return "\n\n".join(Page(html).without(templates)[0])


_PAGE_KEY = "xxhash64(coalesce(html, ''))"
_HOST = "coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"


def _read(batch: pa.RecordBatch) -> dict:
    """The columns of ``subtrees``; pages one at a time, since the tree of a page is many times its text."""
    found = []
    for html in C.column(batch, "html"):
        page = Page(html.as_py() or "")
        found.append((page.key(), *map(sorted, page.hashes())))
    return {"host": C.column(batch, "host"), "page_key": C.column(batch, "page_key")} | dict(zip(("article", "outer", "parts", "lines"), map(list, zip(*found))))


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page_key, unit, hash, line of each block-level subtree that may be a template; pages with equal html on a host once.

    unit is what counts once: the page outside an article, else the article; line: a single line of an article.
    """

    keyed = pages.select(F.expr(_HOST).alias("host"), F.expr(_PAGE_KEY).alias("page_key"), "html")
    found = C.map_batches(keyed, "host string, page_key bigint, article bigint, outer array<bigint>, parts array<bigint>, lines array<bigint>", lambda: _read).filter("size(outer) + size(parts) + size(lines) > 0")
    kinds = (("outer", "page_key", "false"), ("parts", "article", "false"), ("lines", "article", "true"))
    each = F.explode(F.expr("concat(" + ", ".join(f"transform({k}, h -> struct(h as hash, {unit} as unit, {line} as line))" for k, unit, line in kinds) + ")"))
    found = found.dropDuplicates(["host", "page_key"]).select("host", "page_key", each.alias("s"))
    return found.select("host", "page_key", "s.unit", "s.hash", "s.line")


def templates(found: DataFrame, min_pages: int, line_pages: int) -> DataFrame:
    """host, hash, line of the subtrees that recur, with n, the number of their rows in found."""
    units = found.groupBy("host", "hash", "line", "unit").agg(F.count("*").alias("rows"))  # a shuffle by unit, so no hot task
    counts = units.groupBy("host", "hash", "line").agg(F.count("*").alias("units"), F.sum("rows").alias("n"))
    return counts.filter(F.col("units") >= F.when(F.col("line"), line_pages).otherwise(min_pages)).select("host", "hash", "line", "n")


def extract(pages: DataFrame, min_pages: int = 5, broadcast_rows: int = 1_000_000, line_pages: int = 20) -> DataFrame:
    """page_id, url, text of each whole page, and n_template: its blocks, in or out of the main text, that a site template holds."""
    found = C.cut(subtrees(pages))
    key = F.unhex(F.md5(F.to_json(F.struct("host", "hash", "line")).cast("binary"))).alias("key")
    recurring = C.cut(templates(found, min_pages, line_pages).select(key, "n", F.lit(True).alias("template")))
    marked = C.join_by_key(found.select("host", "page_key", "hash", key), recurring, "key", F.xxhash64("host", "page_key", "hash")).filter("template")  # a template may be on every page of a hot host
    own = C.cut(marked.groupBy("host", "page_key").agg(F.collect_list("hash").alias("templates")))  # a page's own subtrees
    keyed = pages.select("page_id", "url", "html", F.expr(_HOST).alias("host"), F.expr(_PAGE_KEY).alias("page_key"))
    joined = keyed.join(broadcast_if_small(own, broadcast_rows), ["host", "page_key"], "left").select("page_id", "url", "html", "templates")
    schema = C.schema_of(f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_template long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = C.arrow_schema(schema)
        for batch in (p for b in batches for p in C.pieces(b)):
            texts, counts = [], []
            for h, t in zip(C.column(batch, "html"), C.column(batch, "templates")):
                blocks, n = Page(h.as_py() or "").without(set(t.as_py() or ()))
                texts.append("\n\n".join(blocks))
                counts.append(n)
            yield C.to_batch({"page_id": C.column(batch, "page_id"), "url": C.column(batch, "url"), "text": texts, "n_template": counts}, out)
        C.give_back()

    return joined.mapInArrow(run, schema)


def op7_extract_html(spark, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")
