"""Main text of web pages, with the templates of each site removed.

Each page is parsed once. Every block-level element is hashed with its whole subtree; the
distinct main texts of a host whose pages contain a hash are counted in Spark, so copies of
a page count once. Blocks under a subtree that recurs on many
pages of the host are deleted. Within the article only a container, or an element with a
class that marks boilerplate, can be such a template, and only if it holds no more than half
of the text: headings, paragraphs and items that articles share stay. Elements that are never content by their tag or
role go as well, and small or link-heavy ones with a class or id that marks boilerplate, but
never one around the article or most of its text; of what is left, the article element (else ``main``, else the body) is
the text. An element that encloses the chosen article or ``main`` never deletes it, and
copies of a page on one host stay whole.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, empty_if_null, stored

# A subtree is a template if pages of its host with so many different main texts have it.
MIN_PAGES = 5
# Rows with a template are broadcast up to so many numbers of 8 bytes, else joined by shuffle.
BROADCAST_HASHES = 2_000_000

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul"
    .split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CONTAINERS = frozenset("aside details div dl figure form menu ol section table ul".split())
# What can be a template within an article, whatever its class.
INNER = CONTAINERS | {"blockquote", "figure"}
DROPPED = frozenset(
    "head script style title textarea iframe noembed noframes xmp noscript template nav footer "
    "aside form button select option input svg math canvas object audio video map dialog menu"
    .split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu "
    "menubar toolbar".split()
)
# Classes and ids that mark boilerplate, if the element is small or link-heavy.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar share "
    "sharing social related recommended recommendations comment comments disqus widget "
    "pagination pager toolbar login signup search skip".split()
)
# Elements that a class cannot mark as boilerplate.
NOT_HINTED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
SMALL = 40  # characters of a hinted container that goes whatever its links are
# What the start of a tag closes, up to the given ancestors.
_LISTS, _ROWS = ("ul", "ol", "menu"), ("table",)
CLOSES = {
    "li": (("li",), _LISTS), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), _ROWS), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tr", "td", "th"), _ROWS),
    "option": (("option",), ("select",)), "body": (("head",), ()),
}
# A paragraph ends where one of these begins.
ENDS_P = BLOCK - {"caption", "html", "body", "legend", "option", "optgroup", "td", "th", "tr",
                  "tbody", "thead", "tfoot", "summary", "figcaption"}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'](?=[^\"']*+\Z))*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
ATTRIBUTE = re.compile(
    r"(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?",
    re.I,
)
HOST = re.compile(r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


class _Frame:
    __slots__ = ("tag", "mark", "parts", "dropped", "block", "article", "chars", "linked",
                 "headings", "hinted", "piece", "opens")

    def __init__(self, tag, mark, dropped, block, article, headings, hinted=False, piece=0, opens=False):
        self.tag, self.mark, self.parts, self.dropped = tag, mark, [], dropped
        self.block, self.article, self.headings, self.hinted = block, article, headings, hinted
        self.chars = self.linked = 0
        self.piece, self.opens = piece, opens  # opens: is the article or main element


def _attributes(raw: str) -> dict[str, str]:
    found = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _hint(attributes: dict[str, str]) -> bool:
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    return not HINTS.isdisjoint(named.split())


class Page:
    """One parsed page: the blocks of its text and the hashes of its subtrees.

    ``blocks``: ``[text, region, hashes]``; ``hashes`` name the enclosing elements that
    fall if they are templates. ``subtrees``: all hashes to count.
    """

    def __init__(self, source: str):
        self.blocks: list[list] = []
        self.subtrees: set[int] = set()
        self.stack: list[_Frame] = [_Frame("#root", "", False, 0, 0, False)]
        self.pieces: list[str] = []
        self.articles = 0
        self.length: dict[int, int] = {}
        self.hinted: list[tuple[int, int, int]] = []
        self._read(source)
        while len(self.stack) > 1:
            self._close()
        self._flush()
        self._drop_hinted()

    def _drop_hinted(self) -> None:
        """Small or link-heavy hinted elements go, unless they hold most of the text around."""
        gone: set[int] = set()
        for first, last, region in self.hinted:
            inner = self.blocks[first:last]
            if all(b[1] == region for b in inner) and (
                2 * sum(len(b[0]) for b in inner) <= self.length.get(region, 0)
            ):
                gone.update(range(first, last))
        for k in sorted(gone, reverse=True):
            text, region, _ = self.blocks.pop(k)
            self.length[region] -= len(text)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                inner = source[at : stop.start() if stop else size]
                self.stack[-1].parts.append(inner)
                at = stop.start() if stop else size

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        top = self.stack[-1]
        words = text.split()
        if words:
            squeezed = " ".join(words)
            top.parts.append(squeezed)
            n = len(squeezed)
            top.chars += n
            if any(f.tag == "a" for f in self.stack[-4:]):
                top.linked += n
        if not top.dropped:
            self.pieces.append(text)

    def _flush(self) -> None:
        """End the current block; it belongs to the innermost open elements."""
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        self.pieces = []
        if text:
            region = self.stack[-1].article
            self.blocks.append([text, region, []])
            self.length[region] = self.length.get(region, 0) + len(text)

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self.pieces.append(" ") if self.pieces else None
            return
        if tag in BLOCK:
            self._flush()
        if tag in CLOSES:
            self._imply(*CLOSES[tag])
        elif tag in ENDS_P:
            self._imply(("p",), ("button", "table", "article", "section", "div", "td", "li"))
        top = self.stack[-1]
        attributes = _attributes(raw) if raw else {}
        dropped, article, headings = top.dropped, top.article, top.headings
        if headings and dropped and re.fullmatch("h[1-6]|hgroup", tag):
            dropped = False
        if tag in DROPPED:
            dropped, headings = True, False
        elif tag == "header":
            # an article's own header gives its headings
            dropped, headings = True, article > 0 and not top.dropped
        elif attributes and not dropped and tag not in NOT_HINTED - {"article"}:
            style = attributes.get("style", "").replace(" ", "").lower()
            dropped = (
                attributes.get("role", "").lower() in DROPPED_ROLES
                or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
                or "display:none" in style or "visibility:hidden" in style
            )
        if tag == "article" and not dropped:
            if article > 0:  # an article in an article is a comment or a teaser
                dropped = True
            else:
                self.articles += 1
                article = self.articles
        elif not dropped and article == 0 and (
            tag == "main" or attributes.get("role", "").lower() == "main"
        ):
            article = -1
        if tag in VOID:
            if tag in BLOCK:
                self._flush()
            top.parts.append(f"<{tag}>")
            return
        mark = f"{tag} {attributes.get('class', '')}"
        hinted = not dropped and tag not in NOT_HINTED and _hint(attributes)
        self.stack.append(_Frame(
            tag, mark, dropped, len(self.blocks), article, headings, hinted, len(self.pieces),
            article != top.article,
        ))

    def _imply(self, closed: tuple[str, ...], within: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in closed:
                while len(self.stack) > k:
                    self._close()
                self._imply(closed, within)
                return
            if tag in within:
                return

    def _end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._close()
                return
            if tag == "p" and self.stack[k].tag in BLOCK:
                return
        if tag in BLOCK:
            self._flush()

    def _close(self) -> None:
        if self.stack[-1].tag in BLOCK:
            self._flush()
        f = self.stack.pop()
        top = self.stack[-1]
        digest = hashlib.blake2b(
            "\x00".join([f.mark, *f.parts]).encode("utf-8", "replace"), digest_size=8
        ).digest()
        top.parts.append(digest.hex())
        top.chars += f.chars
        top.linked += f.linked
        if f.hinted and f.tag not in BLOCK:
            if len(self.blocks) == f.block and 2 * f.linked >= f.chars:
                del self.pieces[f.piece :]
        elif f.hinted and len(self.blocks) > f.block and (
            2 * f.linked >= f.chars or (f.tag in CONTAINERS and f.chars <= SMALL)
        ):
            self.hinted.append((f.block, len(self.blocks), f.article))
        if f.tag not in BLOCK or f.tag in ("html", "body", "main", "article") or not f.chars:
            return
        if f.opens or len(self.blocks) == f.block:
            return
        if f.article and f.tag not in INNER and not f.hinted:
            return
        number = int.from_bytes(digest, "little", signed=True)
        self.subtrees.add(number)
        for block in self.blocks[f.block :]:
            if block[1] == f.article:  # else the article begins below this element
                block[2].append(number)

    def main(self) -> list[list]:
        """Blocks of the longest article, else of the main element, else of the body."""
        articles = [r for r in self.length if r > 0]
        if articles:
            region = max(articles, key=lambda r: (self.length[r], -r))
        else:
            region = -1 if self.length.get(-1) else 0
        found = [b for b in self.blocks if b[1] == region]
        if region:
            # what holds most of an article is no template, even where titles differ
            held = Counter()
            for text, _, hashes in found:
                held.update(dict.fromkeys(hashes, len(text)))
            for b in found:
                b[2] = [h for h in b[2] if 2 * held[h] <= self.length[region]]
        return found


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        columns = (batch[c] for c in ("row", "page_id", "url", "html"))
        for row, key, url, source in zip(*columns, strict=True):
            page = Page(source or "")
            blocks = page.main()
            rows.append((
                row, key, url, host_of(url), [b[0] for b in blocks], [b[2] for b in blocks],
                list(page.subtrees),
            ))
        yield pd.DataFrame(rows, columns=[
            "row", "page_id", "url", "host", "texts", "within", "subtrees"
        ])


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html",
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``; other columns are dropped.

    Null or empty html, and pages without content, give an empty text. Pages without a
    host (null or odd urls) count as one host. Repeated rows are pages each. White space
    (Unicode) inside a block is one space; blocks are joined by a line feed.
    """
    bounded_batches(pages.sparkSession)
    numbered = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{page_id}`").cast("string").alias("page_id"),  # null longs would become doubles
        F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html"),
    )
    parsed = stored(
        numbered.mapInPandas(
            _parse, "row long, page_id string, url string, host string, texts array<string>, "
            "within array<array<bigint>>, subtrees array<bigint>",
        ).withColumn("page_id", F.col("page_id").cast(pages.schema[page_id].dataType)), "pages",
    )
    # copies of a page have one content
    content = F.xxhash64("texts").alias("content")
    found = parsed.select("host", content, F.explode("subtrees").alias("subtree"))
    templates = (
        found.distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages).select("host", "subtree")
    )
    # narrow: the rows with a template, and which; texts stay where they are if that is small
    hits = stored(
        parsed.select("row", "host", F.explode(F.array_distinct(F.flatten("within"))).alias("subtree"))
        .join(templates, ["host", "subtree"]).groupBy("row")
        .agg(F.collect_set("subtree").alias("dead")), "template-rows",
    )
    many = hits.agg(F.sum(F.size("dead") + 2)).first()[0] or 0
    alive = F.filter(
        F.arrays_zip("texts", "within"),
        lambda b: ~F.arrays_overlap(b["within"], F.col("dead")),
    )
    kept = parsed.join(F.broadcast(hits) if many <= BROADCAST_HASHES else hits, "row", "left").withColumn(
        "texts", F.when(F.col("dead").isNull(), F.col("texts"))
        .otherwise(F.transform(alive, lambda b: b["texts"])),
    )
    columns = ["page_id", "url", F.concat_ws("\n", "texts").alias("text")]
    return kept.select(*columns).withColumn(
        "n_chars", F.length(empty_if_null("text")).cast("long")
    )

