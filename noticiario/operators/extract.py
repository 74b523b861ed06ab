"""Stored HTML to listing rows and article rows.

Everything is column expressions over the page text, so a page is parsed in the scan
task without leaving the JVM. There is no document tree, but elements end at their own
closing tags (``functions.markup``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticiario.functions import dates, urls
from noticiario.functions.markup import elements, let, unescape, without

# What any tag of a pattern that names none can be.
_CONTAINERS = "div|article|section|li"


@dataclass(frozen=True)
class ExtractRule:
    """How one source writes its result pages.

    ``item`` matches the opening tag of a result, which ends at its own closing tag, and
    ``link`` (one group) its address within; ``within`` (one group) narrows where the address
    stands. With ``around`` the item is the innermost such element around a match of it.
    ``otherwise_item`` is used on pages without any
    ``item``. ``dates`` lists (pattern with one group, formats), first hit wins.
    ``scope`` limits a page to its first element with such an opening tag: without one the
    whole page is read, or nothing if ``scope_required``. ``base`` completes
    relative links, with ``rooted`` only those that start with ``/``.
    """

    item: str
    link: str
    within: str | None = None
    around: str | None = None
    otherwise_item: str | None = None
    dates: Sequence[tuple[str, Sequence[str]]] = ()
    date_required: bool = False
    scope: str | None = None
    scope_required: bool = False
    base: str = ""
    rooted: bool = False
    prefix: str | None = None
    domain: str | None = None
    excluded: Sequence[str] = field(default_factory=tuple)
    drop_external: bool = False
    min_segments: int | None = None
    year_segment: int | None = None


def tag_with_class(tag: str, *names: str) -> str:
    """Pattern: opening tag whose class attribute holds all ``names`` as whole classes."""
    held = "".join(
        rf"""(?=[^>]*\bclass\s*=\s*["'](?:[^"'>]*\s)?{name}[\s"'])""" for name in names
    )
    return rf"(?i:<{tag}\b){held}[^>]*>"


def href_of(mark: str = "") -> str:
    """Pattern: address of the first anchor that carries ``mark`` in its tag."""
    held = rf"(?=[^>]*{mark})" if mark else ""
    return rf"""(?i:<a\b){held}[^>]*?(?i:\bhref\s*=\s*)["']([^"'>]*)["']"""


def content_of(tag: str, name: str) -> str:
    """Pattern: content of the first tag of that class; for tags that do not nest."""
    return rf"(?s){tag_with_class(tag, name)}(.*?)(?i:</{tag}\s*>)"


def text_inside(tag: str, mark: str) -> str:
    """Pattern: content of a tag that carries ``mark``, markup included."""
    return rf"(?s)<{tag}\b(?=[^>]*{mark})[^>]*>(.*?)</{tag}>"


def time_attribute(mark: str = "") -> str:
    """Pattern: ``datetime`` of the first time element that carries ``mark``."""
    held = rf"(?=[^>]*{mark})" if mark else ""
    return rf"""(?i:<time\b){held}[^>]*?(?i:\bdatetime\s*=\s*)["']([^"'>]*)["']"""


def _tags_of(opening: str) -> str:
    """Names of the tags that a pattern of opening tags can mean."""
    name = re.search(r"<(\w+|\\w\+)", opening)[1]
    return _CONTAINERS if name == r"\w+" else name


def _elements(html: Column, opening: str, around: str | None = None) -> Column:
    return elements(html, _tags_of(opening), opening, around)


def blocks(html: Column, rule: ExtractRule) -> Column:
    """Array of result blocks of a page, in page order; comments and scripts are left out."""
    html = without(html, ["script", "style"])
    if rule.scope is not None:
        scoped = F.get(_elements(html, rule.scope), F.lit(0))
        html = scoped if rule.scope_required else F.coalesce(scoped, html)
    found = let(html, lambda page: _elements(page, rule.item, rule.around))
    if rule.otherwise_item is not None:
        found = let(found, lambda first: F.when(F.size(first) > 0, first).otherwise(
            _elements(html, rule.otherwise_item)
        ))
    return found


def _read_block(block: Column, rule: ExtractRule) -> Column:
    """Address and date texts of one block."""
    place = block if rule.within is None else F.regexp_extract(block, rule.within, 1)
    href = F.trim(F.regexp_extract(place, rule.link, 1))
    shown = [
        F.trim(F.regexp_replace(F.regexp_extract(block, pattern, 1), r"<[^>]*>", " "))
        for pattern, _ in rule.dates
    ]
    return F.struct(
        F.replace(href, F.lit("&amp;"), F.lit("&")).alias("href"),
        *[text.alias(f"shown{i}") for i, text in enumerate(shown)],
    )


def extract_links(
    pages: DataFrame, rule: ExtractRule, now: Column | str | None = None
) -> DataFrame:
    """Result pages (column ``html``) to rows ``pos, link, fecha``.

    Other columns of the pages are kept. Links are completed and tested as the rule
    says; rows whose link fails a test are dropped, and positions keep page order.
    ``now`` is needed where dates are relative.
    """
    others = [name for name in pages.columns if name != "html"]
    # Blocks are read inside the generator, so the tests below use plain columns
    # and no block text is carried along.
    read = F.transform(blocks(F.col("html"), rule), lambda block: _read_block(block, rule))
    rows = pages.select(*others, F.posexplode(read).alias("pos", "_item"))
    raw = F.col("_item.href")
    if rule.base:
        complete = urls.absolutise_rooted if rule.rooted else urls.absolutise
        link = complete(raw, rule.base)
    else:
        link = raw
    tests = [raw != ""]
    if rule.drop_external:
        tests.append(~urls.is_external(raw, rule.base))
    if rule.min_segments is not None:
        tests.append(urls.is_article(raw, rule.min_segments, rule.year_segment))
    if rule.prefix is not None:
        tests.append(urls.has_prefix(link, rule.prefix))
    if rule.domain is not None:
        tests.append(urls.in_domain(link, rule.domain))
    if rule.excluded:
        tests.append(~urls.is_excluded(link, rule.excluded))
    if rule.date_required:
        tests.append(F.col("_item.shown0") != "")
    for test in tests:
        rows = rows.filter(test)
    fecha = [
        dates.parse_date(F.col(f"_item.shown{i}"), formats, now)
        for i, (_, formats) in enumerate(rule.dates)
    ]
    return rows.select(
        *others, "pos", link.alias("link"),
        F.coalesce(*fecha, F.lit(None).cast("timestamp")).alias("fecha"),
    )


# ── Article pages ────────────────────────────────────────────────────────────

_BREAKS = r"(?i)<(?:br\s*/?|/(?:p|div|li|h[1-6]|tr|section|article|blockquote))>"


# Elements that are not part of the article.
_FURNITURE = ("script", "style", "nav", "header", "footer", "aside", "form")


def page_title(html: Column) -> Column:
    """Content of the title element, references kept."""
    closed = F.regexp_extract(html, r"(?is)^.*</title>", 0)
    return F.regexp_extract(closed, r"(?is)<title\b[^<>]*>(.*?)</title>", 1)


def without_furniture(html: Column) -> Column:
    """The page without comments, scripts, styles, navigation and the like."""
    return without(html, _FURNITURE)


def main_article(html: Column) -> Column:
    """The article element with the longest paragraphs, the first of equals; null without."""

    def weight(article: Column) -> Column:
        texts = F.regexp_extract_all(article, F.lit(r"(?i)<p\b[^>]*+>([^<]*+)"), F.lit(1))
        return F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))

    def longest(found: Column) -> Column:
        ranked = F.transform(found, lambda a, k: F.struct(
            weight(a).alias("weight"), (-k).alias("place"), a.alias("html")
        ))
        return F.when(F.size(found) > 1, F.array_max(ranked)["html"]).otherwise(F.get(found, F.lit(0)))

    return F.when(F.regexp_like(html, F.lit("(?i)<article")), let(elements(html, "article"), longest))


def element(html: Column, name: str) -> Column:
    """Content from the first opening to the last closing tag, or the empty string."""
    return F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*)</{name}>", 1)


def strip_markup(html: Column) -> Column:
    """Markup as text, with line ends at paragraph ends and references kept."""
    lines = F.regexp_replace(F.regexp_replace(html, r"\s+", " "), _BREAKS, "\n")
    # behind an opening that nothing closes there is no more markup
    return F.regexp_replace(lines, r"(?s)<[^>]*>|(<.*)$", "$1")


def squeeze(text: Column) -> Column:
    """Single blanks, no empty lines, nothing around the text."""
    blanks = F.regexp_replace(text, r"[ \t\x0B\f\r\u00A0]{2,}|[\t\x0B\f\r\u00A0]", " ")
    return F.btrim(F.regexp_replace(blanks, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def page_date(html: Column) -> Column:
    """Publication date in UTC from the page metadata, else from a time element."""
    meta = F.regexp_extract(
        html,
        r'(?i)<meta\b(?=[^<>]*(?:article:published_time|datePublished|"date"))[^<>]*?\bcontent="([^"<>]*)"',
        1,
    )
    time = F.regexp_extract(html, r'(?i)<time\b[^<>]*?\bdatetime="([^"<>]*)"', 1)
    return dates.to_utc_naive(F.coalesce(F.nullif(meta, F.lit("")), F.nullif(time, F.lit(""))))


def extract_articles(pages: DataFrame) -> DataFrame:
    """Article pages to ``titulo, fecha, texto``; other columns are kept.

    The text is that of the main article element, else of the body, else of the page.
    The steps are separate columns because each result is used more than once.
    """
    html, clean, article, body = map(F.col, ["html", "_clean", "_article", "_body"])
    main = F.when(body != "", body).otherwise(F.coalesce(article, clean))
    return (
        pages.withColumn("_clean", without_furniture(html))
        .withColumn("_article", main_article(clean))
        .withColumn("_body", F.when(article.isNull(), element(clean, "body")))
        .withColumns({"_title": page_title(html), "_bare": strip_markup(main)})
        .withColumns(
            {
                "titulo": F.trim(unescape(F.col("_title"))),
                "fecha": page_date(html),
                "texto": squeeze(unescape(F.col("_bare"))),
            }
        )
        .drop("html", "_clean", "_article", "_body", "_title", "_bare")
    )
