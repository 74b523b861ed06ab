"""Extraction rules of the sources whose results are HTML pages.

A new source is a new rule; the operators stay the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from noticiario.operators.extract import (
    ExtractRule,
    content_of,
    href_of,
    tag_with_class,
    text_inside,
    time_attribute,
)

# Tags, classes and link tests of each site.
RULES = {
    "eldiario": ExtractRule(
        scope=r'<div\b(?=[^>]*(?:id="tdi_89"|class="[^"]*tdb_loop))[^>]*>',
        scope_required=True,
        item=tag_with_class(r"\w+", "td_module_wrap"),
        link=href_of('rel="bookmark"'),
        dates=[
            (time_attribute(), ["iso_date"]),
            (text_inside("time", ""), ["es_month_day"]),
        ],
        prefix="https://www.eldiario.com.co",
        excluded=["/categoria/", "/author/", "/page/", "/?"],
    ),
    "elcolombiano": ExtractRule(
        item=tag_with_class("div", "div_iter_url"),
        link=r'\bdata-urldestination="((?!/")[^"]+)"',
        base="https://www.elcolombiano.com",
    ),
    "bcnoticias": ExtractRule(
        item=tag_with_class("div", "td_module_wrap"),
        link=href_of('rel="bookmark"'),
        dates=[(time_attribute(), ["iso_date"])],
    ),
    "diariooccidente": ExtractRule(
        scope=tag_with_class("div", "main-content"),
        item=tag_with_class("div", "border-bottom-1px-solid-gray"),
        link=href_of(),
        dates=[
            (time_attribute(), ["iso_date"]),
            (text_inside("time", ""), ["es_text"]),
            (r"(?s)(.*)", ["es_text"]),
        ],
        prefix="https://occidente.co",
    ),
    "eltiempo": ExtractRule(
        item=tag_with_class("article", "c-article"),
        link=href_of("page-link"),
        base="https://www.eltiempo.com",
    ),
    "larepublica": ExtractRule(
        item=tag_with_class("a", "result"),
        link=href_of(),
        base="https://www.larepublica.co",
    ),
    "portafolio": ExtractRule(
        item=tag_with_class("article", "c-article"),
        link=href_of("page-link"),
        dates=[(time_attribute("c-article__date"), ["iso_datetime_short_offset"])],
        base="https://www.portafolio.co",
        rooted=True,
        drop_external=True,
    ),
    "publimetro": ExtractRule(
        item=tag_with_class("div", "gsc-webResult"),
        link=href_of("gs-title"),
        dates=[(r"(›\s*\d{4}/\d{2}/\d{2})", ["slash_crumb"])],
        domain="publimetro.co",
        excluded=["/tags/"],
    ),
    "las2orillas": ExtractRule(
        item=tag_with_class("article", "mg-posts-sec-post"),
        within=content_of("h4", "entry-title"),
        link=href_of(),
        dates=[(text_inside("span", "mg-blog-date"), ["es_positional"])],
        domain="las2orillas.co",
        excluded=[
            "/contacto-comercial/", "/wp-content/", "/author/", "/category/", "/c/",
            "/page/", "/tag/",
        ],
    ),
    "elheraldo": ExtractRule(
        item=tag_with_class("div", "queryly_item_row"),
        link=href_of(),
        dates=[(text_inside("div", r'style="[^"]*color:#555'), ["es_abbr"])],
        base="https://www.elheraldo.co",
    ),
    "elpilon": ExtractRule(
        item=r"<div\b[^>]*>",
        around=r'(?i)<time\b[^>]*?\bdatetime="\d{4}-\d{2}-\d{2}T',
        link=r'<a\b[^>]*?\bhref="(/+[^"/]+/+[^"/][^"]*)"',
        dates=[(r'<time\b[^>]*?\bdatetime="(\d{4}-\d{2}-\d{2}T[^"]*)"', ["iso_datetime"])],
        date_required=True,
        base="https://elpilon.com.co",
    ),
    "elmeridiano": ExtractRule(
        item=tag_with_class("a", "block", "border", "rounded-lg"),
        otherwise_item=r'<a\b[^>]*?\bhref="/+[^"/]+/+[^"/][^"]*"[^>]*>',
        link=r'<a\b[^>]*?\bhref="(/[^"]*)"',
        dates=[(r"(•\s*\d{2}/\d{2}/\d{4})", ["bullet_dmy"])],
        base="https://elmeridiano.co",
    ),
    "tronchandosinfronteras": ExtractRule(
        scope=tag_with_class("div", "tdi_96"),
        item=tag_with_class("div", "td-module-container"),
        within=content_of("h3", "td-module-title"),
        link=href_of(),
        dates=[(time_attribute("td-module-date"), ["iso_datetime"])],
        domain="trochandosinfronteras.info",
    ),
    "enlacetelevision": ExtractRule(
        item=tag_with_class("li", "mvp-blog-story-wrap"),
        link=href_of('rel="bookmark"'),
        dates=[(text_inside("span", "mvp-cd-date"), ["es_relative"])],
        domain="enlacetelevision.com",
    ),
    "corrillos": ExtractRule(
        scope=tag_with_class("div", "col-lg-8", "col-md-12"),
        item=r"<article\b[^>]*>",
        within=content_of("h2", "post-title"),
        link=href_of(),
        dates=[(text_inside("span", "post-meta-date"), ["es_positional_de"])],
        domain="corrillos.com.co",
    ),
}



@dataclass(frozen=True)
class QuerylyRule:
    """How one source uses the search service."""

    base: str
    formats: Sequence[str]
    rooted: bool = False
    min_segments: int | None = None
    year_segment: int | None = None


# Address, date form and link test of the search-service sources.
QUERYLY = {
    "elpais": QuerylyRule("https://www.elpais.com.co", ["en_abbr_or_iso"]),
    "eluniversal": QuerylyRule(
        "https://www.eluniversal.com.co", ["es_as_en"], min_segments=4, year_segment=2
    ),
    "vanguardia": QuerylyRule("https://www.vanguardia.com", ["en_abbr"], rooted=True),
}


@dataclass(frozen=True)
class ListingRule:
    """Which part of a source's listing counts, by its dates and its empty pages.

    Stored rows are never dropped for their number.
    """

    filter_dates: bool = True
    keep_undated: bool = True
    whole_last_day: bool = False
    first_older: bool = False
    empty_page_ends: bool = False
    empty_pages: int = 0
    newer_resets: bool = True
    old_pages: int = 0
    older_batch: bool = False


# Listing rules of each source, and the empty pages of historical runs.
LISTINGS = {
    "eldiario": ListingRule(first_older=True),
    "elcolombiano": ListingRule(filter_dates=False),
    "bcnoticias": ListingRule(first_older=True, empty_page_ends=True),
    "elpais": ListingRule(first_older=True, empty_page_ends=True),
    "diariooccidente": ListingRule(first_older=True, empty_page_ends=True, empty_pages=3),
    "diariodelsur": ListingRule(first_older=True, empty_page_ends=True),
    "eltiempo": ListingRule(filter_dates=False),
    "larepublica": ListingRule(filter_dates=False),
    "portafolio": ListingRule(),
    "publimetro": ListingRule(),
    "las2orillas": ListingRule(),
    "elheraldo": ListingRule(keep_undated=False, whole_last_day=True),
    "eluniversal": ListingRule(old_pages=2, empty_page_ends=True),
    "elpilon": ListingRule(),
    "elmeridiano": ListingRule(),
    "vanguardia": ListingRule(empty_page_ends=True),
    "tronchandosinfronteras": ListingRule(empty_pages=3, newer_resets=False),
    "enlacetelevision": ListingRule(older_batch=True),
    "corrillos": ListingRule(empty_pages=3),
}
# Sources of type wp_api ask their interface for the date range and are read whole.
WHOLE_LISTING = ListingRule(filter_dates=False)
HISTORICAL_EMPTY_PAGES = 10
