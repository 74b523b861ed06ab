"""From stored listing pages, payloads and article pages to candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticiario.functions import urls
from noticiario.operators import listing as steps
from noticiario.operators.dedup import dedup_links
from noticiario.operators.extract import extract_articles
from noticiario.operators.filters import filter_date_range
from noticiario.operators.joins import last_listing_dates
from noticiario.sources.readers import read_queryly
from noticiario.sources.rules import (
    HISTORICAL_EMPTY_PAGES,
    ListingRule,
    QuerylyRule,
)


def links_from_payloads(payloads: DataFrame, rule: QuerylyRule) -> DataFrame:
    """Search-service responses of one source to rows ``pos, link, fecha``."""
    rows = read_queryly(payloads, rule.formats)
    if rule.min_segments is not None:
        rows = rows.filter(urls.is_article(F.col("link"), rule.min_segments, rule.year_segment))
    complete = urls.absolutise_rooted if rule.rooted else urls.absolutise
    return rows.withColumn("link", complete(F.col("link"), rule.base))


def replay_source(
    listing: DataFrame,
    rule: ListingRule,
    lo: str,
    hi: str,
    historical: bool = False,
    keys: Sequence[str] = ("periodico", "termino"),
) -> DataFrame:
    """Kept links of the listings of one source, each once at its first place.

    ``listing`` holds all stored rows, a page without links being one row whose
    link is null. Pages are counted from 1. ``historical`` reads on
    over more pages without new articles, as runs over past years do.
    """
    empty_pages = rule.empty_pages
    if historical and empty_pages and not rule.first_older:
        empty_pages = HISTORICAL_EMPTY_PAGES

    rows = listing
    if rule.first_older:
        rows = steps.cut_at_first_older(rows, lo, F.col("link").isNotNull(), keys)
    if empty_pages:
        rows = steps.stop_after_empty_pages(
            rows, lo, hi, empty_pages, rule.newer_resets, rule.empty_page_ends, keys=keys
        )
    elif rule.empty_page_ends:
        rows = steps.stop_at_empty_page(rows, keys)
    rows = rows.filter(F.col("link").isNotNull())
    if rule.old_pages:
        rows = steps.stop_after_old_pages(rows, lo, rule.old_pages, keys)
    if rule.older_batch:
        rows = steps.stop_batch_all_older(rows, lo, keys)
    if rule.whole_last_day or not rule.keep_undated:
        rows = filter_date_range(rows, lo, hi, keep_null=rule.keep_undated)
    elif rule.filter_dates:
        rows = steps.filter_listing(rows, lo, hi)
    return dedup_links(rows, keys)


def candidates_from_pages(
    links: DataFrame,
    listing: DataFrame,
    pages: DataFrame,
    keys: Sequence[str] = ("periodico", "termino"),
) -> DataFrame:
    """Articles of the kept links, parsed from their stored pages.

    ``links`` are the kept listing rows, ``listing`` all rows (for the dates) and
    ``pages`` stored article pages ``url, html``. Listing dates are attached to the
    links first and pages are parsed where they are read, so the only wide join
    moves extracted texts, never pages.
    """
    found = links.select(*keys, "link").distinct()
    listed = last_listing_dates(listing, [*keys, "link"]).withColumn("_listed", F.lit(True))
    dated = found.join(listed, [*keys, "link"], "left")

    # Parsing never fails, so pages nobody asked for do no harm; Spark may spare them by
    # pushing a filter of the wanted links below the parsing.
    articles = extract_articles(pages.select("url", "html"))
    fecha = F.when(F.col("_listed"), F.col("fecha_listado")).otherwise(F.col("fecha"))
    return dated.join(articles, F.col("link") == F.col("url")).select(
        *keys, "titulo", fecha.alias("fecha"), "texto", "url"
    )
