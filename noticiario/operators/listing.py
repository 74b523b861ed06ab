"""Replay of paged listings: date classes, stop rules and caps.

A listing has ``periodico, termino, page, pos, link, fecha``; one (periodico,
termino) pair is one listing, ordered by page and position. A single listing may
hold a large share of all rows, so no rule orders the rows of a whole listing in
one task: the place where a listing stops is found by aggregation (rules on single
rows or pages) or by a blocked scan over page summaries (rules on runs of pages),
and rows before that place are then kept by a join on the listing key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticiario.operators.dedup import first_per_group
from noticiario.operators.filters import day_start
from noticiario.operators.joins import listing_place

LISTING_KEYS = ("periodico", "termino")

# Pages per block of the run-length scan.
BLOCK_PAGES = 1000


# ── Date classes ─────────────────────────────────────────────────────────────


def listing_state(fecha: Column, lo: str, hi: str) -> Column:
    """``sin_fecha``, ``posterior``, ``en_rango`` or ``anterior``.

    Listing dates are compared with the first instant of the last day.
    """
    return (
        F.when(fecha.isNull(), "sin_fecha")
        .when(fecha > day_start(hi), "posterior")
        .when(fecha >= day_start(lo), "en_rango")
        .otherwise("anterior")
    )


def classify_listing(listing: DataFrame, lo: str, hi: str) -> DataFrame:
    """Add ``estado``: undated and in-range rows are kept, later ones skipped, and
    an earlier one ends the listing.
    """
    return listing.withColumn("estado", listing_state(F.col("fecha"), lo, hi))


def is_kept(fecha: Column, lo: str, hi: str) -> Column:
    """Undated or in range."""
    return fecha.isNull() | fecha.between(day_start(lo), day_start(hi))


def filter_listing(listing: DataFrame, lo: str, hi: str) -> DataFrame:
    """Undated and in-range rows, for sources whose listing never stops early."""
    return listing.filter(is_kept(F.col("fecha"), lo, hi))


# ── Rules on single rows and pages: one aggregation per listing ──────────────


def _before(listing: DataFrame, stops: DataFrame, keys: Sequence[str], keep: Column) -> DataFrame:
    """Rows for which ``keep`` holds or whose listing has no ``_stop``.

    ``stops`` has one row per stopped listing. Its size is known only at run time:
    adaptive execution broadcasts it when small and otherwise splits the skewed
    partitions of the listing side.
    """
    return (
        listing.join(stops, list(keys), "left")
        .filter(F.col("_stop").isNull() | keep)
        .drop("_stop")
    )


def cut_at_first_older(
    listing: DataFrame,
    lo: str,
    accepted: Column | None = None,
    keys: Sequence[str] = LISTING_KEYS,
) -> DataFrame:
    """Rows before the first one dated earlier than ``lo``.

    Only rows that pass the link test ``accepted`` can end the listing.
    """
    older = F.col("fecha") < day_start(lo)
    if accepted is not None:
        older = older & accepted
    stops = listing.filter(older).groupBy(*keys).agg(F.min(listing_place()).alias("_stop"))
    return _before(listing, stops, keys, listing_place() < F.col("_stop"))


def replay(
    listing: DataFrame,
    lo: str,
    hi: str,
    accepted: Column | None = None,
    keys: Sequence[str] = LISTING_KEYS,
) -> DataFrame:
    """Links of a date-sorted listing: accepted rows up to the first older one,
    undated or in range, each link once at its first place.
    """
    rows = cut_at_first_older(listing, lo, accepted, keys)
    if accepted is not None:
        rows = rows.filter(accepted)
    return first_per_group(
        filter_listing(rows, lo, hi), [*keys, "link"], [F.col("page"), F.col("pos")]
    )


def stop_batch_all_older(
    listing: DataFrame, lo: str, keys: Sequence[str] = LISTING_KEYS
) -> DataFrame:
    """New links up to and including the first batch whose dated new links are all
    earlier than ``lo``; ``page`` is the batch. A link belongs to its first batch.
    """
    new = first_batch_rows(listing, keys)
    older = F.col("fecha") < day_start(lo)
    batches = new.groupBy(*keys, "page").agg(
        F.count("fecha").alias("_dated"), F.count_if(older).alias("_older")
    )
    stops = (
        batches.filter((F.col("_dated") > 0) & (F.col("_dated") == F.col("_older")))
        .groupBy(*keys)
        .agg(F.min("page").alias("_stop"))
    )
    return _before(new, stops, keys, F.col("page") <= F.col("_stop"))


def first_batch_rows(listing: DataFrame, keys: Sequence[str] = LISTING_KEYS) -> DataFrame:
    """Each link of a listing once, at its first place."""
    return first_per_group(listing, [*keys, "link"], [F.col("page"), F.col("pos")])


# ── Rules on runs of pages: blocked scan over page summaries ─────────────────


def stop_after_run(
    pages: DataFrame,
    n: int,
    keys: Sequence[str] = LISTING_KEYS,
    block_pages: int = BLOCK_PAGES,
) -> DataFrame:
    """First page of each listing that completes ``n`` consecutive counting pages.

    ``pages`` has ``page`` and the flag ``_counts``; a page that does not count
    resets the run. Runs are measured inside blocks of pages first; the run open at
    the end of a block is then carried over the much shorter table of blocks and
    added to the leading run of the next one.
    """
    block = F.floor(F.col("page") / block_pages).cast("long")
    blocked = pages.select(*keys, "page", "_counts", block.alias("_block"))
    in_block = Window.partitionBy(*keys, "_block").orderBy("page")
    runs = blocked.withColumn(
        "_resets", F.sum(F.when(F.col("_counts"), 0).otherwise(1)).over(in_block)
    )
    # Position inside the run: pages since the last reset of this block.
    in_run = Window.partitionBy(*keys, "_block", "_resets").orderBy("page")
    runs = runs.withColumn("_run", F.sum(F.col("_counts").cast("int")).over(in_run))

    blocks = runs.groupBy(*keys, "_block").agg(
        F.max("_resets").alias("_resets"), F.max_by("_run", "page").alias("_open")
    )
    # Carry into a block: open run of the last block with a reset plus all pages of
    # the blocks after it.
    earlier = Window.partitionBy(*keys).orderBy("_block")
    blocks = blocks.withColumn(
        "_chain", F.sum((F.col("_resets") > 0).cast("int")).over(earlier)
    )
    chain = Window.partitionBy(*keys, "_chain").orderBy("_block")
    # A block with a reset opens its own chain, so the carry it hands on is the sum
    # of its chain so far; what it receives comes from the block before.
    blocks = blocks.withColumn("_hands_on", F.sum("_open").over(chain)).withColumn(
        "_carry", F.coalesce(F.lag("_hands_on").over(earlier), F.lit(0))
    )
    # The leading run of a block (no reset yet) continues the carry.
    carried = runs.join(blocks.select(*keys, "_block", "_carry"), [*keys, "_block"])
    length = F.col("_run") + F.when(F.col("_resets") == 0, F.col("_carry")).otherwise(0)
    return (
        carried.filter(F.col("_counts") & (length >= n))
        .groupBy(*keys)
        .agg(F.min("page").alias("_stop"))
    )


def stop_after_empty_pages(
    listing: DataFrame,
    lo: str,
    hi: str,
    n: int = 3,
    newer_resets: bool = True,
    empty_page_ends: bool = False,
    accepted: Column | None = None,
    keys: Sequence[str] = LISTING_KEYS,
) -> DataFrame:
    """Pages up to the ``n``-th consecutive page without a kept row.

    Only rows that pass the link test ``accepted`` can be kept. A page with rows later than the range resets the run unless ``newer_resets``
    is off. A page without any link is a row whose link is null: it resets the run,
    or with ``empty_page_ends`` ends the listing before it.
    """
    linked = F.col("link").isNotNull()
    usable = linked if accepted is None else linked & accepted
    fecha = F.col("fecha")
    pages = listing.groupBy(*keys, "page").agg(
        F.count_if(linked).alias("_links"),
        F.count_if(usable & is_kept(fecha, lo, hi)).alias("_kept"),
        F.count_if(usable & (fecha > day_start(hi))).alias("_newer"),
    )
    counts = (F.col("_links") > 0) & (F.col("_kept") == 0)
    if newer_resets:
        counts = counts & (F.col("_newer") == 0)
    stops = stop_after_run(pages.withColumn("_counts", counts), n, keys)
    if empty_page_ends:
        stops = stops.unionByName(_empty_pages(listing, keys)).groupBy(*keys).agg(F.min("_stop").alias("_stop"))
    rows = _before(listing, stops, keys, F.col("page") <= F.col("_stop"))
    return rows.filter(linked)


def stop_at_empty_page(listing: DataFrame, keys: Sequence[str] = LISTING_KEYS) -> DataFrame:
    """Rows before the first page without any link (a row whose link is null)."""
    return _before(listing, _empty_pages(listing, keys), keys, F.col("page") <= F.col("_stop"))


def _empty_pages(listing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last page before the first one without links, per listing that has one."""
    pages = listing.groupBy(*keys, "page").agg(F.count("link").alias("_links"))
    return pages.filter(F.col("_links") == 0).groupBy(*keys).agg((F.min("page") - 1).alias("_stop"))


def stop_after_old_pages(
    listing: DataFrame, lo: str, n: int = 2, keys: Sequence[str] = LISTING_KEYS
) -> DataFrame:
    """Pages up to the ``n``-th consecutive one whose latest date is before ``lo``.

    Pages without dates leave the run as it is.
    """
    spans = page_span(listing, keys)
    counts = F.col("hasta") < day_start(lo)
    stops = stop_after_run(spans.withColumn("_counts", counts), n, keys)
    return _before(listing, stops, keys, F.col("page") <= F.col("_stop"))


def page_span(listing: DataFrame, keys: Sequence[str] = LISTING_KEYS) -> DataFrame:
    """Earliest and latest date of each page that has dates."""
    return (
        listing.filter(F.col("fecha").isNotNull())
        .groupBy(*keys, "page")
        .agg(F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"))
    )


# ── Caps ─────────────────────────────────────────────────────────────────────


def _nth_unit(counts: DataFrame, n: Column, keys: Sequence[str]) -> DataFrame:
    """The unit of each listing in which its ``n``-th row lies: ``_stop``, and ``_left``, the
    rows wanted from it. Listings with fewer rows are absent.

    ``counts`` holds ``_unit`` and ``_n``, its rows. Units are added up in blocks first, and
    the sums of the blocks are then run through, so no task sees more than a block of units
    or the blocks of a listing.
    """
    blocked = counts.withColumn("_block", F.floor(F.col("_unit") / BLOCK_PAGES))
    whole = blocked.groupBy(*keys, "_block").agg(F.sum("_n").alias("_sum"))
    over = Window.partitionBy(*keys).orderBy("_block")
    whole = whole.withColumn("_before", F.sum("_sum").over(over) - F.col("_sum"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_unit")
    before = F.col("_before") + F.col("_inside") - F.col("_n")
    return (
        blocked.withColumn("_inside", F.sum("_n").over(inside))
        .join(whole.drop("_sum"), [*keys, "_block"])
        .filter((before < n) & (before + F.col("_n") >= n))
        .select(*keys, F.col("_unit").alias("_stop"), (n - before).alias("_left"))
    )


def _counted(listing: DataFrame, unit: Column, keys: Sequence[str], *also: str) -> DataFrame:
    rows = listing.withColumn("_unit", unit)
    return rows.groupBy(*keys, *also, "_unit").agg(F.count("*").alias("_n"))


def cap_per_group(
    listing: DataFrame, n: int, keys: Sequence[str] = LISTING_KEYS
) -> DataFrame:
    """First ``n`` rows of each listing: the source's own limit on articles.

    The ``n``-th row is found by selection, with one plan for any ``n``: rows are counted by
    page, then those of the page where it lies by blocks of positions; only the rows of that
    one block are ordered. A hot listing is counted in the map tasks. A page or position
    that is null comes first.
    """
    page, block = _order_of("page"), F.floor(_order_of("pos") / BLOCK_PAGES)
    stops = _nth_unit(_counted(listing, page, keys), F.lit(n), keys)
    marked = listing.join(stops, list(keys), "left")
    sooner = marked.filter(F.col("_stop").isNull() | (page < F.col("_stop"))).drop("_stop", "_left")
    last = marked.filter(page == F.col("_stop")).drop("_stop").withColumnRenamed("_left", "_want")
    places = _nth_unit(
        _counted(last, block, keys, "_want"), F.col("_want"), [*keys, "_want"]
    )
    placed = last.join(places, [*keys, "_want"]).filter(block <= F.col("_stop"))
    first = Window.partitionBy(*keys).orderBy("pos", "link")
    cut = (
        placed.filter(block == F.col("_stop")).withColumn("_row", F.row_number().over(first))
        .filter(F.col("_row") <= F.col("_left")).drop("_row")
    )
    columns = listing.columns
    whole = placed.filter(block < F.col("_stop"))
    return sooner.select(columns).union(whole.select(columns)).union(cut.select(columns))


def _order_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(-1)).cast("long")


def stop_after_articles(
    listing: DataFrame, n: int, keys: Sequence[str] = LISTING_KEYS
) -> DataFrame:
    """Whole pages up to the one in which the ``n``-th row appears."""
    stops = _nth_unit(_counted(listing, _order_of("page"), keys), F.lit(n), keys)
    return _before(listing, stops.drop("_left"), keys, _order_of("page") <= F.col("_stop"))


def cap_pages(listing: DataFrame, n: int, page_size: int, total: Column | None = None) -> DataFrame:
    """Whole pages covering the first ``n`` results, or ``total`` if that is less.

    Pages are counted from 1.
    """
    wanted = F.lit(n) if total is None else F.least(total, F.lit(n))
    return listing.filter(F.col("page") <= F.ceil(wanted / page_size))
