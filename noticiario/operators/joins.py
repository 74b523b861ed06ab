"""Joins between plans, results, listings and stored corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticiario.session import broadcast_if_small
from noticiario.sources.keys import KeyStore


def listing_place() -> Column:
    """Order of a row within its listing as one number, from ``page`` and ``pos``.

    A number instead of a pair keeps minima and maxima in hash aggregation.
    """
    return F.col("page").cast("long") * F.lit(1 << 32) + F.col("pos").cast("long")


def last_listing_dates(
    listing: DataFrame, keys: Sequence[str] = ("periodico", "termino", "link"), skip_null: bool = False
) -> DataFrame:
    """One date per link: that of its last listing row, for each search by itself.

    Of rows at the same place the latest date counts, so input order never matters.

    With ``skip_null`` rows without a date never replace an earlier date, and a
    link without any dated row is absent.
    """
    rows = listing.filter(F.col("fecha").isNotNull()) if skip_null else listing
    # A null date is kept if it is the last one.
    last = F.max(F.struct(listing_place().alias("place"), "fecha")).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, F.col("_last.fecha").alias("fecha_listado"))


def listing_date(
    articles: DataFrame, listed: DataFrame, keys: Sequence[str] = ("periodico", "termino", "link")
) -> DataFrame:
    """Replace article dates by listing dates where the link was listed.

    A listed link takes the listing date even when that is null; only links that
    were never listed keep their own date.
    """
    dates = listed.withColumn("_listed", F.lit(True))
    return (
        articles.join(dates, list(keys), "left")
        .withColumn("fecha", F.when(F.col("_listed"), F.col("fecha_listado")).otherwise(F.col("fecha")))
        .drop("_listed", "fecha_listado")
    )


def known_links(listing: DataFrame, seen: DataFrame, keys: Sequence[str] = ("link",)) -> DataFrame:
    """Listing rows whose link was not seen before.

    For a history that grows from run to run see ``sources.keys``: :func:`new_links`.
    """
    return listing.join(seen.select(*keys), list(keys), "left_anti")


def new_links(
    listing: DataFrame, store: KeyStore, keys: Sequence[str] = ("link",), before: int | None = None
) -> DataFrame:
    """The same against a stored history, which is neither shuffled nor sorted anew."""
    return store.unseen(listing, *keys, before=before)


def backup_candidates(backup: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Backup sources that the plan does not search already."""
    return backup.join(broadcast_if_small(used.select(*keys)), list(keys), "left_anti")


def zero_result_sources(
    plan: DataFrame, results: DataFrame, keys: Sequence[str] = ("fuente",)
) -> DataFrame:
    """Planned sources without national coverage that returned no row."""
    found = results.select(*keys).distinct()
    return plan.filter(~F.col("is_national")).join(found, list(keys), "left_anti")


def pending_departments(plan: DataFrame, stored: DataFrame) -> DataFrame:
    return plan.join(stored.select("departamento"), "departamento", "left_anti")


def orphan_files(inventory: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Stored files that belong to no expected department."""
    return inventory.join(broadcast_if_small(expected.select(key)), key, "left_anti")
