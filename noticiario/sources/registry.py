"""Look-ups in the source registry and the search plan built from the dimensions.

A search plan has one row per (department, topic, source) and says which rows of
the candidate table belong to which search:

``departamento, tema, tema_pos, termino, territorio, fuente, fuente_pos,
is_national, umbral, origen``

``origen`` is ``LOCAL`` for the department's own sources, ``STAND_IN`` for the
national source that replaces a local source without results, and ``BACKUP`` for
the sources that top up a thin corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticiario.functions.text import DEFAULT_MIN_MENTIONS, territory
from noticiario.session import broadcast_if_small, pin
from noticiario.sources import dimensions

LOCAL, STAND_IN, BACKUP = 0, 1, 2


# ── Registry look-ups ────────────────────────────────────────────────────────


def available_sources(sources: DataFrame) -> DataFrame:
    return sources.select("id")


def available_regions(sources: DataFrame) -> DataFrame:
    """Distinct regions in alphabetical order."""
    return (
        sources.filter(F.col("region").isNotNull())
        .select("region").distinct().orderBy("region")
    )


def sources_by_region(sources: DataFrame, region: str) -> DataFrame:
    return sources.filter(F.col("region") == region).select("id")


def sources_by_type(sources: DataFrame, tipo: str) -> DataFrame:
    return sources.filter(F.col("tipo") == tipo).select("id")


def valid_sources(requested: DataFrame, sources: DataFrame) -> DataFrame:
    """Requested ids (column ``id``) that the registry knows."""
    return requested.join(broadcast_if_small(sources.select("id")), "id", "left_semi")


def unknown_sources(requested: DataFrame, sources: DataFrame) -> DataFrame:
    """Requested ids (column ``id``) that the registry does not know."""
    return requested.join(broadcast_if_small(sources.select("id")), "id", "left_anti")


def select_sources(
    sources: DataFrame, ids: Sequence[str] | None = None, region: str | None = None
) -> DataFrame:
    """An explicit list wins, even an empty one; else a region; else all sources."""
    if ids is not None:
        return sources.filter(F.col("id").isin(list(ids)) if ids else F.lit(False))
    if region is not None:
        return sources.filter(F.col("region") == region)
    return sources


# ── Routing and thresholds ───────────────────────────────────────────────────


def route(departments: DataFrame, routing: DataFrame) -> DataFrame:
    """One row per department and routed source; a department without sources
    keeps one row whose source is null.
    """
    routed = routing.select(
        "departamento", F.posexplode_outer("periodicos").alias("fuente_pos", "fuente")
    )
    return departments.join(broadcast_if_small(routed), "departamento", "left")


def attach_thresholds(
    df: DataFrame, thresholds: DataFrame, default: int = DEFAULT_MIN_MENTIONS
) -> DataFrame:
    """Add ``min_menciones`` by department, ``default`` where none is configured."""
    limits = thresholds.select("departamento", F.col("min_menciones").alias("_limit"))
    return (
        df.join(broadcast_if_small(limits), "departamento", "left")
        .withColumn("min_menciones", F.coalesce("_limit", F.lit(default)))
        .drop("_limit")
    )


def search_terms(territories: DataFrame, topics: Sequence[str], column: str) -> DataFrame:
    """Every territory with every topic: ``tema_pos, tema, termino, territorio``.

    The topics are a configured list, so they are exploded from a literal array
    in the same pass over the territories.
    """
    listed = F.array(*[F.lit(topic) for topic in topics])
    return (
        territories.select("*", F.posexplode(listed).alias("tema_pos", "tema"))
        .withColumn("termino", F.concat_ws(" ", F.col(column), F.col("tema")))
        .withColumn("territorio", territory(F.col("termino")))
    )


# ── Search plan ──────────────────────────────────────────────────────────────

PLAN_COLUMNS = [
    "departamento", "tema", "tema_pos", "termino", "territorio",
    "fuente", "fuente_pos", "is_national", "umbral", "origen",
]


def search_plan(
    departments: DataFrame,
    routing: DataFrame,
    thresholds: DataFrame,
    sources: DataFrame,
    topics: Sequence[str] = tuple(dimensions.TOPICS),
    backup: Sequence[str] = tuple(dimensions.BACKUP),
    fallback: str | None = dimensions.FALLBACK,
    min_mentions: int | None = None,
) -> DataFrame:
    """All searches of a run as one small table, computed once.

    ``min_mentions`` overrides the department thresholds. National sources always
    need one mention. Unknown source ids are left out.
    """
    known = broadcast_if_small(
        sources.select(F.col("id").alias("fuente"), "is_national")
    )
    routed = departments.select("departamento").join(
        broadcast_if_small(routing), "departamento", "left"
    )
    routed = routed.withColumn(
        "periodicos", F.coalesce("periodicos", F.array().cast("array<string>"))
    )

    own = routed.select(
        "departamento", F.posexplode("periodicos").alias("fuente_pos", "fuente"),
        F.lit(LOCAL).alias("origen"),
    )
    parts = [own]
    if fallback is not None:
        # Only where the fallback is not searched anyway.
        parts.append(
            routed.filter(~F.array_contains("periodicos", fallback)).select(
                "departamento", F.size("periodicos").alias("fuente_pos"),
                F.lit(fallback).alias("fuente"), F.lit(STAND_IN).alias("origen"),
            )
        )
    if backup:
        spare = F.array_except(F.array(*[F.lit(b) for b in backup]), F.col("periodicos"))
        parts.append(
            routed.select(
                "departamento", F.posexplode(spare).alias("fuente_pos", "fuente"),
                F.lit(BACKUP).alias("origen"),
            )
        )
    searches = parts[0]
    for part in parts[1:]:
        searches = searches.unionByName(part)
    searches = searches.join(known, "fuente")

    if min_mentions is None:
        searches = attach_thresholds(searches, thresholds)
    else:
        searches = searches.withColumn("min_menciones", F.lit(min_mentions))
    searches = searches.withColumn(
        "umbral", F.when(F.col("is_national"), 1).otherwise(F.col("min_menciones"))
    )
    return pin(search_terms(searches, topics, "departamento").select(*PLAN_COLUMNS))
