"""Consolidation of a stored corpus and its summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticiario import schema
from noticiario.functions import text
from noticiario.operators import reports
from noticiario.operators.columns import normalise_dates
from noticiario.operators.dedup import dedup_keep_first, recent_first
from noticiario.operators.filters import drop_empty_text
from noticiario.session import pin
from noticiario.sources.manifest import EMPTY, file_states, skipped_files
from noticiario.sources.readers import read_corpus, require_columns


def file_order(tie: Sequence[str] = ("periodico", "titulo")) -> list[Column]:
    """Department files by name, each one latest first."""
    return [text.slug(F.col("departamento")), *recent_first(), *map(F.col, tie)]


def clean(
    corpus: DataFrame, order: Sequence[Column] | None = None, content_first: bool = False
) -> DataFrame:
    """One row per URL, dates as timestamps, no empty texts.

    The first copy of a URL wins before empty texts are dropped, so an empty first
    copy removes the URL; with ``content_first`` empty copies are dropped before.
    """
    corpus = normalise_dates(require_columns(corpus))
    order = file_order() if order is None else order
    if content_first:
        corpus = drop_empty_text(corpus)
    return drop_empty_text(dedup_keep_first(corpus, order))


def consolidate(
    spark: SparkSession,
    root: str,
    content_first: bool = False,
    row_type: StructType | None = None,
) -> DataFrame:
    """All stored departments as one clean corpus; unreadable files are skipped.

    Without ``row_type`` the columns of all files are merged and checked; a store
    of very many files is better read with a known row type.
    """
    stored = read_corpus(spark, root, tolerate_bad=True, row_type=row_type)
    return clean(stored, content_first=content_first)


def summaries(stored: DataFrame, cleaned: DataFrame) -> dict[str, DataFrame]:
    """Reports of a consolidation, each its own small result.

    ``stored`` is read with its files.
    """
    return {
        "duplicados": reports.dedup_stats(stored),
        "fechas": reports.date_span(cleaned),
        "departamentos": reports.count_by_department(cleaned),
        "archivos": reports.file_counts(stored),
    }


def consolidation_report(
    spark: SparkSession, root: str, content_first: bool = False,
    order: Sequence[Column] | None = None,
) -> dict[str, DataFrame]:
    """:func:`summaries` of a stored corpus, with the files that were passed over.

    ``omitidos`` names missing and damaged files, by the manifest where it knows them;
    ``vacios`` those that are sound but hold no rows.
    """
    stored = read_corpus(spark, root, tolerate_bad=True, row_type=schema.CORPUS, with_file=True)
    states = pin(file_states(spark, root), "states")
    return summaries(stored, clean(stored, order, content_first)) | {
        "omitidos": skipped_files(states),
        "vacios": states.filter(F.col("estado") == EMPTY).select("archivo", "departamento"),
    }
