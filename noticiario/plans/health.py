"""Reports over the logs: health of the source runs, errors of a corpus run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from noticiario.operators.reports import (
    SLOW_FROM_SECONDS,
    error_counts,
    error_notes,
    error_totals,
    health_by_type,
    health_document,
    health_status,
    health_summary,
    sort_errors,
)
from noticiario.sources.writers import write_health_report


def health_report(
    runs: DataFrame, path: str | None = None, slow_from: float = SLOW_FROM_SECONDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classified runs, their summary and the summary by type.

    With ``path`` runs and summary are also written as JSON.
    """
    classified = health_status(runs, slow_from)
    summary = health_summary(classified)
    if path is not None:
        write_health_report(classified, summary, path)
    return classified, summary, health_by_type(classified)


def write_health_document(
    runs: DataFrame, path: str, lo: str, hi: str, seconds: float | None = None,
    day: str | None = None, slow_from: float = SLOW_FROM_SECONDS,
) -> None:
    """The whole report as JSON: its head, one line, under ``path/reporte``, and the runs
    under ``path/scrapers``, which stay distributed."""
    classified = health_status(runs, slow_from)
    head = health_document(classified, lo, hi, seconds, day)
    write_health_report(classified, health_summary(classified), path)
    head.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/reporte")


def error_report(errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counted errors with notes, first-page errors first, and the totals."""
    return sort_errors(error_notes(error_counts(errors))), error_totals(errors)
