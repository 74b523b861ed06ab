"""Progress of the run groups against the stored corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticiario.operators.joins import orphan_files, pending_departments
from noticiario.operators.reports import group_progress, overall_progress
from noticiario.sources.readers import corpus_inventory


def progress_report(spark: SparkSession, groups: DataFrame, root: str) -> dict[str, DataFrame]:
    """State per group, the total, pending departments and unrecognised files."""
    inventory = corpus_inventory(spark, root)
    stored = inventory.filter("departamento IS NOT NULL")
    progress = group_progress(groups, stored)
    return {
        "grupos": progress,
        "total": overall_progress(progress),
        "pendientes": pending_departments(groups, stored),
        "no_reconocidos": orphan_files(inventory, groups, "departamento"),
        "archivos": inventory,
    }
