"""Writers: the partitioned corpus, the resume plan and the health report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticiario import schema
from noticiario.session import broadcast_if_small, pin
from noticiario.sources import manifest
from noticiario.sources.readers import read_corpus, stored_files


def write_corpus(df: DataFrame, root: str, dealt: bool = False) -> None:
    """One partition folder per department; departments without rows write nothing.

    Departments present in ``df`` are replaced, the others stay. Rebalancing lets
    a large department fill many files while small ones share a task; rows that are
    ``dealt`` by department already are written as they are. Afterwards the manifest gets
    the lines of the new files; a run that ends before leaves files that readers open.
    """
    spark = df.sparkSession
    before = pin(stored_files(spark, root), "files")
    rows = df.select(*[field.name for field in schema.CORPUS.fields])
    (
        (rows if dealt else rows.hint("rebalance", F.col("departamento")))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("departamento")
        .parquet(root)
    )
    manifest.commit(spark, root, before)


def stored_departments(spark: SparkSession, root: str) -> DataFrame:
    """Departments whose stored files are all there and sound, empty ones included."""
    return manifest.sound_departments(manifest.file_states(spark, root))


def resume_plan(departments: DataFrame, root: str, force: bool = False) -> DataFrame:
    """Departments of the plan that still have to be built.

    A stored department is skipped unless ``force``; one with a missing or damaged file
    is built again.
    """
    if force:
        return departments
    stored = stored_departments(departments.sparkSession, root)
    return departments.join(stored, "departamento", "left_anti")


def existing_corpus(departments: DataFrame, root: str) -> DataFrame:
    """Stored rows of the departments in the plan."""
    corpus = read_corpus(
        departments.sparkSession, root, tolerate_bad=True, row_type=schema.CORPUS
    )
    names = broadcast_if_small(departments.select("departamento"))
    return corpus.join(names, "departamento", "left_semi")


def write_health_report(runs: DataFrame, summary: DataFrame, path: str) -> None:
    """Classified runs and their summary as JSON under ``path``.

    Rows stay distributed: ``path/scrapers`` holds one line per run and
    ``path/resumen`` the summary lines.
    """
    runs.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/scrapers")
    summary.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/resumen")

