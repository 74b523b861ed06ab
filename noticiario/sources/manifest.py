"""What a stored corpus should hold: one line a file, kept beside the files.

Writing commits a line for each new file: its size, rows, gaps and dates, worked out from
narrow columns. Readers compare the lines with the listing of the store, so that missing,
empty and damaged files are told apart, and departments counted, without reading rows.
Only files that no line names are opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from noticiario import schema
from noticiario.session import broadcast_if_small
from noticiario.sources.readers import plain_path, read_corpus, stored_files

# Hidden from readers of the corpus by its first character.
FOLDER = "_manifiesto"

LINES = (
    "archivo string, bytes bigint, filas bigint, sin_url bigint, desde timestamp, hasta timestamp, "
    "departamento string"
)
# States of a file.
FINE, EMPTY, MISSING, DAMAGED = "bien", "vacio", "falta", "danado"
BAD = (MISSING, DAMAGED)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The committed lines; none if nothing was committed yet."""
    try:
        return spark.read.schema(LINES).parquet(f"{root}/{FOLDER}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LINES)


def commit(spark: SparkSession, root: str, before: DataFrame) -> None:
    """Add the lines of the files that are not in the listing ``before``.

    Departments with new files were replaced as a whole, and so are their lines.
    """
    listed = stored_files(spark, root).filter("departamento IS NOT NULL")
    new = listed.join(before.select("archivo"), "archivo", "left_anti")
    names = [r["departamento"] for r in new.select("departamento").distinct().collect()]
    rows = read_corpus(spark, root, row_type=schema.CORPUS, with_file=True)
    counted = (
        rows.filter(F.col("departamento").isin(names)).groupBy(plain_path(F.col("archivo"), True).alias("archivo"))
        .agg(
            F.count("*").alias("filas"), F.count_if(F.col("url").isNull()).alias("sin_url"),
            F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"),
        )
    )
    lines = new.join(counted, "archivo", "left").withColumns(
        {name: F.coalesce(name, F.lit(0).cast("bigint")) for name in ("filas", "sin_url")}
    )
    columns = [part.split()[0] for part in LINES.split(", ")]
    (
        lines.select(*columns).coalesce(8).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("departamento")
        .parquet(f"{root}/{FOLDER}")
    )


def file_states(spark: SparkSession, root: str, deep: bool = False) -> DataFrame:
    """Each file that is stored or should be: ``archivo, departamento, estado, filas, bytes``.

    A committed file is missing if it is not listed, damaged if its size is another, and
    empty if it was written without rows. Of other files the rows are counted: without
    any a file is empty if it is short and has the marks of its format, else damaged.
    ``deep`` reads all columns of the committed files as well; one that gives other rows
    than were written is damaged.
    """
    listed = stored_files(spark, root)
    lines = manifest(spark, root).select(
        "archivo", "filas", F.col("bytes").alias("_written"), F.col("departamento").alias("_place")
    )
    both = listed.withColumn("_listed", F.lit(True)).join(lines, "archivo", "full_outer").select(
        "archivo", F.coalesce("departamento", "_place").alias("departamento"), "filas",
        F.coalesce("bytes", "_written").alias("bytes"), F.col("_written").isNotNull().alias("_known"),
        F.when(F.col("_listed").isNull(), MISSING)
        .when(F.col("bytes") != F.col("_written"), DAMAGED)
        .when(F.col("filas") == 0, EMPTY).when(F.col("filas") > 0, FINE).alias("estado"),
    )
    unsure = both.filter(F.col("estado").isNull() | ((F.col("estado") == FINE) & F.lit(deep)))
    names = [r[0] for r in unsure.select("departamento").distinct().collect()]
    if not names:
        return both.drop("_known")
    rows = read_corpus(spark, root, tolerate_bad=True, row_type=schema.CORPUS, with_file=True)
    wanted = F.col("departamento").isin([n for n in names if n is not None])
    if None in names:
        wanted = wanted | F.col("departamento").isNull()
    # all columns must prove readable
    columns = [field.name for field in schema.CORPUS.fields if field.name != "departamento"]
    seen = F.bit_xor(F.xxhash64(*columns)) if deep else F.max(F.lit(0))
    read = rows.filter(wanted).groupBy(plain_path(F.col("archivo"), True).alias("archivo")).agg(
        F.count("*").alias("_read"), seen.alias("_seen")
    )
    marked = stored_files(spark, root, marks=True).select("archivo", "valido")
    checked = both.join(read, "archivo", "left").join(marked, "archivo", "left")
    n = F.coalesce(F.when(F.col("_seen").isNotNull(), F.col("_read")), F.lit(0))
    state = (
        F.when(F.col("estado").isNull() & (n > 0), FINE)
        .when(F.col("estado").isNull() & F.col("valido"), EMPTY)
        .when(F.col("estado").isNull(), DAMAGED)
        .when((F.col("estado") == FINE) & F.lit(deep) & (n != F.col("filas")), DAMAGED)
        .otherwise(F.col("estado"))
    )
    return checked.select(
        "archivo", "departamento", state.alias("estado"),
        F.when(F.col("_known"), F.col("filas")).otherwise(n).alias("filas"), "bytes",
    )


def skipped_files(states: DataFrame) -> DataFrame:
    """Files that a tolerant reader passes over, and those that are gone."""
    return states.filter(F.col("estado").isin(*BAD)).select("archivo", "departamento", "estado")


def sound_departments(states: DataFrame) -> DataFrame:
    """Departments with stored files, none of them missing or damaged."""
    return (
        states.filter("departamento IS NOT NULL").groupBy("departamento")
        .agg(F.count_if(F.col("estado").isin(*BAD)).alias("_bad")).filter("_bad = 0").select("departamento")
    )


def run_summary(
    departments: DataFrame, states: DataFrame, lines: DataFrame, errors: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Closing summary of a run over ``departments (pos, departamento)``.

    ``departamentos``: articles, dates and state of each, in the configured order; with
    data, without, or failed. A department failed if ``errors (departamento, ...)`` names it
    or a file of it is missing or damaged. ``total``: the counts of all. The committed lines
    are added up; the corpus itself is not read.
    """
    kept = lines.groupBy("departamento").agg(
        F.sum("filas").alias("articulos"), F.count("*").alias("archivos"),
        F.min("desde").alias("desde"), F.max("hasta").alias("hasta"),
    )
    failed = [skipped_files(states).select("departamento")]
    if errors is not None:
        failed.append(errors.select("departamento"))
    failed = failed[0] if len(failed) == 1 else failed[0].unionByName(failed[1])
    failures = failed.groupBy("departamento").agg(F.count("*").alias("errores"))
    zero = F.lit(0).cast("bigint")
    rows = (
        departments.select("pos", "departamento")
        .join(broadcast_if_small(kept), "departamento", "left")
        .join(broadcast_if_small(failures), "departamento", "left")
        .withColumns({name: F.coalesce(name, zero) for name in ("articulos", "archivos", "errores")})
        .withColumn("estado", F.when(F.col("errores") > 0, "con error")
                    .when(F.col("articulos") > 0, "con datos").otherwise("sin datos"))
    )
    total = rows.agg(
        F.count("*").alias("departamentos"), F.count_if(F.col("articulos") > 0).alias("con_datos"),
        F.count_if(F.col("errores") > 0).alias("con_error"),
        F.coalesce(F.sum("articulos"), zero).alias("articulos"),
        F.min("desde").alias("desde"), F.max("hasta").alias("hasta"),
    )
    return {"departamentos": rows.orderBy("pos"), "total": total}
