"""What the operators of this subpackage share: tables, names, batches, stored stages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticiario.session import shared_table

# Bytes of text that Spark hands to a Python worker at once.
BATCH_BYTES = 8 * 1024 * 1024

# White space that separates words; every other character belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read in batches that fit a Python worker."""
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: rows of very long texts must not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, so that a lost executor costs no recomputation of what lies
    before, and fixes generated row numbers.
    """
    return shared_table(df, f"llm-{label}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def empty_if_null(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_order(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed, to order rows equal in all else."""
    names = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{n}`") for n in names])


def groups_for(rows: int, size: int) -> int:
    """How many groups of about ``size`` rows hold ``rows``."""
    return max(1, math.ceil(rows / size))


def positions(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` with ``position``: its place, from 0, in the given total order.

    Rows are dealt out by ranges and numbered in their range; the ranges are counted
    and their starts added. No task holds more than one range, and the table of
    range counts has one row for each shuffle partition.
    """
    from pyspark.sql import Window

    ranged = stored(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), label
    )
    starts = (
        ranged.groupBy("_range").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(
            F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        )).drop("_n")
    )
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (
        ranged.withColumn("position", place).join(F.broadcast(starts), "_range")
        .withColumn("position", (F.col("position") + F.col("_before")).cast("long"))
        .drop("_range", "_before")
    )
