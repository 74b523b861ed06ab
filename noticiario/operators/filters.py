"""Row filters: date window, relevance, empty text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticiario.functions import text

_DAY_END = "23:59:59"


def day_start(day: str) -> Column:
    return F.to_timestamp(F.lit(f"{day} 00:00:00"))


def day_end(day: str) -> Column:
    return F.to_timestamp(F.lit(f"{day} {_DAY_END}"))


def in_date_range(fecha: Column, lo: str, hi: str, keep_null: bool = True) -> Column:
    """Inside the days ``lo``..``hi``, the last one included up to its last second."""
    inside = fecha.between(day_start(lo), day_end(hi))
    return fecha.isNull() | inside if keep_null else inside


def filter_date_range(df: DataFrame, lo: str, hi: str, keep_null: bool = True) -> DataFrame:
    """Keep rows dated in the window; undated rows are kept unless told otherwise.

    A plain comparison on the stored column, so it reaches the Parquet scan.
    """
    return df.filter(in_date_range(F.col("fecha"), lo, hi, keep_null))


def is_relevant(
    minimum: Column | int, place: Column, body: str = "texto", title: str = "titulo"
) -> Column:
    """Enough mentions of the place; a minimum of zero or less accepts all rows."""
    minimum = F.lit(minimum) if isinstance(minimum, int) else minimum
    score = text.mention_score(F.col(body), F.col(title), place)
    return (minimum <= 0) | (score >= minimum)


def effective_minimum(minimum: Column | int, is_national: Column) -> Column:
    """National sources always need one mention, whatever was asked for."""
    minimum = F.lit(minimum) if isinstance(minimum, int) else minimum
    return F.when(is_national, F.lit(1)).otherwise(minimum)


def filter_relevant(
    df: DataFrame, minimum: Column | int, term: str = "termino"
) -> DataFrame:
    """Keep articles that mention the territory of their search term often enough."""
    return df.filter(is_relevant(minimum, text.territory(F.col(term))))


def drop_empty_text(df: DataFrame) -> DataFrame:
    """Drop rows whose text is null or only white space."""
    return df.filter(~text.is_blank(F.col("texto")))
