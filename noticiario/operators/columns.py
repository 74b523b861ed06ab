"""Projections to the canonical article shape."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticiario import schema
from noticiario.functions import dates


def to_canonical(df: DataFrame) -> DataFrame:
    """The five article columns in order; missing ones are added as null."""
    types = {field.name: field.dataType for field in schema.ARTICLE.fields}
    return df.select(
        *[
            F.col(name) if name in df.columns else F.lit(None).cast(types[name]).alias(name)
            for name in schema.CANONICAL
        ]
    )


def normalise_dates(df: DataFrame, column: str = "fecha") -> DataFrame:
    """Dates as UTC timestamps; text that is no date becomes null."""
    return df.withColumn(column, dates.to_utc_naive(F.col(column)))


def tag(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Constant columns, such as the department or municipality of a corpus."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})
