"""Unions, differences, sorts and limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticiario.operators.columns import normalise_dates, to_canonical
from noticiario.operators.dedup import first_per_group, recent_first
from noticiario.session import broadcast_if_small


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Articles of several sources in canonical shape with UTC dates."""
    return normalise_dates(to_canonical(union_all(frames)))


def union_backup(
    local: DataFrame, backup: DataFrame, keys: Sequence[str] = ("url",),
    tie: Sequence[Column] = (),
) -> DataFrame:
    """Local rows plus backup rows whose URL is new; terms are not merged again."""
    both = union_all(
        [local.withColumn("_backup", F.lit(0)), backup.withColumn("_backup", F.lit(1))]
    )
    order = [F.col("_backup"), *recent_first(), *tie]
    return first_per_group(both, keys, order).drop("_backup")


def union_departments(frames: Sequence[DataFrame]) -> DataFrame:
    """Corpora of several departments; a URL may occur once in each of them."""
    return union_all(frames)


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    names = left.select(key).distinct()
    return names.join(right.select(key).distinct(), key, "left_anti")


def sort_recent(df: DataFrame, tie: Sequence[str] = ("url",)) -> DataFrame:
    """Latest first, undated rows last.

    The tie columns also let the range sort split a date shared by many rows.
    """
    return df.orderBy(F.col("fecha").desc_nulls_last(), *tie)


def sort_counts(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    return df.orderBy(F.col(n).desc(), F.col(key))


def order_by_config(
    df: DataFrame, config: DataFrame, key: str, tie: Sequence[str | Column] = ()
) -> DataFrame:
    """Rows in the order of a configuration table ``(pos, key)``.

    Give tie columns for frames with many rows per key, so that the range sort can
    split them.
    """
    placed = df.join(broadcast_if_small(config.select(key, "pos")), key)
    return placed.orderBy("pos", *tie)


def head(df: DataFrame, n: int, order: Sequence[Column] = ()) -> DataFrame:
    """First ``n`` rows; with an order, each task keeps only its best ``n``."""
    return (df.orderBy(*order) if order else df).limit(n)
