"""Keep-first deduplication and the merge of search terms.

Keys may be very uneven: one URL, or the null URL, can hold a large share of all
rows. Every operator here reduces a group on the map side before its rows are
shuffled, and ``salts`` splits a hot group further in an extra, exact stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, salts: int = 1
) -> DataFrame:
    """First ``n`` rows of each group in a total order; null keys form one group.

    Spark cuts each group to ``n`` rows within every map task before the shuffle.
    With ``salts`` above one, groups are first cut in that many slices: the best
    ``n`` of a group are among the best ``n`` of its slices. A slice is a set of
    input partitions, so exact copies of a row are spread as well, and a task that
    runs again puts its rows into the same slice.
    """
    position = "_position"
    if salts > 1:
        salted = df.withColumn("_salt", F.spark_partition_id() % salts)
        df = _cut(salted, [*keys, "_salt"], order, n, position).drop("_salt")
    return _cut(df, keys, order, n, position)


def _cut(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, position: str
) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(position, F.row_number().over(window))
        .filter(F.col(position) <= n)
        .drop(position)
    )


def dedup_keep_first(
    df: DataFrame, order: Sequence[Column], key: str = "url", salts: int = 1
) -> DataFrame:
    """First row per URL. ``order`` must be total for a repeatable winner."""
    return first_per_group(df, [key], order, salts=salts)


def dedup_links(
    df: DataFrame, keys: Sequence[str] = ("periodico", "termino"), salts: int = 1
) -> DataFrame:
    """Each link of a listing once, at its first place ``(page, pos)``."""
    return first_per_group(
        df, [*keys, "link"], [F.col("page"), F.col("pos")], salts=salts
    )


def dedup_titles(df: DataFrame, order: Sequence[Column], salts: int = 1) -> DataFrame:
    """First row per title within a source."""
    return first_per_group(df, ["periodico", "titulo"], order, salts=salts)


def terms_by_url(
    df: DataFrame, keys: Sequence[str] = ("url",), term: str = "tema"
) -> DataFrame:
    """Distinct terms of each URL, sorted and joined by ``', '``. Null URLs have none."""
    return (
        df.filter(F.col("url").isNotNull())
        .groupBy(*keys)
        .agg(joined_terms(F.col(term)).alias("terminos_encontrado"))
    )


def joined_terms(term: Column, where: Column | None = None) -> Column:
    """Aggregate: sorted distinct terms as one string."""
    kept = term if where is None else F.when(where, term)
    return F.array_join(F.array_sort(F.collect_set(kept)), ", ")


def attach_terms(df: DataFrame, terms: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """Left join of the merged terms; rows without a match get null."""
    return df.join(terms, list(keys), "left")


def merge_by_url(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = ("url",),
    term: str = "tema",
    salts: int = 1,
) -> DataFrame:
    """First row and all terms of each URL in one aggregation.

    Same result as :func:`dedup_keep_first`, :func:`terms_by_url` and
    :func:`attach_terms` together, with one shuffle instead of three. Groups are
    combined within each map task, so a URL found many times travels once per task;
    ``salts`` above one combines hot groups in that many slices before.
    """
    payload = [name for name in df.columns if name not in (*keys, term)]
    first = F.min_by(F.struct(*payload), F.struct(*order)).alias("_first")
    if salts > 1:
        slices = (
            df.withColumn("_salt", F.spark_partition_id() % salts)
            .groupBy(*keys, "_salt")
            .agg(first, F.min(F.struct(*order)).alias("_order"), F.collect_set(term).alias("_set"))
        )
        # At most ``salts`` short arrays per group.
        terms = F.array_distinct(F.flatten(F.collect_list("_set")))
        merged = slices.groupBy(*keys).agg(
            F.min_by("_first", "_order").alias("_first"),
            F.array_join(F.array_sort(terms), ", ").alias("_terms"),
        )
    else:
        merged = df.groupBy(*keys).agg(first, joined_terms(F.col(term)).alias("_terms"))
    return merged.select(
        *keys,
        *[F.col(f"_first.{name}").alias(name) for name in payload],
        F.when(F.col("url").isNotNull(), F.col("_terms")).alias("terminos_encontrado"),
    )


def recent_first(fecha: str = "fecha") -> list[Column]:
    """Ascending keys that mean: latest date first, undated rows last."""
    return [F.col(fecha).isNull(), -F.unix_micros(fecha)]
