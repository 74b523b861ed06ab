"""Exact duplicates, with frequent texts split off before the shuffle.

A Misra-Gries summary (``freqItems``) of the digests names every digest that makes up
more than ``support`` of the rows, and at most ``1 / support`` in all. Their rows are
counted exactly, each gets its winner, and these few winners are broadcast: rows of
frequent texts are settled where they are read. All other digests are grouped by an
ordinary shuffle, where no group holds more than ``support`` of the rows.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, empty_if_null, fresh, row_order, stored

# Share of the rows from which a digest counts as frequent: at most 1000 of them.
SUPPORT = 0.001


def text_digest(text: str | Column) -> Column:
    """Hex SHA-256 of a text without its white space; null counts as empty."""
    return F.sha2(F.translate(empty_if_null(text), SPACES, ""), 256)


def _best(doc_id: str, n_chars: str, row: str) -> Column:
    """Least for the row that stays: longest text, smallest id (null last), first stored."""
    return F.min(F.struct(
        (-F.col(n_chars)).alias("less"), F.col(doc_id).isNull().alias("none"),
        F.col(doc_id).alias("keep_id"), F.col(row).alias("keep_row"),
    ))


def _narrow(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return stored(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        F.length(empty_if_null(f"`{text}`")).cast("long").alias("n_chars"),
        text_digest(f"`{text}`").alias("text_sha256"),
    ), "digests")


def _frequent_winners(narrow: DataFrame, support: float) -> DataFrame:
    """Winner and exact count of each frequent digest; at most ``1 / support`` rows."""
    found = narrow.stat.freqItems(["text_sha256"], support)
    digests = found.select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    return stored(
        narrow.join(F.broadcast(digests), "text_sha256")
        .groupBy("text_sha256")
        .agg(_best("doc_id", "n_chars", "row").alias("best"), F.count("*").alias("group_size"))
        .where("group_size > 1"),
        "frequent",
    )


def membership(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if they are the same without white space; null counts as empty. Of
    equal texts the longest stays (code points, white space included), of equally long
    ones the smallest id; null ids come last. Of rows that also share the id exactly one
    stays. Other columns are not looked at. An empty table gives an empty result.
    """
    narrow = _narrow(docs, text, doc_id)
    winners = _frequent_winners(narrow, support)
    hot = narrow.join(F.broadcast(winners), "text_sha256")
    rest = narrow.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(
        _best("doc_id", "n_chars", "row").alias("best"), F.count("*").alias("group_size")
    )
    return hot.unionByName(rest.join(groups, "text_sha256")).select(
        "doc_id", F.col("best.keep_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.keep_row")).alias("kept"), "text_sha256",
    )


def dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in ``membership``.

    Rows that also share id and length are ordered by a hash of the whole row. Whole
    rows are shuffled once, losers of frequent texts not at all, and each task passes on
    one row of a text at most.
    """
    winners = _frequent_winners(_narrow(docs, text, doc_id), support).select(
        "text_sha256", F.col("best.keep_id").alias("keep_id"), F.col("best.less").alias("less")
    )
    digest, size, order, place = fresh(docs, "_digest", "_size", "_order", "_place")
    keyed = docs.withColumns({
        digest: text_digest(f"`{text}`"), size: F.length(empty_if_null(f"`{text}`")).cast("long"),
        order: row_order(docs),
    })
    w_digest, w_id, w_less = fresh(keyed, "_w_digest", "_w_id", "_w_less")
    keyed = keyed.join(
        F.broadcast(winners.toDF(w_digest, w_id, w_less)), F.col(digest) == F.col(w_digest), "left"
    ).where(
        F.col(w_digest).isNull()
        | ((F.col(size) == -F.col(w_less)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(w_id)))
    )
    ranked = Window.partitionBy(digest).orderBy(
        F.col(size).desc(), F.col(f"`{doc_id}`").asc_nulls_last(), order
    )
    return keyed.withColumn(place, F.row_number().over(ranked)).where(
        F.col(place) == 1
    ).select(*[F.col(f"`{c}`") for c in docs.columns])
