"""Sources mixed to target weights by entropy balancing.

Each source has a token target. Among all document rates between 0 and ``most`` that give
every source its target, the least informative ones are ``min(most, exp(l * size))``
with one multiplier ``l`` per source: the solution of a convex dual. Newton steps find all
multipliers at once; a step is one distributed aggregation over the cells ``(source,
size)`` with their document counts, which lose nothing, as a rate depends on the cell only.
Multipliers stay in a table, however many sources there are; the driver sees the largest
error. Rates are then rounded to whole copies.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, empty_if_null, fresh, positions, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
TOLERANCE = 1e-9
LEAST_TOLERANCE = 0.01  # with more left after the last step the mix is refused
MOST_STEPS = 60


def word_count(text: str | Column) -> Column:
    return F.regexp_count(empty_if_null(text), F.lit(WORD)).cast("long")


def source_targets(cells: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, size, n``.

    Sources in code point order, null last, take the weights in turn and share all words;
    no target exceeds ``most`` times its source's size, what is above is shared by weight
    among the others. The level of words per weight rises until it settles; each round is
    one sum over the sources.
    """
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    placed = stored(
        positions(sources, [F.col("source").asc_nulls_last()], "sources").withColumns({
            "weight": F.get(listed, F.pmod("position", F.lit(len(weights))).cast("int")),
            "most": F.col("source_size") * F.lit(float(most)),
        }), "source-weights",
    )
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("most") <= F.lit(level) * F.col("weight")
        row = placed.agg(
            F.count_if(over).alias("full"), F.sum(F.when(over, F.col("most"))).alias("taken"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        full = row["full"]
        level = (total - (row["taken"] or 0.0)) / row["weight"]
    return placed.select(
        "source", "source_size",
        F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"),
    )


def _balanced(cells: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``source, multiplier, scale`` for the sources whose target is neither 0 nor full."""
    top = math.log(most)
    sizes = cells.where("size > 0").groupBy("source").agg(
        F.max("size").cast("double").alias("scale"), F.min("size").cast("double").alias("least")
    )
    free = targets.where(
        (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-12))
    )
    state = stored(
        free.alias("t").join(sizes.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
        .select(
            "t.source", "target", "scale", F.lit(0.0).alias("multiplier"),
            F.when(F.col("target") < F.col("source_size"), F.lit(-math.inf))
            .otherwise(0.0).alias("low"),
            F.when(F.col("target") < F.col("source_size"), 0.0)
            .otherwise(F.lit(top * 1.000001) * F.col("scale") / F.col("least")).alias("high"),
        ), "multipliers",
    )
    x, tilt = F.col("c.size") / F.col("s.scale"), F.col("s.multiplier")
    rate = F.exp(F.least(F.lit(top), tilt * x))
    weight = F.col("c.n") * F.col("c.size") * rate
    for _ in range(MOST_STEPS):
        sums = (
            cells.where("size > 0").alias("c")
            .join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
            .groupBy("s.source", "target", "scale", "multiplier", "low", "high")
            .agg(F.sum(weight).alias("words"),
                 F.sum(F.when(tilt * x < top, weight * x).otherwise(0.0)).alias("slope"))
        )
        above = F.col("words") > F.col("target")
        sums = sums.withColumns({
            "high": F.when(above, F.least("high", "multiplier")).otherwise(F.col("high")),
            "low": F.when(above, F.col("low")).otherwise(F.greatest("low", "multiplier")),
            "newton": F.col("multiplier") + F.when(
                F.col("slope") > 0,
                (F.ln("target") - F.ln("words")) * F.col("words") / F.col("slope"),
            ),
        })
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        halved = F.when(
            F.col("low") == -math.inf, F.col("high") * 2 - 1
        ).otherwise((F.col("low") + F.col("high")) / 2)
        error = F.abs(F.col("words") - F.col("target")) / F.col("target")
        close = error <= TOLERANCE
        state = stored(sums.select(
            "source", "target", "scale",
            F.when(close, F.col("multiplier")).when(inside, F.col("newton"))
            .otherwise(halved).alias("multiplier"),
            "low", "high", error.alias("error"),
        ), "multipliers")
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    else:
        if worst > LEAST_TOLERANCE:
            raise RuntimeError(f"multipliers off by {worst:.2%} after {MOST_STEPS} steps")
    return state.select("source", "multiplier", "scale")


def _whole_copies(most: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        # largest documents first; what rounding leaves over goes to the next smaller size
        cells = cells.sort_values("size", ascending=False)
        owed, copies = 0.0, []
        for size, n, rate in zip(cells["size"], cells["n"], cells["rate"], strict=True):
            owed += n * rate * size
            k = min(max(round(owed / size), 0), most * n) if size else n
            owed -= k * size
            copies.append(k)
        return cells.assign(copies=copies)

    return run


def allocate(
    rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = int(MOST)
) -> DataFrame:
    """``rows`` (``row`` unique, ``doc_id, source, size``) with ``source_size, target, copies, taken``.

    ``most`` is the largest number of copies. ``taken`` is ``copies * size``. Sizes 0
    take nothing and stay once. In a source, the words taken miss the target by less than
    its smallest document. Of equal cells the first by a hash of ``doc_id`` get the odd
    copies; reruns over the same input agree.
    """
    cells = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    targets = stored(source_targets(cells, weights, most), "targets")
    solved = _balanced(cells, targets, most)
    rated = (
        cells.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .join(solved.alias("m"), F.col("c.source").eqNullSafe(F.col("m.source")), "left")
        .select(
            "c.source", "c.size", "n", "source_size", "target",
            F.when(F.col("target") <= 0, 0.0).when(F.col("scale").isNull(), float(most))
            .otherwise(F.exp(F.least(
                F.lit(math.log(most)), F.col("multiplier") * F.col("c.size") / F.col("scale")
            ))).alias("rate"),
        )
    )
    # a source has one cell for each size, so a group is bounded by the longest text
    copied = stored(rated.groupBy("source").applyInPandas(
        _whole_copies(most), f"{rated.select('source').schema.simpleString()[7:-1]}, size long, "
        "n long, source_size long, target double, rate double, copies long",
    ), "copies").withColumn("parts", F.ceil(F.sqrt("n")))
    # place of a document in its cell, counted in parts of about sqrt(n) rows
    dealt = (
        rows.alias("r").join(
            copied.alias("c"),
            F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size")),
        ).select("r.*", "n", "source_size", "target", "rate", F.col("c.copies").alias("cell_copies"),
                 F.pmod(F.xxhash64("r.doc_id", "r.row"), F.col("parts")).alias("part"))
    )
    dealt = stored(dealt, "dealt")
    cell = ["source", "size"]
    before = Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*cell, "part").agg(F.count("*").alias("k")).withColumn(
        "before", F.coalesce(F.sum("k").over(before), F.lit(0))
    )
    own = Window.partitionBy(*cell, "part").orderBy(F.xxhash64("doc_id"), "doc_id", "row")
    placed = dealt.withColumn("own", F.row_number().over(own) - 1).alias("d").join(
        starts.alias("s"),
        F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.size") == F.col("s.size"))
        & (F.col("d.part") == F.col("s.part")),
    )
    extra = (F.col("own") + F.col("before") < F.col("cell_copies") % F.col("n")).cast("long")
    return placed.select(
        "d.row", "d.doc_id", "d.source", "d.size", "source_size", "target", "rate",
        (F.floor(F.col("cell_copies") / F.col("n")) + extra).alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def _sized(docs: DataFrame, row: Column) -> DataFrame:
    return docs.select(
        row.alias("row"), "doc_id", "source", word_count("text").alias("size")
    )


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = int(MOST)) -> DataFrame:
    """One row for each row of ``docs``: its share in the mix (see ``allocate``).

    A null text has size 0, a null source is a source of its own. Repeated rows count each.
    An empty table gives an empty result.
    """
    rows = stored(_sized(docs, F.monotonically_increasing_id()), "sizes")
    return allocate(rows, weights, most)


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = int(MOST)) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns kept."""
    row, copies = fresh(docs, "_row", "_copies")
    kept = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    shares = allocate(stored(_sized(kept, F.col(row)), "sizes"), weights, most)
    shares = shares.where("copies > 0").select(
        F.col("row").alias(row), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(copies)
    )
    return kept.join(shares, row).withColumn(copies, F.explode(copies)).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
