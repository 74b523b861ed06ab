"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MOST_ROUNDS = 40
# Nodes of more links than this are joined to their minimum by broadcast. The cut rises with
# the links, so that at most HOT_NODES nodes, of 16 to 40 bytes each, are above it.
HOT_LINKS = 10_000
HOT_NODES = 50_000


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``; ``root`` is the least node reached.

    Large-star and small-star steps in turn: each node points its larger (smaller and equal)
    neighbours to the least node it knows. The number of links never grows, hot nodes are
    pre-aggregated to one minimum, and the rounds needed follow the logarithm of the longest
    path. Every round is stored, so a lost executor repeats that round only. Links between
    equal nodes give a component of one node; null ends are ignored.
    """
    edges = stored(
        links.where("a IS NOT NULL AND b IS NOT NULL").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct(), label,
    )
    known = _content(edges)
    for _ in range(MOST_ROUNDS):
        cut = max(HOT_LINKS, (known[0] or 0) // HOT_NODES)
        hot = (known[-1] or 0) > cut
        # large star: every neighbour above a node goes to the least of its neighbours
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        joined = _with_least(both, cut, hot).withColumn("m", F.least("a", "m"))
        large = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(edges.where("a = b"))
        # small star: a node and its lower neighbours go to the least of them
        joined = _with_least(large, cut, hot)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            joined.select("a", F.col("m").alias("b"))
        ).distinct()
        edges = stored(small, label)
        before, known = known, _content(edges)
        if known == before:
            break
    else:
        raise RuntimeError(f"components not settled in {MOST_ROUNDS} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def _with_least(links: DataFrame, cut: int, hot: bool) -> DataFrame:
    """``a, b, m``: each link with the least ``b`` of its ``a``.

    The minima are pre-aggregated in the map tasks. If there are nodes with more than ``cut``
    links, few by the choice of the cut, their minima are broadcast, so that the links of a
    hot node stay where they are; all others are joined by shuffle.
    """
    if not hot:
        return links.join(links.groupBy("a").agg(F.min("b").alias("m")), "a")
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hot = least.where(F.col("n") > cut).select("a", F.col("m").alias("hot"))
    known = links.join(F.broadcast(hot), "a", "left")
    rest = known.where("hot IS NULL").select("a", "b").join(
        least.where(F.col("n") <= cut).select("a", "m"), "a"
    )
    return known.where("hot IS NOT NULL").select("a", "b", F.col("hot").alias("m")).union(rest)


def _content(edges: DataFrame) -> tuple:
    """Ends and hash sums of a table of distinct links, to see whether a round changed it,
    and the most links of a node."""
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    first, second = F.xxhash64("a", "b"), F.xxhash64("b", "a", F.lit(1))
    nodes = both.groupBy("a").agg(
        F.count("*").alias("n"), F.sum(first.cast("decimal(38,0)")).alias("s"), F.bit_xor(second).alias("x")
    )
    return tuple(nodes.agg(F.sum("n"), F.sum("s"), F.sum(F.col("x").cast("decimal(38,0)")), F.max("n")).first())
