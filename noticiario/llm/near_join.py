"""Documents joined by the Jaccard similarity of their word n-grams.

* Documents with the same set of n-grams form a class; classes are joined, not copies.
* An LSH forest finds candidates. In each tree a class has a path of MinHash values; classes
  with a common prefix of their paths are candidates. The forest begins with whole paths and
  shortens the prefix: the pairs found so far tell, by their similarity, what share of such
  pairs meets at the present length (a pair that meets with probability ``p`` stands for
  ``1 / p`` pairs), and as long as that is below the target recall in any stratum of
  similarity, the prefix is cut to the length at which it is not. Each length reads the stored
  paths, sorted into the nodes of the tries. In a node only classes whose whole signatures
  look similar enough are linked, each to one that is already linked, so a node of ``m``
  classes gives fewer than ``m`` links.
* Linked classes form clusters. The n-grams of a class are sent to its cluster once, and
  all pairs of a cluster are verified exactly there, by counting common n-grams; large
  clusters are cut in blocks, and each two blocks meet in a task of their own. What leaves
  a task is a number of links per class and fewer links than classes, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bounded_batches, fresh, stored
from .components import components

GRAM = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
RECALL = 0.999
SEEN = 0.95  # of pairs at the threshold, met at any prefix length that is tried
VALUES = 100  # of a signature, at least
# Pairs whose signatures agree by so many standard deviations less than pairs at the
# threshold are not followed: at similarity 0.8 and 100 values that is below 0.58.
DEVIATIONS = 5.5
NODE_BLOCK = 2048  # classes of a node that are compared in one task
CLUSTER_BLOCK = 512
U = W.U


def met(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """Probability that two classes share a prefix of this length in some tree."""
    return 1 - (1 - np.asarray(similarity, dtype=float) ** depth) ** trees


def prefix_depth(
    threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL
) -> int:
    """Longest prefix with which pairs at ``threshold`` meet in some tree at this recall.

    The forest never needs a shorter one.
    """
    for d in range(depth, 1, -1):
        if met(threshold, d, trees) >= recall:
            return d
    return 1


def next_depth(
    strata: dict[int, int], depth: int, least: int, threshold: float, trees: int, recall: float
) -> int:
    """Prefix length at which the pairs found so far would be found with the target recall.

    ``strata`` counts pairs by their share of equal values in hundredths, rounded down.
    Pairs below the threshold count as just at it, as their true similarity may be. Each
    stratum must reach the recall by itself. A length at which pairs at the threshold would
    seldom be seen proves nothing by finding none, so it is passed over. That is ``depth`` if
    all is well with it, and never less than ``least``.
    """
    for d in range(depth, least, -1):
        enough = all(
            met(max(threshold, s / 100), d, trees) >= recall for s, n in strata.items() if n
        )
        if enough and met(threshold, d, trees) >= SEEN:
            return d
    return least


def tree_count(
    threshold: float = THRESHOLD, depth: int = 1, trees: int = TREES, recall: float = RECALL
) -> int:
    """``trees``, or as many more as pairs at ``threshold`` need for this recall."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError(f"no forest finds pairs at {threshold} with recall {recall}")
    if 1 - (1 - threshold**depth) ** trees >= recall:
        return trees
    return math.ceil(math.log(1 - recall) / math.log1p(-(threshold**depth)))


def least_agreement(threshold: float, values: int) -> float:
    """Share of equal values below which a pair is not followed."""
    return threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / values) - 1e-9


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_517)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1), rng.integers(
        0, 1 << 63, n, dtype=np.uint64
    )


def gram_sets(w: W.Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text is one gram of its words."""
    h = w.hashes(0)
    grams = w.gram_hashes(h, n)
    out = []
    for first, last in zip(w.first.tolist(), w.last.tolist(), strict=True):
        if last - first >= n:
            out.append(np.unique(grams[first : last - n + 1]))
        elif last > first:
            part = h[first:last]
            out.append(W.mixed(W.range_hashes(part, np.array([0]), np.array([last - first]),
                                              W.WORD_BASE[1]) + U(last - first)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values (upper 32 bits) of a set of n-grams."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=U)
    for at in range(0, len(grams), 1024):
        part = (grams[at : at + 1024, None] ^ b) * a
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> U(32)).astype(np.uint32)


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.astype("<u8").tobytes(), digest_size=16).digest()


def _signed(n: int, values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(values)
        for batch in batches:
            for at, to, w in W.chunks(batch.column("text")):
                part = batch.slice(at, to - at)
                sets = gram_sets(w, n)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, a, b).tobytes() if len(s) else None for s in sets],
                             pa.binary()),
                ], names=["id", "key", "grams", "class", "signature"])

    return run


def _paths(trees: int, depth: int, prefix: int):
    """Trie nodes of each class at the length ``prefix``, from the paths in its signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(
                b"".join(batch.column("signature").to_pylist()), np.uint32
            ).reshape(batch.num_rows, -1)[:, : trees * depth]
            values = values.reshape(batch.num_rows, trees, depth).astype(U)
            node = np.full(values.shape[:2], 0, dtype=U) + np.arange(trees, dtype=U)
            for d in range(prefix):
                node = W.mixed(node * U(W.WORD_BASE[0]) + values[:, :, d])
            offsets = pa.array(np.arange(0, node.size + 1, trees), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("class"),
                pa.ListArray.from_arrays(offsets, pa.array(node.reshape(-1).view(np.int64))),
            ], names=["class", "nodes"])

    return run


def _meetings(rows: DataFrame, group: str, work, schema: str) -> DataFrame:
    """``work`` on the rows of whole meetings ``(group, i, j)``, with where each begins.

    Rows are dealt and sorted by these keys and streamed: a task holds one batch and one
    unfinished meeting of two blocks at a time, however many meetings it is dealt.
    """
    keys = [group, "i", "j"]
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(whole: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            columns = {k: whole.column(k).combine_chunks() for k in whole.column_names}
            return pa.RecordBatch.from_arrays(work(columns, np.append(starts, len(whole))), schema=fields)

        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            whole = part if held is None else pa.concat_tables([held, part])
            if not len(whole):
                continue
            new = np.ones(len(whole), dtype=bool)
            new[1:] = False
            for k in keys:
                column = whole.column(k).combine_chunks()
                changed = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
                new[1:] |= changed.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield done(whole.slice(0, int(starts[-1])), starts[:-1])
            held = whole.slice(int(starts[-1]))
        if held is not None:
            yield done(held, np.zeros(1, dtype=np.int64))

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def _spread(matrix: np.ndarray, alike) -> np.ndarray:
    """Links ``parent[i]`` of a search that visits each row once; ``alike(i, others)``."""
    left = np.arange(len(matrix))
    parent = np.full(len(matrix), -1)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            hit = alike(i, left)
            found = left[hit]
            parent[found] = i
            front += found.tolist()
            left = left[~hit]
    return parent


def _node_links(least: float):
    """Links between the classes of each trie node whose signatures agree enough.

    ``share`` is that of equal values, in hundredths. Nodes of two classes, nearly all of
    them, are compared together.
    """
    def run(columns: dict[str, pa.Array], bounds: np.ndarray) -> list[pa.Array]:
        rows = len(columns["class"])
        values = np.frombuffer(b"".join(columns["signature"].to_pylist()), np.uint32).reshape(rows, -1)
        sizes = np.diff(bounds)
        first = bounds[:-1][sizes == 2]
        alike = (values[first] == values[first + 1]).mean(axis=1) >= least
        child, parent = [first[alike] + 1], [first[alike]]
        for at, to in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist(), strict=True):
            own = values[at:to]
            links = _spread(own, lambda i, o, v=own: (v[o] == v[i]).mean(axis=1) >= least)
            linked = np.flatnonzero(links >= 0)
            child.append(at + linked)
            parent.append(at + links[linked])
        a, b = np.concatenate(child), np.concatenate(parent)
        share = np.floor(100 * (values[a] == values[b]).mean(axis=1) + 1e-9).astype(np.int64)
        return [columns["class"].take(pa.array(a)), columns["class"].take(pa.array(b)), pa.array(share)]

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of common n-gram counts, by products of 0/1 blocks of the shared n-grams."""
    sizes = [len(s) for s in sets]
    gram, column, count = np.unique(
        np.concatenate(sets), return_inverse=True, return_counts=True
    )
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count > 1  # a gram of one set adds to no pair
    place = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], place[column[use]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, (1 << 22) // max(1, len(sets)))
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        out += block @ block.T
    return out


def _verified(threshold: float):
    """Exact links in each meeting of a cluster: a row ``class, other, links`` for each class."""
    def run(columns: dict[str, pa.Array], bounds: np.ndarray) -> list[pa.Array]:
        classes = columns["class"].to_pylist()
        every = [np.frombuffer(s, "<u8") for s in columns["grams"].to_pylist()]
        copies, block, i, j = (columns[k].to_numpy() for k in ("copies", "block", "i", "j"))
        out: list[tuple] = []
        for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            # a class fetched from several rows of one id and text is taken once
            rows = sorted({classes[k]: k for k in range(at, to)}.items())
            rows = np.array([k for _, k in rows])
            sets = [every[k] for k in rows]
            sizes = np.array([len(s) for s in sets], dtype=np.float64)
            common = _common(sets).astype(np.float64)
            alike = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
            np.fill_diagonal(alike, False)
            if i[at] != j[at]:  # of two blocks only the pairs between them
                alike &= block[rows][:, None] != block[rows][None, :]
            parent = _spread(alike, lambda k, o, m=alike: m[k][o])
            links = alike @ copies[rows]
            other = np.where(parent >= 0, parent, np.arange(len(parent)))
            out += [(classes[rows[k]], classes[rows[other[k]]], int(links[k])) for k in np.flatnonzero(links)]
        kinds = (pa.binary(), pa.binary(), pa.int64())
        found = zip(*out, strict=True) if out else ([], [], [])
        return [pa.array(c, t) for c, t in zip(found, kinds, strict=True)]

    return run


def _gram_bytes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("class").to_pylist()
            for at, to, w in W.chunks(batch.column("text")):
                part = batch.slice(at, to - at)
                sets = gram_sets(w, n)
                # rows that share an id may hold another text: only the right one goes on
                right = pa.array([
                    set_digest(s) == c for s, c in zip(sets, wanted[at:to], strict=True)
                ], pa.bool_())
                yield pa.RecordBatch.from_arrays([
                    *[part.column(k) for k in ("class", "cluster", "copies", "size")],
                    pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                ], names=["class", "cluster", "copies", "size", "grams"]).filter(right)

    return run


def near_classes(
    docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD,
    doc_id: str = "doc_id", text: str = "text", recall: float = RECALL,
) -> DataFrame:
    """``id, class_id, n_links`` for each row of ``docs``.

    ``n_links`` counts the other rows with at least this similarity, copies included;
    ``class_id`` is the least id of the rows connected by such links (of the rows with an
    id, else null). Words are kept unchanged. A text of fewer than ``n`` words is one gram
    of all its words. Null and empty texts have no n-gram, no link, and their own id as
    class. Repeated rows are rows each, so they link to each other.
    """
    bounded_batches(docs.sparkSession)
    shortest = prefix_depth(threshold, TREES, DEPTH, recall)
    trees = tree_count(threshold, shortest, TREES, recall)
    values = max(VALUES, trees * DEPTH)
    asked = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    asked = asked.withColumn("key", F.xxhash64("text"))
    kind = asked.schema["id"].dataType.simpleString()
    signed = stored(asked.mapInArrow(
        _signed(n, values), f"id {kind}, key long, grams long, class binary, signature binary"
    ), "signatures")
    full = signed.where(F.col("class").isNotNull())
    # a class is fetched by the id and the hash of one of its texts, as rows can share an id
    member = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    classes = stored(
        full.groupBy("class").agg(
            F.min("id").alias("id"), F.min(member).alias("member"), F.count("*").alias("copies"),
            F.first("grams").alias("grams"), F.first("signature").alias("signature"),
        ), "classes",
    )
    depth, links = next_depth({}, DEPTH, shortest, threshold, trees, recall), None
    while True:
        found = stored(_links_at(classes, trees, depth, least_agreement(threshold, values)), "links")
        links = found if links is None else links.union(found)
        strata = {r["share"]: r["count"] for r in links.groupBy("share").count().collect()}
        shorter = next_depth(strata, depth, shortest, threshold, trees, recall)
        if shorter == depth:
            break
        depth = shorter
    links = links.select("a", "b")
    clusters = components(links, "clusters").toDF("class", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    members = stored(
        clusters.join(sizes, "cluster").join(
            classes.select("class", "copies", F.col("member.id").alias("member"),
                           F.col("member.key").alias("member_key")), "class"
        ), "members",
    )
    # the texts of the members, fetched once; by a shuffle however few they are, so that
    # the plan and its growth are the same at every size
    sent = asked.join(
        members.hint("shuffle_merge"),
        F.col("id").eqNullSafe(F.col("member")) & (F.col("key").eqNullSafe(F.col("member_key"))),
    ).select("text", "class", "cluster", "copies", "size")
    blocks = F.ceil(F.col("size") / CLUSTER_BLOCK).cast("int")
    grams = (
        sent.mapInArrow(_gram_bytes(n), "class binary, cluster binary, copies long, size long, grams binary")
        .withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int"))
        .withColumn("blocks", blocks).drop("size")
    )
    verified = stored(
        _meetings(_in_pairs(grams, "block", "blocks"), "cluster", _verified(threshold),
                  "class binary, other binary, links long"), "verified",
    )
    roots = components(verified.select(F.col("class").alias("a"), F.col("other").alias("b")), "roots")
    counts = verified.groupBy("class").agg(F.sum("links").alias("links"))
    rooted = classes.select("class", "id", "copies").join(
        roots.toDF("class", "root"), "class", "left"
    ).withColumn("root", F.coalesce("root", "class"))
    named = rooted.groupBy("root").agg(F.min("id").alias("class_id"))
    result = rooted.join(named, "root").join(counts, "class", "left").select(
        "class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return signed.where(F.col("class").isNull()).select(
        "id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    ).unionByName(full.select("id", "class").join(result, "class").drop("class"))


def _links_at(classes: DataFrame, trees: int, depth: int, least: float) -> DataFrame:
    """Links ``a, b, share`` of the classes that share a prefix of this length in some tree."""
    nodes = stored(
        classes.select("class", "signature").mapInArrow(
            _paths(trees, DEPTH, depth), "class binary, nodes array<bigint>"
        ).select("class", F.explode("nodes").alias("node")), "nodes",
    )
    # nodes with two classes or more
    large = nodes.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / NODE_BLOCK).cast("int")
    held = nodes.join(large, "node").withColumn(
        "block", F.pmod(F.xxhash64("class"), blocks).cast("int")
    ).withColumn("blocks", blocks)
    met = _in_pairs(held.drop("m"), "block", "blocks").join(
        classes.select("class", "signature"), "class"
    )
    return _meetings(met, "node", _node_links(least), "a binary, b binary, share long")


def _in_pairs(rows: DataFrame, block: str, blocks: str) -> DataFrame:
    """Each row in the meetings ``i <= j`` of its block with every block of its group.

    With one block that is the meeting (0, 0) alone; with more, a row goes to as many
    meetings as there are blocks.
    """
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    return rows.withColumn("_other", other).withColumns({
        "i": F.least(block, "_other"), "j": F.greatest(block, "_other"),
    }).drop("_other", blocks)


def keep_one(
    docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class (see ``near_classes``), all columns.

    The row with the least id stays (null last); of rows that share it, the first stored.
    Rows without a word are no copies of anything: all stay.
    """
    (row,) = fresh(docs, "_row")
    kept = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    ranked = kept.select(
        F.col(row).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    placed = stored(
        near_classes(ranked, n, threshold, "row")
        .join(ranked.select(F.col("row").alias("id"), "doc_id"), "id").select("class_id", "id", "doc_id"),
        "placed",
    )
    best = placed.groupBy("class_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("best"),
        F.count("*").alias("n"),
    ).where("n > 1")
    # those that go are far fewer than those that stay
    gone = placed.join(best, "class_id").where(F.col("id") != F.col("best.id"))
    return kept.join(gone.select(F.col("id").alias(row)), row, "left_anti").drop(row)
