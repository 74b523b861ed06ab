"""Ranked lexical search turned round: documents stream past an index of the queries.

The queries ("items") are few next to the documents, so the inverted index is built over
their terms and broadcast, in blocks of bounded size. One pass turns each document into the
counts of the index's terms in it; the counts give the document frequencies. A second pass
sends those counts through the index and keeps, in each task, a bounded heap of the best
documents of every item; the heaps are merged.

Terms are the longest runs of ASCII letters and digits and of characters beyond ASCII, A-Z
lower-cased. They are matched by two 64-bit hashes of their bytes. All scores are exact
64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, empty_if_null, positions, stored
from .words import BYTE_BASE, U, Words, chunks, mixed, range_hashes

BEST = 20
# An index block holds items of about this many terms, so that it stays below some 20 MB.
BLOCK_TERMS = 200_000
# Scores of documents by items that are worked out at once (8 bytes each).
CELLS = 1 << 20
# Candidates that a task collects before it cuts them to the heaps.
BUFFER = 1 << 18
# Heaps are merged in this many parts of the tasks first.
MERGES = 32

# Byte by byte: separators become blanks, A-Z become a-z, bytes beyond ASCII stay.
FOLD = np.full(256, 0x20, dtype=np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def folded(texts: pa.Array) -> pa.Array:
    """The texts with separators as blanks and A-Z lower-cased; null becomes empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    plain = pa.py_buffer(FOLD[np.frombuffer(data, dtype=np.uint8)])
    return pa.Array.from_buffers(
        pa.large_binary(), len(texts), [None, offsets, plain], offset=texts.offset
    )


@dataclass
class Index:
    """Inverted index of some items: sorted terms, and which items have each how often.

    ``terms`` and ``checks`` are the two hashes of each term; the postings of term ``t`` are
    ``items[starts[t]:starts[t + 1]]`` with their ``repeats``.
    """

    terms: np.ndarray
    checks: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    repeats: np.ndarray
    size: int

    @classmethod
    def of(cls, texts: list[str | None]) -> Index:
        first, second, owner = [], [], []
        for at, _, words in chunks(folded(pa.array(texts, pa.large_string()))):
            first.append(words.hashes(0))
            second.append(words.hashes(1))
            owner.append(at + words.text_of)
        h, g = (np.concatenate(x) if x else np.zeros(0, U) for x in (first, second))
        item = np.concatenate(owner) if owner else np.zeros(0, int)
        order = np.lexsort((item, g, h))
        h, g, item = h[order], g[order], item[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        posting = new.copy()
        posting[1:] |= item[1:] != item[:-1]
        at = np.flatnonzero(posting)
        return cls(
            h[new], g[new], np.append(np.flatnonzero(new[at]), len(at)), item[at],
            np.diff(np.append(at, len(h))), len(texts),
        )

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms of the index, and which terms."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.terms) or not len(words):
            return none, none
        h = words.hashes(0)
        place = np.searchsorted(self.terms, h)
        place[place == len(self.terms)] = 0
        hit = np.flatnonzero(self.terms[place] == h)
        starts, ends = words.starts[hit], words.ends[hit]
        g = range_hashes(words.data.astype(U), starts, ends, BYTE_BASE[1])
        g = mixed(g + (ends - starts).astype(U) * U(0xFF51AFD7ED558CCD))
        place = place[hit]
        # terms whose first hashes are equal lie side by side
        while True:
            wrong = self.checks[place] != g
            further = np.minimum(place + 1, len(self.terms) - 1)
            moves = wrong & (self.terms[further] == self.terms[place]) & (further > place)
            if not moves.any():
                return hit[~wrong], place[~wrong]
            place = np.where(moves, further, place)


def _counts(index: Index, texts: pa.Array) -> tuple[np.ndarray, list, list]:
    """For each text: its number of terms, its terms of the index, and how often each occurs."""
    lengths, terms, times = np.zeros(len(texts), dtype=np.int64), [], []
    for at, to, words in chunks(folded(texts)):
        lengths[at:to] = words.counts
        hit, place = index.places(words)
        width = max(1, len(index.terms))
        key, tf = np.unique(words.text_of[hit] * width + place, return_counts=True)
        ends = np.searchsorted(key, np.arange(1, to - at) * width)
        terms += np.split((key % width).astype(np.int32), ends)
        times += np.split(tf.astype(np.int32), ends)
    return lengths, terms, times


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray, best: int):
    """Order by item, falling score, rising document (unknown ones last); ``best`` an item."""
    order = np.lexsort((doc, ~known, -score, item))
    item = item[order]
    first = np.searchsorted(item, item)  # where the item begins
    return order[np.arange(len(item)) - first < best]


class _Heaps:
    """The best documents of every item so far, with a score that others must reach."""

    def __init__(self, items: int, best: int):
        self.best, self.least = best, np.ones(items, dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        self.kept = [none, none, none, np.zeros(0, dtype=bool)]  # item, score, doc, known
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        self.waiting.append([item, scores[doc, item], docs[doc], known[doc]])
        self.size += len(item)
        if self.size > BUFFER:
            self.cut()

    def cut(self) -> None:
        columns = [np.concatenate(c) for c in zip(self.kept, *self.waiting, strict=True)]
        keep = _best(*columns, self.best)
        self.kept, self.waiting, self.size = [c[keep] for c in columns], [], 0
        item, score = self.kept[:2]
        full = np.flatnonzero(np.bincount(item, minlength=len(self.least)) == self.best)
        last = np.searchsorted(item, full, side="right") - 1
        self.least[full] = np.maximum(1, score[last])


def _scores(index: Index, weight: np.ndarray, doc, term, tf, m, n: int) -> np.ndarray:
    """Scores of ``n`` documents by items, from their (doc, term, tf) rows."""
    out = np.zeros(n * index.size, dtype=np.int64)
    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    many = index.starts[term + 1] - index.starts[term]
    row = np.repeat(np.arange(len(term)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + index.starts[term][row]
    np.add.at(out, doc[row] * index.size + index.items[place], value[row] * index.repeats[place])
    return out.reshape(n, index.size)


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, block_terms: int = BLOCK_TERMS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents of each item, over all documents.

    Only scores above 0 count; equal scores go by ascending ``doc_id`` (an integer; null
    last). Rows with the same ``doc_id`` are documents each, items with the same ``item_id``
    items each. Null and empty texts have no terms: such documents are not counted, such
    items get no rows. Without documents or items the result is empty. Other columns are
    ignored. The documents are read once for each block of items.
    """
    bounded_batches(docs.sparkSession)
    terms = F.size(F.regexp_extract_all(empty_if_null("text"), F.lit("[0-9A-Za-z\x80-\U0010ffff]+"), F.lit(0)))
    numbered = positions(
        items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
        .withColumn("_hash", F.xxhash64("item_id", "text")),
        [F.col("_hash"), F.col("item_id")], "search-items",
    )
    sized = numbered.withColumn("_terms", terms.cast("long")).withColumn(
        "_range", F.floor(F.col("position") / 1000)
    )
    before = sized.groupBy("_range").agg(F.sum("_terms").alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    ).drop("_n")
    inside = Window.partitionBy("_range").orderBy("position")
    blocked = stored(
        sized.join(before, "_range").withColumn(
            "block", F.floor((F.col("_before") + F.sum("_terms").over(inside) - F.col("_terms"))
                             / block_terms)
        ).select("block", "position", "item_id", "text"), "search-blocks",
    )
    last = blocked.agg(F.max("block")).first()[0]
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                         F.col(f"`{text}`").alias("text"))
    results = [
        _search_block(source, blocked.where(F.col("block") == b), best)
        for b in range(0 if last is None else last + 1)
    ]
    if not results:
        return blocked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                              F.lit(0).cast("long").alias("score"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _search_block(source: DataFrame, block: DataFrame, best: int) -> DataFrame:
    spark = source.sparkSession
    # bounded: items of about BLOCK_TERMS terms
    rows = block.select("position", "text").orderBy("position").collect()
    index = Index.of([r["text"] for r in rows])
    shared = spark.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, term, tf = _counts(shared.value, b.column("text"))
            ends = np.concatenate(([0], np.cumsum([len(t) for t in term]))).astype(np.int32)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n)]
                + [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in flat],
                ["doc_id", "n", "terms", "tf"],
            )

    counted = stored(
        source.mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<int>")
        .where("n > 0"), "search-counts",
    )
    total = counted.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = total["n"], total["l"] or 1
    weight = np.zeros(len(index.terms), dtype=np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    weights = spark.sparkContext.broadcast(weight)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        heaps = _Heaps(own.size, best)
        step = max(1, CELLS // max(1, own.size))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                lists, times = b.column("terms"), b.column("tf")
                sizes = np.diff(lists.offsets.to_numpy())
                m = 75 + (25 * b.column("n").to_numpy() * n_docs) // n_terms
                scores = _scores(
                    own, weights.value, np.repeat(np.arange(b.num_rows), sizes),
                    lists.flatten().to_numpy().astype(np.int64),
                    times.flatten().to_numpy().astype(np.int64), m, b.num_rows,
                )
                ids = b.column("doc_id")
                heaps.add(scores, ids.fill_null(0).to_numpy(zero_copy_only=False),
                          ids.is_valid().to_numpy(zero_copy_only=False))
        heaps.cut()
        item, score, doc, known = heaps.kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(doc, mask=~known), pa.array(score)], ["item", "doc_id", "score"]
        )

    heaps = counted.mapInArrow(rank, "item long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    heaps = heaps.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    for keys in (["item", "part"], ["item"]):
        heaps = heaps.withColumn(
            "rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ).where(F.col("rank") <= best)
    first = rows[0]["position"] if rows else 0
    return heaps.withColumn("position", F.col("item") + first).join(
        block.select("position", "item_id"), "position"
    ).select("item_id", "rank", "doc_id", "score")
