"""Documents packed into token sequences by best fit, in a tree of rounds.

Pieces are dealt into groups of bounded size and packed best-fit decreasing in each
group. Bins that are nearly full are finished; the others become items of the next
round, in which ``FAN_IN`` times fewer groups meet, until one group is left or a round
no longer joins any two bins. A group never exceeds ``GROUP_ITEMS`` items on average, so
no task holds more, however many underfull bins there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bounded_batches, empty_if_null, groups_for, stored

GROUP_ITEMS = 40_000
FAN_IN = 8
SLACK = 4  # a bin with no more free tokens than this is finished at once
MOST_ROUNDS = 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, bin long, used long, offset long"


def _pieces(spec, capacity: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(spec.value).encode
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            docs, numbers, lengths, sums = [], [], [], []
            for doc, code in zip(batch["doc_id"], encode(batch["text"]), strict=True):
                code += end
                for k, at in enumerate(range(0, len(code), step)):
                    part = code[at : at + step]
                    docs.append(None if doc is None else int(doc))
                    numbers.append(k)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            numbers = np.asarray(numbers, dtype=np.int64)
            yield pd.DataFrame({
                "doc_id": pd.array(docs, dtype="Int64"), "piece": numbers.astype(np.int32),
                "start": numbers * capacity, "length": np.asarray(lengths, dtype=np.int64),
                "ids_crc32": np.asarray(sums, dtype=np.int64),
            })

    return run


def pieces(
    docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """The pieces of each document: its ids and ``end_id``, cut only if over ``capacity``.

    A null or empty text is one piece of one token. Repeated rows give repeated pieces.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(tokens.specification(tokenizer or tokens.default_path()))
    return docs.select(
        F.col(f"`{doc_id}`").cast("string").alias("doc_id"), empty_if_null(f"`{text}`").alias("text")
    ).mapInPandas(_pieces(spec, capacity, end_id), PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of each item, largest items first into the fullest bin.

    Open bins are kept by free room; a bit set of the rooms in use gives the least
    room that is large enough. Ties go by the order of the items.
    """
    bins = np.empty(len(sizes), dtype=np.int64)
    places = np.empty(len(sizes), dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + size
            held = by_room[room]
            chosen = held.pop()
            if not held:
                rooms &= ~(1 << room)
        else:
            chosen, room, made = made, capacity, made + 1
        bins[i], places[i] = chosen, capacity - room
        if left := room - size:
            by_room.setdefault(left, []).append(chosen)
            rooms |= 1 << left
    return bins, places


def _packer(capacity: int, turn: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # rows of one item stand together; items in an order that does not depend on arrival
        rows = rows.sort_values(["bin", "offset"], kind="stable")
        item, first = np.unique(rows["bin"].to_numpy(), return_index=True)
        counts = np.diff(np.append(first, len(rows)))
        sizes = rows["used"].to_numpy()[first]
        bins, places = best_fit(sizes, capacity)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        rows["offset"] = rows["offset"].to_numpy() + np.repeat(places, counts)
        rows["used"] = np.repeat(used[bins], counts)
        # a name that no other group or round gives: round, group, number
        rows["bin"] = np.repeat((((turn + 1) << 26 | int(key[0])) << 32) | bins, counts)
        return rows.drop(columns="grp")

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Pieces (see ``pieces``) with ``sequence_id`` and ``offset``, gapless from 0.

    No piece may be longer than ``capacity``. The stored pieces are numbered, so
    repeated rows and null ids are items like all others. Empty input, empty result.
    """
    spark = pieces.sparkSession
    left = stored(
        pieces.withColumns({
            "bin": F.monotonically_increasing_id(), "used": F.col("length"),
            "offset": F.lit(0).cast("long"),
        }), "pieces",
    )
    finished: list[DataFrame] = []
    items = left.count()
    groups, turn = groups_for(items, group_items), 0
    while items:
        packed = stored(
            left.withColumn("grp", F.pmod(F.xxhash64("bin"), F.lit(groups)).cast("int"))
            .groupBy("grp").applyInPandas(_packer(capacity, turn), PLACED),
            f"packed-{turn}",
        )
        open_bins = F.col("used") < capacity - SLACK
        before = items
        items = packed.where(open_bins).select("bin").distinct().count()
        if groups == 1 or not items or (turn and items > 0.99 * before) or turn == MOST_ROUNDS:
            finished.append(packed)
            break
        finished.append(packed.where(~open_bins))
        left = packed.where(open_bins)
        groups, turn = max(-(-groups // FAN_IN), groups_for(items, group_items)), turn + 1
    result = left if not finished else finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    return result.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.col("bin").alias("sequence_id"), "offset",
    )


def pack(
    docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """Cut documents into pieces and pack them: one row for each piece."""
    return pack_pieces(pieces(docs, capacity, tokenizer, end_id), capacity, group_items)


def sequences(
    docs: DataFrame, placed: DataFrame, capacity: int = 2048,
    tokenizer: str | None = None, end_id: int = 0,
) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (at most ``capacity``).

    Documents are encoded again and their pieces sent to their sequence. ``doc_id`` must
    be unique here, since a place is found by document and piece.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokens.specification(tokenizer or tokens.default_path()))

    def cut(batches):
        encode = tokens.encoder(spec.value).encode
        for batch in batches:
            rows = [
                (doc and int(doc), k, ids[at : at + capacity])
                for doc, code in zip(batch["doc_id"], encode(batch["text"]), strict=True)
                for ids in [np.append(np.frombuffer(code, "<u4"), end_id).astype(np.int32)]
                for k, at in enumerate(range(0, len(ids), capacity))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "ids"])

    bounded_batches(spark)
    held = docs.select(F.col("doc_id").cast("string"), empty_if_null("text").alias("text")).mapInPandas(
        cut, "doc_id long, piece int, ids array<int>"
    )
    return (
        held.join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"))
    )
