"""Token ids in directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS`` bits, lowest first. Level 0 holds the first
chunk of every id of a segment; a bitmap tells which ids go on, and level 1 holds their
next chunks in order, and so on. A rank directory counts the set bits before every block
of a bitmap, so the place of an id on the next level is one directory entry plus the bits
of a single block: any token is read without decoding its neighbours.

A segment is one row of the stored table: whole documents in ascending id order, closed
at ``SEGMENT_TOKENS``. ``shard`` and ``segment`` give its place; ``first_token`` counts
the shard's tokens before it. The manifest has one row for each shard with the
number of tokens before the shard.

Level layout (little-endian), repeated for each level:
    u32 number of chunks, the chunks (one byte each),
    u32 number of bitmap bytes, the bitmap (lowest bit first),
    u32 number of directory entries, the entries (u32 each).
The last level has an empty bitmap and directory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticiario.session import shared_path

from . import tokens
from .common import bounded_batches, empty_if_null

CHUNK_BITS = 8
RANK_BLOCK_BYTES = 32  # bitmap bytes for each directory entry
SEGMENT_TOKENS = 1 << 18

SEGMENTS = (
    "shard int, segment int, first_token long, n_tokens long, doc_ids array<bigint>, "
    "doc_tokens array<int>, codes binary"
)


@dataclass
class Level:
    chunks: np.ndarray
    bitmap: np.ndarray
    ranks: np.ndarray

    def goes_on(self, i: int) -> bool:
        return len(self.bitmap) > 0 and bool(self.bitmap[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """Set bits before bit ``i``."""
        block = (i >> 3) // RANK_BLOCK_BYTES
        part = self.bitmap[block * RANK_BLOCK_BYTES : (i >> 3) + 1].copy()
        part[-1] &= (1 << (i & 7)) - 1
        return int(self.ranks[block]) + int(np.bitwise_count(part).sum())


def encode(ids: np.ndarray) -> bytes:
    """Codes of unsigned 32-bit ids."""
    rest, out = ids.astype("<u4"), []
    while True:
        chunks = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        more = rest >= 1 << CHUNK_BITS
        if more.any():
            bitmap = np.packbits(more, bitorder="little")
            set_bits = np.bitwise_count(bitmap)
            sums = np.concatenate(([0], np.cumsum(set_bits, dtype=np.int64)))
            ranks = sums[:-1:RANK_BLOCK_BYTES].astype("<u4")
        else:
            bitmap, ranks = np.zeros(0, np.uint8), np.zeros(0, "<u4")
        for part in (chunks, bitmap, ranks):
            out += [struct.pack("<I", len(part)), part.tobytes()]
        if not len(bitmap):
            return b"".join(out)
        rest = rest[more] >> CHUNK_BITS


def levels(codes: bytes) -> list[Level]:
    """Views of the stored arrays; nothing is decoded."""
    out, at = [], 0
    while at < len(codes):
        parts = []
        for kind in (np.uint8, np.uint8, np.dtype("<u4")):
            (n,) = struct.unpack_from("<I", codes, at)
            parts.append(np.frombuffer(codes, dtype=kind, count=n, offset=at + 4))
            at += 4 + n * np.dtype(kind).itemsize
        out.append(Level(*parts))
    return out


def token_at(stored: list[Level], i: int) -> int:
    """The ``i``-th id, by rank look-ups alone."""
    value, shift = 0, 0
    for level in stored:
        value |= int(level.chunks[i]) << shift
        if not level.goes_on(i):
            return value
        i, shift = level.rank(i), shift + CHUNK_BITS
    raise IndexError(i)


def decode(codes: bytes) -> np.ndarray:
    """All ids of a segment."""
    stored = levels(codes)
    value = np.zeros(0, "<u4")
    for level in reversed(stored):
        longer = value
        value = level.chunks.astype("<u4")
        if len(level.bitmap):
            more = np.unpackbits(level.bitmap, count=len(value), bitorder="little").astype(bool)
            value[more] |= longer << CHUNK_BITS
    return value


def _segments(spec, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_texts = tokens.encoder(spec.value).encode
        shard, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        ids, sizes, parts = [], [], []
        number = before = 0

        def close():
            nonlocal number, before
            codes = np.frombuffer(b"".join(parts), "<u4")
            row = pd.DataFrame({
                "shard": [shard], "segment": [number], "first_token": [before],
                "n_tokens": [len(codes)], "doc_ids": [list(ids)],
                "doc_tokens": [list(sizes)], "codes": [encode(codes)],
            })
            number, before = number + 1, before + len(codes)
            for held in (ids, sizes, parts):
                held.clear()
            return row

        for batch in batches:
            held = 0
            for doc, code in zip(batch["doc_id"], encode_texts(batch["text"]), strict=True):
                ids.append(None if doc is None else int(doc))
                parts.append(code + end)
                sizes.append(len(parts[-1]) // 4)
                held = held + sizes[-1] if len(sizes) > 1 else sum(sizes)
                if held >= SEGMENT_TOKENS:
                    yield close()
                    held = 0
            if parts and sum(sizes) >= SEGMENT_TOKENS:
                yield close()
        if parts:
            yield close()

    return run


def write(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1,
    text: str = "text", doc_id: str = "doc_id", shards: int | None = None,
) -> None:
    """Encode whole texts and write segments and manifest below ``path``.

    Every document gets ``end_id`` after its own ids; a null or empty text is that id
    alone. Shards follow each other in ascending ``doc_id``, null ids last; rows that
    repeat an id stand next to each other in any order, and may fill several shards.
    A document is never cut: one very long text makes one long segment. An empty table
    gives an empty file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(tokens.specification(tokenizer or tokens.default_path()))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), empty_if_null(f"`{text}`").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranged = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select(F.col("doc_id").cast("string"), "text").mapInPandas(
        _segments(spec, end_id), SEGMENTS
    ).write.parquet(f"{path}/segments")
    sums = spark.read.parquet(f"{path}/segments").groupBy("shard").agg(
        F.sum("n_tokens").alias("n_tokens")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.withColumn(
        "tokens_before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    ).write.parquet(f"{path}/manifest")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Stored segments with ``start``, their first token's place in the whole file.

    The manifest has one row for each shard (shuffle partitions of the writer), so
    it may be broadcast.
    """
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "tokens_before")
    return (
        spark.read.parquet(f"{path}/segments").join(F.broadcast(manifest), "shard")
        .withColumn("start", F.col("tokens_before") + F.col("first_token"))
        .drop("tokens_before")
    )


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            ids = decode(row.codes).tobytes()
            sizes = np.asarray(row.doc_tokens, dtype=np.int64)
            ends = np.cumsum(sizes)
            yield pd.DataFrame({
                "doc_id": pd.array(
                    [None if pd.isna(d) else int(d) for d in row.doc_ids], dtype="Int64"
                ),
                "start": row.start + ends - sizes,
                "n_tokens": sizes,
                "ids_crc32": [
                    zlib.crc32(ids[4 * (e - n) : 4 * e])
                    for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)
                ],
            })


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Each document's place, length and checksum, decoded from the file."""
    bounded_batches(spark)
    return segments(spark, path).select("start", "doc_ids", "doc_tokens", "codes").mapInPandas(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def tokens_at(spark: SparkSession, path: str, places: DataFrame, place: str = "position") -> DataFrame:
    """Ids at given places of the file: ``position``, ``token``; places outside are left out.

    Places meet their segment by range: both are dealt to buckets of the file, a segment
    to each bucket it touches, and only the named ids are read from its codes.
    """
    bounded_batches(spark)
    width = SEGMENT_TOKENS
    held = segments(spark, path).withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n_tokens") - 1) / width)
    )))
    wanted = places.select(F.col(f"`{place}`").cast("long").alias("position")).where(
        "position >= 0"
    ).withColumn("bucket", F.floor(F.col("position") / width))
    met = (
        wanted.alias("w")
        .join(held.select("bucket", "start", "n_tokens", "shard", "segment").alias("s"), "bucket")
        .where("position >= start and position < start + n_tokens")
        .groupBy("shard", "segment").agg(F.collect_set("position").alias("positions"))
    )

    def read(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                stored = levels(row.codes)
                yield pd.DataFrame({
                    "position": list(row.positions),
                    "token": [token_at(stored, int(p) - row.start) for p in row.positions],
                })

    return (
        segments(spark, path).select("shard", "segment", "start", "codes")
        .join(met, ["shard", "segment"]).select("start", "codes", "positions")
        .mapInPandas(read, "position long, token long")
    )


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to a fresh place in the shared folder and read every document back."""
    path = shared_path(docs.sparkSession, "llm-token-codes")
    write(docs, path, tokenizer, end_id)
    return documents(docs.sparkSession, path)
