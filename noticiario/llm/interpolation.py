"""Scores of texts by an n-gram model with deleted interpolation.

The probability of a token is a mix of the maximum-likelihood estimates of all orders, down
to one part for every word of the vocabulary and one for unknown ones. The weights of the mix
depend on how often the longest context occurs (a bucket for each power of two) and are
learnt by expectation-maximisation: training texts fall into two halves, and the tokens of
each half are predicted with the counts of the other.

How it runs: texts are gathered in chunks of a few MB. Each chunk asks for the counts of its
distinct n-grams, as sorted 64-bit hashes, each with its own counts; the requests are
shuffled by ranges of the hash, added up, and the totals go back to the chunks in the order
in which they were asked for, so no n-gram is sent twice from a chunk and none comes back.
A hot n-gram is one entry a chunk. The chunks then know the counts of all their tokens, which
is all that learning and scoring need. For learning, tokens are counted in cells of nearly
equal likelihood ratios; there are at most ``MOST_CELLS`` of them whatever the input is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, empty_if_null, stored
from .words import U, chunks, mixed

ORDER = 2
# Text of a chunk; one longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
# Text whose n-grams are added up at once; there are as many ranges of hashes as that takes.
RANGE_BYTES = 16 << 20
# Context frequencies 0, 1, 2-3, 4-7, ...
BUCKETS = 64
MOST_CELLS = 1 << 20
ROUNDS = 200
SETTLED = 1e-7  # change of the mean log-likelihood that ends the rounds

# A-Z become a-z; all other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

END, START = U(0x8F1BBCDCBFA53E0B), U(0xCA62C1D6D6D9E3B5)
STEP = U(0x9FB21C651E98DF25)
LEVEL = U(3)  # the last two bits of a key tell its order

CODEC = pa.Codec("zstd")


def packed(counts: np.ndarray) -> bytes:
    """Whole numbers from 0 in a byte each; from 255 on in eight more behind."""
    many = counts[counts >= 255]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + many.astype("<u8").tobytes()


def unpacked(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` numbers at the start of ``data``, and the data behind them."""
    out = data[:n].astype(np.int64)
    many = np.flatnonzero(data[:n] == 255)
    end = n + 8 * len(many)
    out[many] = np.frombuffer(data[n:end].tobytes(), dtype="<u8")
    return out, data[end:]


def shrunk(*parts: bytes) -> bytes:
    """Parts joined and compressed, behind their joint length."""
    whole = b"".join(parts)
    return len(whole).to_bytes(8, "little") + CODEC.compress(whole, asbytes=True)


def grown(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(CODEC.decompress(data[8:], size, asbytes=True), dtype=np.uint8)


class Tokens:
    """The n-grams of some texts: ``keys[k]`` hashes the ``k + 1`` tokens up to each token."""

    def __init__(self, texts: pa.Array, order: int):
        tokens, counts = [], []
        for _, _, words in chunks(texts):
            at = words.last + np.arange(len(words.counts))  # each text ends with END
            out = np.empty(len(words) + len(at), dtype=U)
            inside = np.ones(len(out), dtype=bool)
            inside[at] = False
            out[at], out[inside] = END, words.hashes(0)
            tokens.append(out)
            counts.append(words.counts + 1)
        none = np.zeros(0, dtype=np.int64)
        self.counts = np.concatenate(counts) if counts else none
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        token = np.concatenate(tokens) if tokens else none.astype(U)
        key, self.keys = token, []
        for k in range(order):
            if k:
                key = mixed(self.before(key, START) * STEP + token)
            self.keys.append((key & ~LEVEL) | U(k))

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """The value of the token before; ``first`` for the first token of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Number of the hash range; rises with the key."""
    return ((keys >> U(32)) * U(ranges)) >> U(32)


def _chunked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_bytes = 0

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_pydict({
                "bytes": pa.array([held_bytes], pa.int64()),
                "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            })

        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            _, offsets, data = texts.buffers()
            if data is not None:
                data = pa.py_buffer(FOLD[np.frombuffer(data, dtype=np.uint8)])
            texts = pa.Array.from_buffers(
                pa.large_binary(), len(texts), [None, offsets, data], offset=texts.offset
            )
            ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            b = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("half"), texts], ["doc_id", "half", "text"]
            )
            at = 0
            while at < len(texts):
                to = int(np.searchsorted(ends, ends[at] + size - held_bytes, side="right")) - 1
                to = min(len(texts), max(at + (not held), to))
                if to > at:
                    held.append(b.slice(at, to - at))
                    held_bytes += int(ends[to] - ends[at])
                if to < len(texts) or held_bytes >= size:
                    yield row()
                    held, held_bytes = [], 0
                at = to
        if held:
            yield row()

    return run


def _docs_of(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _distinct(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a chunk once, rising, and where each token's keys are among them."""
    keys, place = np.unique(np.concatenate(tokens.keys), return_inverse=True)
    return keys, place


def _requests(order: int, ranges: int):
    """Chunks to the keys they ask for, by range, with their own counts in each half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("docs"), strict=True):
                docs = _docs_of(blob.as_py())
                tokens = Tokens(docs.column("text"), order)
                keys, place = _distinct(tokens)
                half = np.tile(np.repeat(docs.column("half").to_numpy(), tokens.counts), order)
                own = [np.bincount(place[half == h], minlength=len(keys)) for h in (0, 1)]
                group = _range_of(keys, ranges)
                ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(keys))
                at, rows = 0, []
                for to in ends.tolist() if len(keys) else []:
                    steps = np.diff(keys[at:to], prepend=U(0))
                    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T
                    rows.append((int(group[at]), chunk, to - at, shrunk(
                        packed(own[0][at:to]), packed(own[1][at:to]), planes.tobytes())))
                    at = to
                names = ["range", "chunk", "n", "data"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
                )

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests, in order of their range, to the totals of the keys in both halves.

    One more row a range, with chunk null, has the number of words of the training texts
    and the tokens of both halves.
    """

    def answer(number: int, rows: list[tuple]) -> pa.RecordBatch:
        keys, own = [], [[], []]
        for _, n, data in rows:
            rest = grown(data)
            for h in (0, 1):
                counts, rest = unpacked(rest, n)
                own[h].append(counts)
            planes = rest.reshape(8, n).T
            keys.append(np.cumsum(np.ascontiguousarray(planes).view("<u8").ravel(), dtype=U))
        keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = []
        for h in (0, 1):
            out = np.zeros(len(keys), dtype=np.int64)
            np.add.at(out, place, np.concatenate(own[h]))
            total.append(out)
        word = (keys & LEVEL) == 0
        numbers = [int(((total[0] + total[1]) > 0)[word].sum()), *(int(t[word].sum()) for t in total)]
        cuts = np.cumsum([n for _, n, _ in rows])[:-1]
        found = [
            shrunk(*(packed(t[p]) for t in total)) for p in np.split(place, cuts)
        ]
        many = len(rows)
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([c for c, _, _ in rows] + [None], pa.int64()),
            "range": pa.array([number] * (many + 1), pa.int64()),
            "n": pa.array([n for _, n, _ in rows] + [0], pa.int64()),
            "data": pa.array([*found, None], pa.binary()),
            **{name: pa.array([0] * many + [v], pa.int64())
               for name, v in zip(("words", "n0", "n1"), numbers, strict=True)},
        })

    number, rows = None, []
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("range", "chunk", "n", "data")]
        for r, *row in zip(*columns, strict=True):
            if rows and r != number:
                yield answer(number, rows)
                rows = []
            number = r
            rows.append(tuple(row))
    if rows:
        yield answer(number, rows)


@dataclass
class Mix:
    """What scoring needs besides a token's counts.

    ``weights[b]`` mixes the orders for contexts of bucket ``b``: first the uniform part, then
    single tokens, then pairs, and so on.
    """

    words: int
    halves: tuple[int, int]
    order: int = ORDER
    weights: np.ndarray = field(default=None)
    rounds: int = 0

    @property
    def uniform(self) -> float:
        return 1.0 / (self.words + 1)

    def buckets(self, context: np.ndarray) -> np.ndarray:
        out = np.zeros(len(context), dtype=np.int64)
        some = context > 0
        out[some] = np.minimum(np.frexp(context[some].astype(float))[1], BUCKETS - 1)
        return out

    def estimates(self, counts: list[np.ndarray], tokens: Tokens, n: int, texts: int):
        """Bucket of each token, and its estimates of the orders from 1 on.

        ``counts`` are those of the n-grams up to each token, ``n`` all tokens and ``texts``
        all texts that were counted.
        """
        context = np.full(len(counts[0]), n)
        found = []
        for k, count in enumerate(counts):
            if k:
                context = tokens.before(counts[k - 1], texts)
            found.append(count / np.maximum(context, 1))
        return self.buckets(context), found

    def log10(self, counts: list[np.ndarray], tokens: Tokens, texts: int) -> np.ndarray:
        bucket, found = self.estimates(counts, tokens, sum(self.halves), texts)
        weights = self.weights[bucket]
        p = weights[:, 0] * self.uniform
        for k, estimate in enumerate(found):
            p += weights[:, k + 1] * estimate
        return np.log10(p)


def levels_of(order: int) -> int:
    """Steps of one estimate's ratio to the uniform one, so that all cells are few enough."""
    return int((MOST_CELLS / BUCKETS) ** (1 / order))


def _level(ratio: np.ndarray, levels: int) -> np.ndarray:
    """0 for none, else the step of the logarithm; the outer steps are open."""
    width = max(0.5, 96 / (levels - 1))
    some = ratio > 0
    out = np.zeros(len(ratio), dtype=np.int64)
    step = np.floor(np.log2(ratio[some]) / width) + levels // 2
    out[some] = np.clip(step, 1, levels - 1)
    return out


def _cells(mix: Mix, tokens: Tokens, counts: list, half: np.ndarray) -> tuple:
    """Cells of the tokens of training texts, each predicted by the other half.

    Returns cells, tokens in them, and the sums of the logarithms of the ratios.
    """
    levels, cells, logs = levels_of(mix.order), [], []
    for h in (0, 1):
        other = 1 - h
        texts = counts[0][other][tokens.ends[0] - 1]
        bucket, found = mix.estimates([c[other] for c in counts], tokens, mix.halves[other], texts)
        mine = np.repeat(half == h, tokens.counts)
        cell, log = bucket[mine], []
        for estimate in found:
            ratio = estimate[mine] / mix.uniform
            cell = cell * levels + _level(ratio, levels)
            log.append(np.log(ratio, out=np.zeros(len(ratio)), where=ratio > 0))
        cells.append(cell)
        logs.append(log)
    cell, place, n = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    sums = [np.bincount(place, np.concatenate(x), len(cell)) for x in zip(*logs, strict=True)]
    return cell, n, sums


def _joined(mix: Mix):
    """Chunks with their answers to the counts of all tokens, and to the cells for learning."""
    order = mix.order

    def result(blob: bytes, answers: list[tuple]) -> pa.RecordBatch:
        docs = _docs_of(blob)
        tokens = Tokens(docs.column("text"), order)
        _, place = _distinct(tokens)
        parts = [[], []]
        for n, data in answers:
            rest = grown(data)
            for h in (0, 1):
                counts, rest = unpacked(rest, n)
                parts[h].append(counts)
        total = [np.concatenate(p)[place].reshape(order, -1) for p in parts]
        counts = [[t[k] for t in total] for k in range(order)]
        cell, n, sums = _cells(mix, tokens, counts, docs.column("half").to_numpy())
        return pa.RecordBatch.from_pydict({
            "docs": pa.array([docs.column("doc_id").to_pylist()], pa.list_(docs.schema.field("doc_id").type)),
            "half": pa.array([docs.column("half").to_numpy()], pa.list_(pa.int64())),
            "tokens": pa.array([tokens.counts], pa.list_(pa.int64())),
            "texts": pa.array([int(sum(t[0][tokens.ends[0] - 1] for t in total))], pa.int64()),
            "counts": pa.array([shrunk(*(packed(a + b) for a, b in counts))], pa.binary()),
            "cells": pa.array([cell], pa.list_(pa.int64())),
            "n": pa.array([n], pa.list_(pa.int64())),
            "logs": pa.array([np.array(sums).ravel()], pa.list_(pa.float64())),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, blob, answers = None, None, []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("chunk", "n", "data")]
            for c, n, data in zip(*columns, strict=True):
                if c != chunk:
                    if chunk is not None:
                        yield result(blob, answers)
                    chunk, blob, answers = c, data, []
                else:
                    answers.append((n, data))
        if chunk is not None:
            yield result(blob, answers)

    return run


def learn(mix: Mix, cells: np.ndarray, n: np.ndarray, logs: np.ndarray) -> Mix:
    """Weights of the mix by expectation-maximisation over the cells.

    ``logs[:, k]`` is the mean logarithm of the ratio of order ``k + 1`` to the uniform
    estimate in each cell. A bucket without held-out tokens takes the weights of the next
    rarer one; the uniform part never falls to nothing.
    """
    levels, order = levels_of(mix.order), mix.order
    ratios = np.ones((len(cells), order + 1))
    rest = cells.copy()
    for k in reversed(range(order)):
        ratios[:, k + 1] = np.where(rest % levels > 0, np.exp(logs[:, k]), 0.0)
        rest = rest // levels
    weights = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    before = -np.inf
    for rounds in range(1, ROUNDS + 1):
        parts = weights[rest] * ratios
        whole = parts.sum(axis=1)
        log = float((n * np.log(whole)).sum() / max(1, n.sum()))
        share = np.zeros_like(weights)
        np.add.at(share, rest, parts * (n / whole)[:, None])
        # one held-out token for the uniform part, so that no unseen text is impossible
        share[:, 0] += 1.0
        weights = share / share.sum(axis=1, keepdims=True)
        if log - before < SETTLED:
            break
        before = log
    seen = np.isin(np.arange(BUCKETS), rest)
    for b in range(1, BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1]
    mix.weights, mix.rounds = weights, rounds
    return mix


def _scored(mix: Mix):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(mix.halves)
        for batch in batches:
            for row in range(batch.num_rows):
                own = {c: batch.column(c)[row] for c in ("docs", "half", "tokens", "texts", "counts")}
                ids, half = own["docs"].values, own["half"].values.to_numpy()
                many = own["tokens"].values.to_numpy()
                tokens = Tokens.__new__(Tokens)
                tokens.counts, tokens.ends = many, np.cumsum(many)
                tokens.starts = tokens.ends - many
                rest, counts = grown(own["counts"].as_py()), []
                for _ in range(mix.order):
                    c, rest = unpacked(rest, int(many.sum()))
                    counts.append(c)
                score = mix.log10(counts, tokens, own["texts"].as_py())
                base = np.log10((counts[0] + 1) / (total + mix.words + 1))
                add = lambda x: np.add.reduceat(x, tokens.starts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids, "held_out": pa.array(half < 0),
                    "n_tokens": pa.array(many), "n_known": pa.array(add((counts[0] > 0).astype(np.int64))),
                    "base_score": pa.array(add(base)), "score": pa.array(add(score)),
                })

    return run


def held_out_by_crc(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def interpolated_scores(
    docs: DataFrame, held_out: Column | None = None, order: int = ORDER,
    doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    ``held_out`` tells which rows the model must not learn from (``held_out_by_crc`` of the id
    unless given; null counts as false). ``score`` is the log10 probability of the text and
    its end; ``base_score`` that of single tokens with one added to all counts. Null and
    empty texts hold the end alone. Repeated rows are texts each; equal texts lie in the same
    half. Without training texts all tokens are equally likely. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    content = empty_if_null(f"`{text}`")
    out = held_out_by_crc(F.col(f"`{doc_id}`")) if held_out is None else held_out
    half = F.when(F.coalesce(out, F.lit(False)), -1).otherwise(F.pmod(F.xxhash64(content), F.lit(2)))
    gathered = stored(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), half.cast("long").alias("half"), content.alias("text"))
        .mapInArrow(_chunked(chunk_bytes), "bytes long, docs binary")
        .withColumn("chunk", F.monotonically_increasing_id()), "chunks",
    )
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    size = gathered.agg(F.sum("bytes")).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // RANGE_BYTES)
    requests = gathered.select("chunk", "docs").mapInArrow(
        _requests(order, ranges), "range long, chunk long, n long, data binary"
    ).repartition("range").sortWithinPartitions("range")
    answers = stored(requests.mapInArrow(
        _answers, "chunk long, range long, n long, data binary, words long, n0 long, n1 long"
    ), "answers")
    total = answers.where("chunk IS NULL").agg(*[F.sum(c).alias(c) for c in ("words", "n0", "n1")]).first()
    mix = Mix(total["words"] or 0, (total["n0"] or 0, total["n1"] or 0), order)
    both = gathered.select(
        "chunk", F.lit(-1).cast("long").alias("range"), F.lit(0).cast("long").alias("n"),
        F.col("docs").alias("data"),
    ).unionByName(answers.where("chunk IS NOT NULL").select("chunk", "range", "n", "data"))
    counted = stored(
        both.repartition("chunk").sortWithinPartitions("chunk", "range").mapInArrow(
            _joined(mix), f"docs array<{kind}>, half array<long>, tokens array<long>, texts long, "
            "counts binary, cells array<long>, n array<long>, logs array<double>",
        ), "token-counts",
    )
    at = F.col("at")
    width = F.size("cells")
    cells = (
        counted.select("n", "logs", width.alias("width"), F.posexplode("cells").alias("at", "cell"))
        .select("cell", F.get("n", at).alias("n"),
                *[F.get("logs", at + F.lit(k) * F.col("width")).alias(f"log{k}") for k in range(order)])
        .groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(f"log{k}").alias(f"log{k}") for k in range(order)])
        .orderBy("cell").toPandas()  # at most MOST_CELLS rows
    )
    n = cells["n"].to_numpy(dtype=float)
    logs = cells[[f"log{k}" for k in range(order)]].to_numpy() / np.maximum(n, 1)[:, None]
    learn(mix, cells["cell"].to_numpy(dtype=np.int64), n, logs)
    scores = counted.select("docs", "half", "tokens", "texts", "counts").mapInArrow(
        _scored(mix), schema
    )
    return scores.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(sum(mix.halves)).cast("long").alias("train_tokens"), "base_score", "score",
    )
