"""Passages that occur more than once, removed word by word.

A window is ``WINDOW`` consecutive words of one text. A count-min sketch first overestimates
how often windows occur; only windows estimated as repeated are grouped exactly, so none
is lost and few are shuffled.

* Neighbouring windows share an anchor: of the 8-word grams in a window, the one with the
  least hash. Equal windows have equal anchors at equal places, so an anchor occurs at
  least as often as any of its windows, and anchors are 14 times fewer. Each partition
  sketches its anchors; the cells are merged by stripes, which keeps one bit a cell: whether
  it was met twice. The sketch has a fixed largest size (``MOST_CELLS``), below which it
  follows the input; beyond it, more windows pass to the exact step, none fewer.
* The windows of one anchor form a run. Runs are grouped first, by the hash of all their
  windows: a run found twice settles all its windows. Where different runs have the same
  anchor, one copy of each is grouped window by window; copies of whole documents never
  get that far.
* Windows are compared by two independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticiario.session import estimated_bytes

from . import words as W
from .common import bounded_batches, fresh, stored

WINDOW = 35
GRAM = 8
ROWS = 2  # independent rows of the sketch
STRIPE_BITS = 16
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 29  # bits in a row: 128 KB to 64 MB
U = W.U


def sketch_cells(input_bytes: int) -> int:
    """Cells in a row: about 8 for each anchor expected in a compressed input, within limits."""
    wanted = LEAST_CELLS
    while wanted < MOST_CELLS and wanted < input_bytes // 6:
        wanted *= 2
    return wanted


def _sliding_least(keys: np.ndarray, n: int) -> np.ndarray:
    """Least of each ``n`` neighbours, by doubling."""
    out, width = keys, 1
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(keys) - n + 1], out[n - width : n - width + len(keys) - n + 1])


class Windows:
    """Windows and anchors of a chunk of texts.

    ``starts``: first word of each window; ``anchor``: word where its anchor starts;
    ``runs``: bounds of windows with one anchor, as places in ``starts``.
    """

    def __init__(self, w: W.Words, window: int):
        gram = min(GRAM, window)
        self.starts = w.gram_starts(window)
        h = w.hashes(0)
        self.grams = w.gram_hashes(h, gram)
        self.hashes = h
        if not len(self.starts):
            self.anchor = self.starts
            self.runs = np.zeros(1, dtype=np.int64)
            return
        # upper bits order the grams, lower bits are their places: the leftmost of equals wins
        places = np.arange(len(self.grams), dtype=U)
        keys = (self.grams & U(0xFFFFFFFF00000000)) | places
        least = _sliding_least(keys, window - gram + 1)
        self.anchor = (least[self.starts] & U(0xFFFFFFFF)).astype(np.int64)
        text = np.searchsorted(w.first, self.starts, side="right")
        new = np.ones(len(self.starts), dtype=bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (text[1:] != text[:-1])
        self.runs = np.append(np.flatnonzero(new), len(self.starts))

    def anchor_hashes(self) -> np.ndarray:
        """Hash of the anchor of each run."""
        return self.grams[self.anchor[self.runs[:-1]]]


def _cells(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    return W.mixed(anchors ^ U((0x5851F42D4C957F2D, 0x14057B7EF767814F)[row])) & U(cells - 1)


def _sketched(window: int, cells: int):
    """Per partition: the cells it meets, with whether it meets them twice, by stripe."""
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchors = np.concatenate(held)
        for row in range(ROWS):
            cell, n = np.unique(_cells(anchors, row, cells), return_counts=True)
            coded = (cell & U((1 << STRIPE_BITS) - 1)).astype(np.uint32) << 1 | (n > 1)
            stripe = (cell >> U(STRIPE_BITS)).astype(np.int64)
            cut = np.flatnonzero(np.diff(stripe)) + 1
            parts = np.split(coded.astype("<u4"), cut)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(parts), row), pa.int32()),
                pa.array(stripe[np.append(0, cut)] if len(cell) else [], pa.int64()),
                pa.array([p.tobytes() for p in parts], pa.binary()),
            ], names=["row", "stripe", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, w in W.chunks(batch.column("text")):
                found = Windows(w, window)
                if len(found.starts):
                    held.append(found.anchor_hashes())
                    size += len(held[-1])
                if size > 1 << 20:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes in order: one bit for each cell that was met twice in all."""
    at, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([
            pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()),
            pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary()),
        ], names=["row", "stripe", "bits"])

    for batch in batches:
        for row, stripe, met in zip(*(batch.column(k) for k in range(3)), strict=True):
            key = (row.as_py(), stripe.as_py())
            if key != at:
                if at is not None:
                    yield done()
                at = key
                once, twice = (np.zeros(1 << STRIPE_BITS, dtype=bool) for _ in range(2))
            coded = np.frombuffer(met.as_buffer(), "<u4")
            cell = coded >> 1
            twice[cell[once[cell] | (coded & 1).astype(bool)]] = True
            once[cell] = True
    if at is not None:
        yield done()


def sketch(docs: DataFrame, window: int, cells: int) -> list[np.ndarray]:
    """The merged sketch: for each row, one bit a cell (``cells / 8`` bytes, a proven bound)."""
    parts = (
        docs.mapInArrow(_sketched(window, cells), "row int, stripe long, met binary")
        .repartition("row", "stripe").sortWithinPartitions("row", "stripe")
        .mapInArrow(_merged, "row int, stripe long, bits binary")
    )
    rows = [np.zeros(cells // 8, dtype=np.uint8) for _ in range(ROWS)]
    size = (1 << STRIPE_BITS) // 8
    for r in parts.toLocalIterator():
        rows[r["row"]][r["stripe"] * size : (r["stripe"] + 1) * size] = np.frombuffer(
            r["bits"], np.uint8
        )
    return rows


FOUND = (
    "n_words long, kept_sha256 string, text string, "
    "runs array<struct<start:int,n:int,a:bigint,b:bigint,anchor:bigint>>"
)


def _candidates(window: int, cells: int, merged):
    """Per text: the runs that the sketch takes for repeated, else its final digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = merged.value
        for batch in batches:
            texts = batch.column("text")
            for at, to, w in W.chunks(texts):
                found = Windows(w, window)
                n = to - at
                owner = np.zeros(0, dtype=np.int64)
                lists = None
                if len(found.starts):
                    anchors = found.anchor_hashes()
                    hit = np.ones(len(anchors), dtype=bool)
                    for row, bits in enumerate(rows):
                        cell = _cells(anchors, row, cells)
                        hit &= (bits[cell >> U(3)] >> (cell & U(7)).astype(np.uint8) & 1).astype(bool)
                    begin, end = found.runs[:-1][hit], found.runs[1:][hit]
                    size = end - begin
                    first = found.starts[begin]
                    # of texts that begin at one word all but the last are empty
                    owner = np.searchsorted(w.first, first, side="right") - 1
                    hashes = [
                        w.gram_hashes(found.hashes, window, 0),
                        w.gram_hashes(w.hashes(1), window, 1),
                    ]
                    each = np.arange(int(size.sum())) + np.repeat(
                        begin - (np.cumsum(size) - size), size
                    )
                    h, g = (x[found.starts[each]] for x in hashes)
                    keys = []
                    for x in (h, g):
                        total = np.add.reduceat(
                            W.mixed(x + (np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size))
                                    .astype(U) * U(W.WORD_BASE[0])),
                            np.cumsum(size) - size,
                        ) if len(x) else x
                        keys.append(W.mixed(total + size.astype(U)))
                    lists = pa.StructArray.from_arrays(
                        [pa.array((first - w.first[owner]).astype(np.int32)),
                         pa.array(size.astype(np.int32)),
                         *[pa.array(k.view(np.int64)) for k in (*keys, anchors[hit])]],
                        names=["start", "n", "a", "b", "anchor"],
                    )
                per_text = np.bincount(owner, minlength=n)
                if lists is None:
                    lists = pa.array([], RUN)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(per_text)), pa.int32()), lists
                )
                data, kept = w.data, []
                starts, ends = w.starts.tolist(), w.ends.tolist()
                raw = data.tobytes()
                for t in range(n):
                    kept.append(None if per_text[t] else hashlib.sha256(b" ".join([
                        raw[starts[k] : ends[k]] for k in range(w.first[t], w.last[t])
                    ])).hexdigest())
                chosen = pa.array(np.arange(at, to), mask=per_text == 0)
                open_text = texts.take(chosen)  # null where the choice is
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(at, n) for c in batch.schema.names if c != "text"],
                     pa.array(w.counts.astype(np.int64)), pa.array(kept, pa.string()),
                     open_text.cast(pa.string()), listed.cast(pa.list_(RUN))],
                    names=[*[c for c in batch.schema.names if c != "text"],
                           "n_words", "kept_sha256", "text", "runs"],
                )

    return run


RUN = pa.struct([
    ("start", pa.int32()), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64()),
    ("anchor", pa.int64()),
])


def _kept_words(text: str | None, starts, sizes, window: int) -> tuple[list[bytes], int]:
    """Words outside all windows that begin in the given spans, and how many are inside."""
    ((_, _, w),) = W.chunks(pa.array([text or ""], pa.string()))
    marks = np.zeros(len(w) + 1, dtype=np.int64)
    starts, sizes = (np.asarray(x, dtype=np.int64) for x in (starts, sizes))
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + sizes + window - 1, -1)
    out = np.cumsum(marks[:-1]) > 0
    raw = w.data.tobytes()
    kept = [raw[a:b] for a, b in zip(w.starts[~out].tolist(), w.ends[~out].tolist(), strict=True)]
    return kept, int(out.sum())


def find_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``row``, ``n_words``, ``kept_sha256``, ``text``, ``runs`` as stored, and the spans.

    Spans are ``row, starts, sizes``: where repeated windows begin, for each text with any.
    ``kept_sha256`` is set, and the text left out, where nothing can be repeated.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cells = sketch_cells(estimated_bytes(docs))
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    merged = spark.sparkContext.broadcast(sketch(texts, window, cells))
    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]
    found = stored(
        docs.mapInArrow(_candidates(window, cells, merged), ", ".join([*others, FOUND]))
        .withColumn("row", F.monotonically_increasing_id()), "repeats",
    )
    runs = found.where(F.size("runs") > 0).select("row", F.explode("runs").alias("r")).select(
        "row", "r.*"
    )
    counted = stored(runs.groupBy("a", "b").agg(
        F.count("*").alias("k"), F.first("anchor").alias("anchor"),
        F.min(F.struct("row", "start", "n")).alias("one"),
    ), "runs")
    again = F.col("k") > 1
    # different runs with one anchor may share windows: one copy of each is compared
    contested = counted.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    lists = counted.join(contested, "anchor", "left_semi").groupBy("one.row").agg(
        F.collect_list(F.struct("one.start", "one.n", again.alias("again"))).alias("runs")
    )
    windows = stored(
        found.select("row", "text").join(lists, "row").mapInArrow(
            _window_hashes(window), "row long, start int, again boolean, h long, g long"
        ), "windows",
    )
    twice = windows.groupBy("h", "g").agg(F.count("*").alias("k")).where("k > 1")
    spans = runs.join(counted.where(again), ["a", "b"], "left_semi").select(
        "row", "start", "n"
    ).unionByName(
        windows.where(~F.col("again")).join(twice, ["h", "g"], "left_semi").select(
            "row", "start", F.lit(1).alias("n")
        )
    )
    return found, spans.groupBy("row").agg(
        F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes")
    )


def _window_hashes(window: int):
    """Hashes of the windows of given runs of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            for at, to, w in W.chunks(batch.column("text")):
                part = lists.slice(at, to - at)
                each = part.flatten()
                counts = np.diff(part.offsets.to_numpy())
                n = each.field("n").to_numpy().astype(np.int64)
                start = each.field("start").to_numpy().astype(np.int64)
                total = np.cumsum(n)
                shift = np.arange(total[-1] if len(n) else 0) - np.repeat(total - n, n)
                first = np.repeat(w.first, counts)
                place = np.repeat(first + start, n) + shift
                h, g = (w.gram_hashes(w.hashes(seed), window, seed)[place] for seed in (0, 1))
                rows = batch.column("row").slice(at, to - at).to_numpy()
                again = each.field("again").to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.repeat(rows, counts), n)),
                    pa.array((np.repeat(start, n) + shift).astype(np.int32)),
                    pa.array(np.repeat(again, n)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)),
                ], names=["row", "start", "again", "h", "g"])

    return run


def _finished(found: DataFrame, spans: DataFrame, apply, result: str) -> DataFrame:
    """Apply ``apply(text, starts, sizes)`` to the texts with candidates; others as stored."""
    return found.where(F.col("kept_sha256").isNull()).join(spans, "row", "left").withColumn(
        result, apply(F.col("text"), F.col("starts"), F.col("sizes"))
    )


def digests(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs``.

    A word goes if a window that covers it also starts anywhere else, in the same text or
    another. Words are kept unchanged. Null and empty texts, and texts shorter than a window,
    lose nothing. Repeated rows lose all their words if they have a window.
    """
    @F.pandas_udf("n_removed long, kept_sha256 string")
    def apply(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, n in zip(texts, starts, sizes, strict=True):
            kept, removed = _kept_words(t, [] if a is None else a, [] if n is None else n, window)
            rows.append((removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_removed", "kept_sha256"])

    asked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found, spans = find_repeats(asked, window)
    changed = _finished(found, spans, apply, "done")
    same = found.where(F.col("kept_sha256").isNotNull())
    return same.select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"
    ).unionByName(changed.select("doc_id", "n_words", "done.n_removed", "done.kept_sha256"))


def removed(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without their repeated words; a changed text has its words
    joined by one space. Rows are kept even if nothing of the text is left."""
    @F.pandas_udf("string")
    def apply(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for t, a, n in zip(texts, starts, sizes, strict=True):
            if a is None:
                out.append(t)
                continue
            out.append(b" ".join(_kept_words(t, a, n, window)[0]).decode())
        return pd.Series(out, dtype=object)

    key, starts, sizes = fresh(docs, "_key", "_starts", "_sizes")
    numbered = stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found, spans = find_repeats(
        numbered.select(F.col(key).alias("key"), F.col(f"`{text}`").alias("text")), window
    )
    spans = found.select("row", "key").join(spans, "row").select(
        F.col("key").alias(key), F.col("starts").alias(starts), F.col("sizes").alias(sizes)
    )
    return numbered.join(spans, key, "left").withColumn(
        text, apply(F.col(f"`{text}`"), F.col(starts), F.col(sizes))
    ).select(*[F.col(f"`{c}`") for c in docs.columns])
