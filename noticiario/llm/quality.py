"""Quality rules from document statistics: gradient-boosted trees with monotonic limits.

Statistics come from numpy over the bytes of many texts at once. The trees are grown here,
on the statistics of at most about ``FIT_ROWS`` labelled documents; a split on a limited
feature is taken only if it keeps the direction, and its two sides stay apart in all later
splits, so the score never rises with, say, the share of symbols. Trees are complete and of
one depth, flattened into node arrays, and scored by array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import bounded_batches, fresh, stored

FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 80, 3, 0.15, 48, 10, 1.0
FOLDS = 5
# Share of the good labelled documents that the verdict may drop, out of fold.
FALSE_DROPS = 0.005
MOST_SCORE = 0.5  # a document at least this likely to be good is never dropped

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (*BASE, "n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "n_distinct")

# Features of the trees and how the score may depend on them: -1 never rises, 0 free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_lines": -1,
    "repeated": -1, "upper": -1, "digits": -1, "marks_per_word": -1, "stops_per_word": 0,
    "words_per_line": 0, "distinct": 0,
}


def _flags(listed: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(listed.encode())] = True
    return out


_SYMBOL = _flags("#*$%&|<>")
_UPPER, _DIGIT = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("0123456789")
_MARK, _STOP = _flags("!?"), _flags(".,;:")


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which entries of ``keys`` occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    out = np.empty(len(keys), dtype=bool)
    out[order] = same[:-1] | same[1:]
    return out


def statistics(w: W.Words) -> dict[str, np.ndarray]:
    """``STATISTICS`` of each text of a chunk."""
    data, ends, starts = w.data, w.text_ends, w.text_starts
    texts = len(ends)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[ends] - sums[starts]

    solid = ~W.IS_SPACE[data]
    points = solid & ((data & 0xC0) != 0x80)
    out = {
        "n_words": w.counts.astype(np.int64), "word_chars": per_text(points),
        "n_symbols": per_text(_SYMBOL[data]), "n_upper": per_text(_UPPER[data]),
        "n_digits": per_text(_DIGIT[data]), "n_marks": per_text(_MARK[data]),
        "n_stops": per_text(_STOP[data]),
    }
    # lines: between line feeds, each text on its own
    feeds = np.flatnonzero(data == 0x0A)
    begins = np.sort(np.concatenate((starts, feeds + 1)), kind="stable")
    stops = np.sort(np.concatenate((ends, feeds)), kind="stable")
    line_text = np.searchsorted(ends, stops, side="left")
    solid_sums = np.concatenate(([0], np.cumsum(solid, dtype=np.int64)))
    full = solid_sums[stops] > solid_sums[begins]
    begins, stops, line_text = begins[full], stops[full], line_text[full]
    key = W.range_hashes(data.astype(W.U), begins, stops, W.BYTE_BASE[0])
    key = W.mixed(key + (stops - begins).astype(W.U)) + line_text.astype(W.U) * W.U(W.WORD_BASE[0])
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    out["n_lines"] = np.bincount(line_text, minlength=texts)
    out["n_dup_lines"] = np.bincount(line_text[again], minlength=texts)
    # words in 3-word windows found twice or more
    hashes, at = w.hashes(), w.gram_starts(3)
    text_of = w.text_of
    salt = text_of.astype(W.U) * W.U(W.WORD_BASE[1])
    grams = w.gram_hashes(hashes, 3)
    keys = grams[at] + salt[at] if len(at) else np.zeros(0, dtype=W.U)
    hit = at[_repeats(keys)]
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[hit + k] = True
    out["n_repeat_words"] = np.bincount(text_of[covered], minlength=texts)
    order = np.argsort(hashes + salt, kind="stable")
    first = np.ones(len(hashes), dtype=bool)
    sorted_keys = (hashes + salt)[order]
    first[order[1:]] = sorted_keys[1:] != sorted_keys[:-1]
    out["n_distinct"] = np.bincount(text_of[first], minlength=texts)
    return {k: out[k].astype(np.int64) for k in STATISTICS}


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Matrix of ``FEATURES`` from statistics."""
    f = {k: np.asarray(v, dtype=float) for k, v in s.items()}
    words, chars = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1)
    lines = np.maximum(f["n_lines"], 1)
    return np.column_stack([
        np.log1p(f["n_words"]), f["word_chars"] / words, f["n_symbols"] / words,
        f["n_dup_lines"] / lines, f["n_repeat_words"] / words, f["n_upper"] / chars,
        f["n_digits"] / chars, f["n_marks"] / words, f["n_stops"] / words,
        f["n_words"] / lines, f["n_distinct"] / words,
    ])


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass
class Trees:
    """Flattened trees. Node ``i`` of a tree has the children ``2i + 1`` and ``2i + 2``;
    a value over ``threshold`` goes to the second."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1), np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH)))
    base: float = 35.0
    least: float = 0.0  # documents below this probability are dropped

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(threshold)]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _grow(codes, edges, slope, curve, limits, low=-np.inf, high=np.inf):
    """One tree: node features, thresholds, leaf values."""
    inner = 2**DEPTH - 1
    feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    leaf = np.zeros(inner + 1)
    n_features = codes.shape[1]

    def value(g, h, bounds):
        return np.clip(g / (h + RIDGE), *bounds)

    def gain(v, g, h):
        return g * v - 0.5 * (h + RIDGE) * v * v

    def split(node, rows, bounds):
        g, h = slope[rows].sum(), curve[rows].sum()
        if node >= inner:
            leaf[node - inner] = value(g, h, bounds)
            return
        best, chosen = 1e-6, None
        own = gain(value(g, h, bounds), g, h)
        for f in range(n_features):
            c = codes[rows, f]
            gs = np.cumsum(np.bincount(c, slope[rows], BINS))[:-1]
            hs = np.cumsum(np.bincount(c, curve[rows], BINS))[:-1]
            ns = np.cumsum(np.bincount(c, minlength=BINS))[:-1]
            left, right = value(gs, hs, bounds), value(g - gs, h - hs, bounds)
            won = gain(left, gs, hs) + gain(right, g - gs, h - hs) - own
            fits = (ns >= LEAST_LEAF) & (len(rows) - ns >= LEAST_LEAF)
            if limits[f]:
                fits &= (right - left) * limits[f] >= 0
            won = np.where(fits, won, -np.inf)
            k = int(np.argmax(won))
            if won[k] > best:
                best, chosen = won[k], (f, k, left[k], right[k])
        if chosen is None:
            split(2 * node + 1, rows, bounds)  # all rows go to the first child
            split(2 * node + 2, rows[:0], bounds)
            return
        f, k, left, right = chosen
        feature[node], threshold[node] = f, edges[f][k]
        goes = codes[rows, f] > k
        first, second = bounds, bounds
        if limits[f]:
            middle = (left + right) / 2
            below, above = (bounds[0], middle), (middle, bounds[1])
            first, second = (below, above) if limits[f] > 0 else (above, below)
        split(2 * node + 1, rows[~goes], first)
        split(2 * node + 2, rows[goes], second)

    split(0, np.arange(len(slope)), (low, high))
    return feature, threshold, leaf


def grow_trees(x: np.ndarray, y: np.ndarray, limits: tuple[int, ...], trees: int = TREES) -> Trees:
    """Boosted trees for 0/1 labels. With one class only, the base rate alone."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    made = Trees(base=float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return made
    edges = []
    for column in x.T:
        cuts = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(np.append(cuts, np.full(BINS - 1 - len(cuts), np.inf)))
    codes = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    total, parts = np.full(len(y), made.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        feature, threshold, leaf = _grow(codes, edges, y - p, p * (1 - p), limits)
        parts.append((feature, threshold, leaf * RATE))
        made.feature, made.threshold, made.leaf = map(np.array, zip(*parts[-1:], strict=True))
        node = np.zeros(len(y), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        total += parts[-1][2][node - len(threshold)]
    made.feature, made.threshold, made.leaf = map(np.array, zip(*parts, strict=True))
    return made


def fit_trees(x: np.ndarray, y: np.ndarray, folds: np.ndarray, false_drops: float = FALSE_DROPS) -> Trees:
    """Trees with the threshold that drops at most this share of the good, out of fold."""
    limits = tuple(FEATURES.values())
    made = grow_trees(x, y, limits)
    if len(made.feature):
        held = np.ones(len(y))
        for f in np.unique(folds):
            out = folds == f
            held[out] = grow_trees(x[~out], y[~out], limits).probability(x[out])
        made.least = float(min(MOST_SCORE, np.quantile(held[y == 1], false_drops)))
    return made


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        others = [n for n in batch.schema.names if n != "text"]
        for at, to, w in W.chunks(batch.column("text")):
            part = batch.slice(at, to - at)
            s = statistics(w)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in others], *[pa.array(s[k]) for k in STATISTICS]],
                names=[*others, *STATISTICS],
            )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``STATISTICS`` added; a null text has no words.

    Columns of ``docs`` named like a statistic are left out.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "text", *STATISTICS)]
    asked = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:-1]]
    return asked.mapInArrow(_measured, ", ".join([*fields, *[f"{s} long" for s in STATISTICS]]))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
    text: str = "text", fit_rows: int = FIT_ROWS,
) -> Trees:
    """Fit on the labelled documents that pass the base rules.

    A repeated id is good if any of its labels is, and one of its texts is used; null labels
    and ids are left out. Without
    labels of both kinds nothing is dropped.
    """
    known = (
        labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("id"))
        .agg(F.max(F.col(f"`{label}`").cast("double")).alias("y")).dropna()
    )
    part = min(1.0, fit_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < part * 1_000_000)
    # of a repeated id one row; the least hash is found before rows are shuffled
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text")))
    sample = stored(
        docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
        .join(F.broadcast(chosen), "id").withColumn("_first", first).where("_first = 1").drop("_first"),
        "labelled",
    )
    rows = measure(sample).withColumn(
        "fold", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS))
    ).toPandas().sort_values("id")
    s = {k: rows[k].to_numpy() for k in STATISTICS}
    use = ~base_failed(s)
    if not use.any():
        return Trees()
    return fit_trees(
        features(s)[use], rows["y"].to_numpy()[use], rows["fold"].to_numpy()[use]
    )


def judge(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``score`` and ``kept`` for each row.

    A null or empty text fails the base rules. Repeated rows are judged alike.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in STATISTICS}
            failed = base_failed(s)
            score = model.value.probability(features(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(s[k]) for k in BASE], pa.array(failed),
                 pa.array(score), pa.array(~failed & (score >= model.value.least))],
                names=["doc_id", *BASE, "base_failed", "score", "kept"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    measured = measure(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    )
    return measured.mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{b} long" for b in BASE)
        + ", base_failed boolean, score double, kept boolean",
    )


def keep_good(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        kept = []
        for _, _, w in W.chunks(pa.array(texts, type=pa.string(), from_pandas=True)):
            s = statistics(w)
            verdict = model.value.probability(features(s)) >= model.value.least
            kept.append(verdict & ~base_failed(s))
        return pd.Series(np.concatenate(kept) if kept else np.zeros(0, dtype=bool))

    (flag,) = fresh(docs, "_good")
    return docs.withColumn(flag, good(F.col(f"`{text}`"))).where(F.col(flag)).drop(flag)
