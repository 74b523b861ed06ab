"""Toxicity categories predicted by a chain of linear classifiers.

Categories are predicted one after the other. Each model sees which telling words and
parts of words a text has and the probabilities of all earlier categories; in training
those are out-of-fold predictions, so a later model learns from errors of the size it will
meet. Parts (4 to 6 characters) find stems whose inflected words are each rare. Words and
parts are ranked by their counts in the classes of the labelled texts; there is no word
list and no least count. The ridge of a word is the weaker the more telling it is. The
probability from which a text is rejected is chosen on out-of-fold predictions.

The models are fitted on at most about ``FIT_ROWS`` labelled texts (a hash of the id
chooses them); every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, empty_if_null, fresh, stored

FIT_ROWS = 20_000
FIT_WORDS = 200  # most telling words and parts of each category
PARTS = (4, 5, 6)  # characters
UNIT_Z = 5.0  # a word so many standard deviations from chance has the ridge RIDGE
BATCH_WORDS = 100_000  # words and parts that are counted in a worker before they are sent
SEEN_WORDS = 300_000  # words whose places a worker remembers (about 40 MB)
BLOCK_ROWS = 1000  # labelled texts whose features are held at once
FOLDS = 5
RIDGE = 1.0
REJECT = 0.5  # without out-of-fold predictions to choose it by

TOKEN = re.compile(r"\w+")


def tokens_of(text: str | None) -> set[str]:
    return set(TOKEN.findall(text.lower())) if text else set()


def parts_of(word: str) -> set[str]:
    """The word and its parts; ``~`` marks parts, ``^`` and ``$`` the ends of the word."""
    ends = f"^{word}$"
    return {word} | {f"~{ends[i : i + n]}" for n in PARTS for i in range(len(ends) - n + 1)}


@dataclass
class Chain:
    """A fitted chain: shared words, and for each category its weights.

    A weight vector holds the intercept, one weight for each word or part, and one for the
    probability of each earlier category. ``reject`` is a cut of the last category.
    """

    categories: list[str]
    words: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    reject: float = REJECT

    def probabilities(self, hits: np.ndarray) -> np.ndarray:
        """One column for each category, from the 0/1 matrix of words."""
        done = np.zeros((len(hits), 0))
        for w in self.weights:
            done = np.column_stack([done, _sigmoid(_design(hits, done) @ w)])
        return done


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _design(hits: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(hits)), hits, earlier])


class Hits:
    """0/1 rows, each as the places of its ones; a few rows at a time become dense.

    ``places[starts[i]:starts[i + 1]]`` are those of row ``i``, all below ``width``.
    """

    def __init__(self, starts: np.ndarray, places: np.ndarray, width: int):
        self.starts, self.places, self.width = starts, places, width

    def __len__(self) -> int:
        return len(self.starts) - 1

    def dense(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        where = np.full(self.width, -1)
        where[columns] = np.arange(len(columns))
        many = self.starts[rows + 1] - self.starts[rows]
        row = np.repeat(np.arange(len(rows)), many)
        at = np.arange(len(row)) + np.repeat(self.starts[rows] - (np.cumsum(many) - many), many)
        column = where[self.places[at]]
        out = np.zeros((len(rows), len(columns)))
        out[row[column >= 0], column[column >= 0]] = 1
        return out


def fit_linear(
    block: Callable[[np.ndarray], np.ndarray], y: np.ndarray, width: int,
    ridge: float | np.ndarray = RIDGE,
) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is not shrunk.

    ``block(rows)`` gives some rows of the design (``width`` columns), so that never more
    than ``BLOCK_ROWS`` of them are held. ``ridge`` is one number or one for each column.
    """
    w = np.zeros(width)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = np.log(share / (1 - share))
    penalty = np.full(width, ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        slope, curve = -penalty * w, np.diag(penalty)
        for at in range(0, len(y), BLOCK_ROWS):
            rows = np.arange(at, min(at + BLOCK_ROWS, len(y)))
            x = block(rows)
            p = _sigmoid(x @ w)
            slope += x.T @ (y[rows] - p)
            curve += (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_chain(
    hits: Hits, labels: np.ndarray, folds: np.ndarray, categories: Sequence[str],
    words: Sequence[str], z: np.ndarray,
) -> Chain:
    """Fit all categories in order; earlier ones enter as out-of-fold probabilities.

    ``z[f, k]`` tells how telling each word is for category ``k`` outside fold ``f``, the
    last ``f`` for all folds; 0 where it is not among the words chosen there.
    """
    used = np.flatnonzero(z[-1].any(axis=0))
    chain = Chain(list(categories), [words[i] for i in used])
    earlier = np.zeros((len(hits), 0))

    def design(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return _design(hits.dense(rows, columns), earlier[rows])

    def fitted(rows: np.ndarray, f: int, k: int, columns: np.ndarray) -> np.ndarray:
        ridge = RIDGE * (UNIT_Z / np.maximum(z[f, k, columns], 1e-3)) ** 2
        ridge = np.concatenate([[0.0], ridge, np.full(k, RIDGE)])
        return fit_linear(lambda some: design(rows[some], columns), labels[rows, k], len(ridge), ridge)

    for k in range(len(categories)):
        chain.weights.append(fitted(np.arange(len(hits)), -1, k, used))
        held_out = np.zeros(len(hits))
        for f in np.unique(folds):
            out, columns = np.flatnonzero(folds == f), np.flatnonzero(z[f].any(axis=0))
            w = fitted(np.flatnonzero(folds != f), f, k, columns)
            for at in range(0, len(out), BLOCK_ROWS):
                rows = out[at : at + BLOCK_ROWS]
                held_out[rows] = _sigmoid(design(rows, columns) @ w)
        earlier = np.column_stack([earlier, held_out])
    chain.reject = best_cut(earlier[:, -1], labels[:, -1])
    return chain


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of out-of-fold probabilities with the best F1 score.

    Only cuts at which most of the rejected are right count, so that a model that has
    learnt nothing does not reject everything; without one it is ``REJECT``.
    """
    order = np.argsort(-p, kind="stable")
    p, right = p[order], np.cumsum(y[order])
    n = np.arange(1, len(p) + 1)
    last = np.append(p[1:] < p[:-1], True)  # of equal probabilities
    good = np.flatnonzero(last & (2 * right > n))
    if not len(good):
        return REJECT
    at = good[np.argmax(2 * right[good] / (n[good] + right[-1]))]
    return float((p[at] + p[at + 1]) / 2 if at + 1 < len(p) else p[at])


class _Places:
    """Which of the chosen words and parts a text has; remembers words it has seen."""

    def __init__(self, words: Sequence[str]):
        self.place = {w: k for k, w in enumerate(words) if not w.startswith("~")}
        self.parts = {w[1:]: k for k, w in enumerate(words) if w.startswith("~")}
        self.width = len(words)
        self.bare: set[str] = set()  # words without any
        self.found: dict[str, list[int]] = {}

    def _in(self, word: str) -> list[int]:
        """Places of the word and of its parts (see ``parts_of``)."""
        ends, parts = f"^{word}$", self.parts
        out = [self.place[word]] if word in self.place else []
        for n in PARTS:
            for i in range(len(ends) - n + 1):
                part = ends[i : i + n]
                if part in parts:
                    out.append(parts[part])
        return out

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        for w in tokens_of(text) - self.bare:
            places = self.found.get(w)
            if places is None:
                places = self._in(w)
                if len(self.bare) + len(self.found) > SEEN_WORDS:
                    self.bare.clear()
                    self.found.clear()
                if not places:
                    self.bare.add(w)
                    continue
                self.found[w] = places
            out.update(places)
        return out

    def hits(self, texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        for i, text in enumerate(texts):
            out[i, list(self.of(text))] = 1
        return out


class _Counter:
    """Counts of words and parts by fold: texts, sums of labels, and a hash of their rows."""

    def __init__(self, ys: Sequence[str]):
        self.ys = ys
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.known: dict[str, np.ndarray] = {}
        self.at: list[np.ndarray] = []
        self.rows: list[int] = []

    def add(self, row: int, text: str) -> None:
        parts = []
        for w in tokens_of(text):
            found = self.known.get(w)
            if found is None:
                found = self.known[w] = np.array(
                    [self.ids.setdefault(g, len(self.ids)) for g in parts_of(w)]
                )
            parts.append(found)
        if parts:
            self.at.append(np.unique(np.concatenate(parts)))
            self.rows.append(row)

    def counted(self, batch: pd.DataFrame) -> pd.DataFrame:
        n = len(self.ids)
        rows = np.repeat(np.array(self.rows, dtype=int), [len(a) for a in self.at])
        at = np.concatenate(self.at) if self.at else np.zeros(0, dtype=int)
        key = np.zeros(n, dtype=np.int64)
        np.bitwise_xor.at(key, at, batch["key"].to_numpy()[rows])
        fold = batch["fold"].to_numpy()[rows]
        out = {"word": list(self.ids), "key": key}
        for f in range(FOLDS):
            here = fold == f
            out[f"n_{f}"] = np.bincount(at[here], minlength=n)
            for y in self.ys:
                out[f"{y}_{f}"] = np.bincount(
                    at[here], batch[y].to_numpy()[rows[here]], minlength=n
                )
        return pd.DataFrame(out)


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x.cast("double"))).otherwise(0.0)


def fit(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str],
    doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS,
) -> Chain:
    """Fit the chain of ``categories`` (0/1 columns of ``labels``, in this order).

    Labels of a repeated id count as 1 if any is, and of its texts one is used; null labels
    and ids are left out. Without
    labelled texts, or without words, only the base rates are learnt.
    """
    bounded_batches(docs.sparkSession)
    known = (
        labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("id"))
        .agg(*[F.max(F.col(f"`{c}`").cast("double")).alias(f"y{k}") for k, c in enumerate(categories)])
        .dropna()
    )
    total = known.count()
    part = min(1.0, fit_rows / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < part * 1_000_000)
    # of a repeated id one row; the least hash is found before rows are shuffled
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), empty_if_null(f"`{text}`").alias("text"))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text")))
    sample = stored(
        # about fit_rows ids and labels
        texts.join(F.broadcast(chosen), "id").withColumn("_first", first).where("_first = 1").drop("_first").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(FOLDS)))
        .withColumn("key", F.xxhash64(F.monotonically_increasing_id())), "labelled",
    )
    ys = [f"y{k}" for k in range(len(categories))]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counter = _Counter(ys)
            for row, t in enumerate(b["text"]):
                counter.add(row, t)
                if len(counter.ids) > BATCH_WORDS:
                    yield counter.counted(b)
                    counter.clear()
            if counter.ids:
                yield counter.counted(b)

    sums = {
        r["fold"]: r for r in sample.groupBy("fold")
        .agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).collect()
    }
    if not sums:
        return Chain(list(categories))
    names = [f"{c}_{f}" for c in ("n", *ys) for f in range(FOLDS)]
    kinds = {c: "long" if c.startswith("n_") else "double" for c in names}
    counts = sample.select("text", "fold", "key", *ys).mapInPandas(
        listed, "word string, key long, " + ", ".join(f"{c} {kinds[c]}" for c in names)
    ).groupBy("word").agg(F.bit_xor("key").alias("key"), *[F.sum(c).alias(c) for c in names])
    # of words and parts in the same texts one is enough: a word, else the longest part
    rank = F.struct(
        F.col("word").startswith("~").cast("int"), -F.length("word"), F.col("word")
    )
    total = sum(F.col(f"n_{f}") for f in range(FOLDS))
    counts = counts.withColumn("total", total).groupBy("key", "total").agg(
        F.min_by("word", rank).alias("word"), *[F.first(c).alias(c) for c in names]
    )

    def telling(y: str, parts: list[int]) -> Column:
        """Root of the likelihood ratio of the word's two-by-two table in these folds."""
        there = [sums[f] for f in parts if f in sums]
        rows, ones = float(sum(r["n"] for r in there)), float(sum(r[y] for r in there))
        n, one = (sum(F.col(f"{c}_{f}") for f in parts) for c in ("n", y))
        cells = sum(_xlogx(c) for c in (one, n - one, F.lit(ones) - one,
                                        F.lit(rows - ones) - n + one, F.lit(rows)))
        margins = sum(_xlogx(c) for c in (n, F.lit(rows) - n, F.lit(ones), F.lit(rows - ones)))
        return F.sqrt(F.greatest(F.lit(0.0), 2 * (cells - margins)))

    folds = [[g for g in range(FOLDS) if g != f] for f in range(FOLDS)] + [list(range(FOLDS))]
    ranked = stored(counts.select("word", *[
        telling(y, parts).alias(f"z_{f}_{k}")
        for f, parts in enumerate(folds) for k, y in enumerate(ys)
    ]), "words")
    best: dict[int, set[str]] = {}
    for f in range(len(folds)):
        best[f] = set()
        for k in range(len(ys)):
            z = F.col(f"z_{f}_{k}")
            top = ranked.select("word", z).where(z > 0).orderBy(z.desc(), "word").limit(FIT_WORDS)
            best[f] |= {r["word"] for r in top.collect()}
    words = sorted(set().union(*best.values()))
    place = {w: i for i, w in enumerate(words)}
    strength = np.zeros((len(folds), len(ys), len(words)))
    for r in ranked.where(F.col("word").isin(words)).collect() if words else []:
        for f in range(len(folds)):
            if r["word"] in best[f]:
                strength[f, :, place[r["word"]]] = [r[f"z_{f}_{k}"] for k in range(len(ys))]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = _Places(words)
        for b in batches:
            yield b[["fold", *ys]].assign(hits=[sorted(places.of(t)) for t in b["text"]])

    # sums in the same order on every run; one row for each labelled text
    rows = sample.select("fold", *ys, "text").mapInPandas(
        found, "fold long, " + ", ".join(f"{y} double" for y in ys) + ", hits array<int>"
    ).orderBy("fold", *ys, F.xxhash64("hits")).toArrow().combine_chunks()
    lists = rows.column("hits").combine_chunks()
    starts = lists.offsets.to_numpy().astype(np.int64)
    hits = Hits(starts - starts[0], lists.flatten().to_numpy(), len(words))
    labels = np.column_stack([rows.column(y).to_numpy() for y in ys])
    return fit_chain(hits, labels, rows.column("fold").to_numpy(), categories, words, strength)


def _probabilities(docs: DataFrame, chain: Chain, text: str) -> Column:
    """Column with the probabilities of all categories, in their order."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = model.value
        places = _Places(fitted.words)
        for texts in batches:
            if not fitted.weights:
                yield pd.Series([[0.0] * len(fitted.categories)] * len(texts))
            else:
                yield pd.Series(list(fitted.probabilities(places.hits(texts))))

    return predict(F.col(f"`{text}`"))


def score(
    docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text",
    reject: float | None = None,
) -> DataFrame:
    """``doc_id``, ``p_<category>`` for each category, and ``rejected`` by the last one.

    ``reject`` is a probability, the chain's own if none is given. One row for each row of
    ``docs``. A null or empty text has no word and gets the base
    rates; an unfitted chain gives probability 0.
    """
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), _probabilities(docs, chain, text).alias("p")
    ).select(
        "doc_id", *[F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(chain.categories)],
        (F.element_at("p", -1) >= (chain.reject if reject is None else reject)).alias("rejected"),
    )


def keep_accepted(
    docs: DataFrame, chain: Chain, text: str = "text", reject: float | None = None
) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    (p,) = fresh(docs, "_p")
    return docs.withColumn(p, _probabilities(docs, chain, text)).where(
        F.element_at(p, -1) < (chain.reject if reject is None else reject)
    ).drop(p)
