"""Whitening of embeddings by shifted Cholesky QR.

The centred rows ``A`` of the fit list are never held together. A pass over them gives the
Gram matrix of ``Q = A inv(R)``, where ``R`` is the product of the factors found so far and
the rows are multiplied by triangular solves; its Cholesky factor is the next factor. The
first pass is shifted, so that it succeeds for any condition number, and so is every later
one whose Gram matrix is still ill-conditioned; passes end when the rows are orthonormal to
machine precision. The singular value decomposition of the small composed ``R`` then gives
the components. Rounding errors follow the condition of ``A``, not its square.

Directions in which the rows do not vary stay zero in ``Q`` whatever the factors; the root
of the last Gram matrix takes them out of ``R`` again.

Entries are whole numbers here (``floor(scale * c)``), so counts, sums and deviations are
exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

SCALE = 256
# Beyond this an entry stays at it: sums and products of whole numbers must fit 64 bits.
MOST = 1 << 31
COMPONENTS = 4
MOST_PASSES = 12
SETTLED = 1e-13  # distance of the last Gram matrix from the identity, for each dimension
NOTHING = 1e-24  # an eigenvalue of a Gram matrix below this is none
# Gram matrices of the tasks are added in this many parts, then in the driver.
PARTS = 32
# Rows are multiplied so many entries at a time.
CELLS = 1 << 20
EPS = np.finfo(float).eps


@dataclass
class Whitener:
    """``x`` becomes ``(x - sums / n) @ vectors / sqrt(values)``.

    Components are columns of ``vectors`` by falling variance ``values``; ``trace`` is the
    sum of all variances. ``passes`` counts the Gram passes that were needed.
    """

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``; the whole part is taken off in integers first."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, dtype=np.int64)) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components; NaN for those without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.where(self.values > 0, self.values, np.nan))
            return self.centred(x) @ self.vectors / root


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def whole_entries(vector: Column, scale: int = SCALE) -> Column:
    def whole(c: Column) -> Column:
        scaled = F.floor(c.cast("double") * scale)
        return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), scaled)).cast("long")

    return F.transform(vector, whole)


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """Vectors as rows; what a short one lacks is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    lengths = np.diff(ends)
    flat = column.flatten().to_numpy()
    if len(flat) == len(column) * size and (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(column), size), dtype=flat.dtype)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
    return out


def _gram(rows: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``y.T @ y`` over all rows ``y = of(x)``.

    Each task adds up its own rows; the matrices of the tasks are added in PARTS tasks, and
    those sums, in a fixed order, in the driver.
    """
    step = max(1, CELLS // max(1, size))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            x = _matrix(b.column("x"), size)
            for at in range(0, len(x), step):
                y = of(x[at : at + step])
                part = y.T @ y
                total = part if total is None else total + part
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"task": [task], "gram": [total.ravel().tolist()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for b in batches:
            for task, gram in zip(b.column("task").to_pylist(), b.column("gram"), strict=True):
                part = gram.values.to_numpy()
                total = part if total is None else total + part
                first = task if first is None else first
        if total is not None:
            yield pa.RecordBatch.from_pydict({"task": [first], "gram": [total.tolist()]})

    kind = "task long, gram array<double>"
    part = F.pmod("task", F.lit(PARTS))
    parts = (
        rows.select("x").mapInArrow(own, kind).repartition(part)
        .sortWithinPartitions("task").mapInArrow(added, kind).collect()
    )
    total = sum(np.array(r["gram"]) for r in sorted(parts, key=lambda r: r["task"]))
    width = int(round(np.sqrt(np.size(total))))
    return np.asarray(total, dtype=float).reshape(width, width)


def _upper(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper Cholesky factor; shifted if it must be, as it is in the first pass."""
    size = len(gram)
    shift = 11 * (n * size + size * (size + 1)) * EPS * np.trace(gram)
    shift = max(min(shift, 1e-3 * np.trace(gram) / size), np.finfo(float).tiny)
    eye = np.eye(size)
    if not first:
        least = np.linalg.eigvalsh(gram)[0]
        if least > 0.1:
            return np.linalg.cholesky(gram).T
    return np.linalg.cholesky(gram + shift * eye).T


def _exact(x: np.ndarray, sums: list[int]) -> tuple[pa.Array, pa.Array]:
    """Sums of squares and of products with ``sums`` for each row, as whole decimals."""
    largest, size = int(np.abs(x).max(initial=0)), x.shape[1]
    fits = size * largest * max(largest, *(abs(s) for s in sums)) < 1 << 62
    kind = np.int64 if fits else object
    x = x.astype(kind)
    weights = np.array(sums, dtype=kind)
    found = ((x * x).sum(axis=1), (x * weights).sum(axis=1))
    if fits:
        return tuple(pa.array(f).cast(pa.decimal128(38, 0)) for f in found)
    return tuple(pa.array([Decimal(v) for v in f], pa.decimal128(38, 0)) for f in found)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Components of the rows of ``x`` (whole numbers; all rows count); None without rows.

    ``components`` is cut to the dimension. The driver holds matrices of the squared
    dimension, never rows.
    """
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(0, dtype=np.int64)
        for b in batches:
            width = max(len(total), int(np.diff(b.column("x").offsets.to_numpy()).max(initial=0)))
            total = np.pad(total, (0, width - len(total))) + _matrix(b.column("x"), width).sum(axis=0)
            count += b.num_rows
        yield pa.RecordBatch.from_pydict({"n": [count], "sums": pa.array([total], pa.list_(pa.int64()))})

    # a row for each task, then one for each dimension
    counts = stored(rows.select("x").mapInArrow(added, "n long, sums array<long>"), "vector-sums")
    n = counts.agg(F.sum("n")).first()[0]
    sums = {
        r["at"]: int(r["s"]) for r in counts.select(F.posexplode("sums").alias("at", "s"))
        .groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    }
    size = max(sums, default=-1) + 1
    if not n or not size:
        return None
    model = Whitener(n, [sums.get(k, 0) for k in range(size)], np.eye(size), np.ones(size), 0.0)
    composed = np.eye(size)

    def orthogonal(factors: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        def of(x: np.ndarray) -> np.ndarray:
            y = model.centred(x).T
            for r in factors:  # y.T @ inv(r), as triangular solves of r.T
                y = _forward(r.T, y)
            return y.T

        return of

    factors: list[np.ndarray] = []
    gram = _gram(rows, size, orthogonal(factors))
    lasted = np.inf
    while np.trace(gram) > 0:
        r = _upper(gram, n, first=not factors)
        factors.append(r)
        composed = r @ composed
        gram = _gram(rows, size, orthogonal(factors))
        # orthonormal, but for directions without variance: there the Gram matrix is 0
        values = np.linalg.eigvalsh(gram)
        off = np.minimum(np.abs(values - 1), np.where(values < NOTHING, 0.0, 1.0)).max()
        if off < SETTLED * size or (lasted < 1e-9 and off >= lasted):
            break
        if len(factors) == MOST_PASSES:
            raise RuntimeError(f"rows not orthonormal after {MOST_PASSES} passes")
        lasted = off
    # A'A = R'GR, so the root of G makes up for what is left of its distance from 1
    values, turn = np.linalg.eigh(gram)
    root = np.sqrt(np.maximum(values, 0.0))[:, None] * turn.T
    _, sigma, vt = np.linalg.svd(root @ composed)
    variances = sigma**2 / n
    variances[sigma <= sigma[0] * EPS * size] = 0.0
    keep = min(components, size)
    return Whitener(
        n, model.sums, vt[:keep].T.copy(), variances[:keep], float(variances.sum()), len(factors)
    )


def _forward(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve ``lower @ y = b`` by substitution, for all columns of ``b`` at once.

    Blocks of rows keep most of the work in matrix products.
    """
    size, width = len(lower), 32
    out = np.empty_like(b)
    for at in range(0, size, width):
        to = min(size, at + width)
        rest = b[at:to] - lower[at:to, :at] @ out[:at]
        for k in range(at, to):
            out[k] = (rest[k - at] - lower[k, at:k] @ out[at:k]) / lower[k, k]
    return out


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured on them.

    Components without variance are left out.
    """
    live = model.values > 0
    width = int(live.sum())
    if not width:
        return 0.0

    def of(x: np.ndarray) -> np.ndarray:
        # the last column sums the others, to centre the covariance
        return np.column_stack([model.project(x)[:, live], np.ones(len(x))])

    moments = _gram(rows, len(model.sums), of) / model.n
    mean = moments[:width, width]
    covariance = moments[:width, :width] - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(width)).max())


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id",
    vector: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``.

    One row for each usable row of ``embeddings`` and each component, from 1. Vectors that
    are null or hold null or non-finite entries are dropped. The components are fitted on
    each distinct vector once, ``n`` of them. ``deviation``, a decimal, is the exact sum of
    ``(n * x - sums) ** 2``. A component without variance (all vectors equal, fewer vectors
    than components) has null ``whitened`` and ``explained`` 0 or null. Fewer dimensions than
    ``components`` give fewer rows; vectors shorter than the longest count as filled with 0;
    entries of more than ``MOST`` count as that. Repeated ids and rows are rows each, other
    columns are ignored.
    """
    bounded_batches(embeddings.sparkSession)
    given = stored(
        embeddings.where(usable(F.col(f"`{vector}`"))).select(
            F.col(f"`{vec_id}`").alias("vec_id"),
            whole_entries(F.col(f"`{vector}`"), scale).alias("x"),
        ), "vectors",
    )
    size = given.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x")))
    rows = stored(given.select(filled.alias("x")).distinct(), "distinct-vectors")
    model = fit(rows, components)
    schema = given.schema["vec_id"].dataType.simpleString()
    kind = f"vec_id {schema}, squares decimal(38,0), cross decimal(38,0), whitened array<double>"
    if model is None:
        out = given.where("false").select(
            "vec_id", *[F.lit(0).cast("decimal(38,0)").alias(c) for c in ("squares", "cross")],
            F.lit(None).cast("array<double>").alias("whitened"),
        )
        n, total, error, shares = 0, 0, 0.0, []
    else:
        error = identity_error(rows, model)
        n, total = model.n, sum(s * s for s in model.sums)
        shares = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
        shared = given.sparkSession.sparkContext.broadcast(model)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                x = _matrix(b.column("x"), len(m.sums))
                w = m.project(x)
                ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), *_exact(x, m.sums),
                     pa.ListArray.from_arrays(pa.array(ends), flat)],
                    ["vec_id", "squares", "cross", "whitened"],
                )

        out = given.mapInArrow(project, kind)
    number = F.lit(n).cast("decimal(20,0)")
    # n^2 * sum(x^2) - 2 n * sum(x * sums) + sum(sums^2)
    deviation = (
        number * (number * F.col("squares") - 2 * F.col("cross")) + F.lit(total).cast("decimal(38,0)")
    ).cast("decimal(38,0)")
    share = F.array(*[F.lit(s).cast("double") for s in shares]) if shares else F.lit(None).cast("array<double>")
    return out.select(
        "vec_id", deviation.alias("deviation"), F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        "deviation", "whitened", F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
