"""Search, whitening and language-model scores against brute force, with odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticiario.llm import interpolation, search, whitening

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, best):
    """Brute force over (id, text) pairs; items are told apart by their place."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(text) if c[t]
            )
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        found.sort()
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(found[:best])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "A b, C! w3 w3", "x"), (2, None, "x"), (3, "", "x"), (1, "abc other-text", "x"),
        (None, "ÀB über w1 w2 " + "w5 " * 50, "x"), (5, "nothing known", "x"), (6, "...", "x"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


@pytest.mark.parametrize("best, block_terms, cells, buffer", [(20, 200_000, 1 << 20, 1 << 18), (2, 3, 4, 1)])
def test_search(odd_docs, items, best, block_terms, cells, buffer, monkeypatch):
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "BUFFER", buffer)
    got = search.search(odd_docs, items, best=best, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    wanted = ranked(docs, [(r.item_id, r.text) for r in items.collect()], best)
    assert sorted((tuple(r) for r in got.collect()), key=str) == wanted
    assert {r.rank for r in got.collect()} >= {1, 2}


def test_search_without_rows(odd_docs, no_docs, items):
    assert search.search(no_docs, items).count() == 0
    assert search.search(odd_docs, items.limit(0)).count() == 0


def test_search_terms_with_equal_first_hash():
    index = search.Index.of(["a b c"])
    index.terms[:] = index.terms[0]  # as if all first hashes were equal
    index.checks.sort()
    words = next(iter(search.chunks(search.folded(pa.array(["c x A b a"])))))[2]
    plain = search.Words.hashes
    search.Words.hashes = lambda self, seed=0: np.full(len(self), index.terms[0])
    try:
        hit, place = index.places(words)
    finally:
        search.Words.hashes = plain
    assert hit.tolist() == [0, 2, 3, 4] and place[1] == place[3] and len(set(place.tolist())) == 3


def test_search_hot_term(spark):
    """A word in every document weighs nothing; ties of many copies go by id."""
    docs = spark.range(5000).select(
        (5000 - F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "common needle").otherwise("common hay").alias("text"),
    ).repartition(7)
    item = spark.createDataFrame([(1, "common needle common")], "item_id long, text string")
    got = search.search(docs, item, best=5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 5, 8, 11, 14] and len({r.score for r in got}) == 1


VECTORS = [
    (1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 7.5]), (3, [1.0, 2.0, 3.0]), (3, [0.1, -0.7, 0.2]),
    (None, [0.5, 1.0, 1.5]), (4, None), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 2.0]),
    (7, [float("inf"), 1.0, 2.0]), (8, [-3.0, 2.0, 0.0]), (9, [0.0, -1.0, 5.0]),
]


def by_hand(rows, scale=256):
    usable = [(k, v) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(scale * np.array(v)) for _, v in usable]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - sums / n).astype(np.float64)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return usable, x, n, sums, values[::-1], vectors[:, ::-1]


def test_whitening(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("n", F.lit("x"))
    got = whitening.whiten(df.repartition(3)).collect()
    usable, x, n, sums, values, vectors = by_hand(VECTORS)
    assert len(got) == 3 * len(usable) and {r.n for r in got} == {n}
    deviations = ((n * x - sums) ** 2).sum(axis=1)
    assert sorted(int(r.deviation) for r in got) == sorted(np.repeat(deviations, 3).tolist())
    for k in range(3):
        mine = {int(r.deviation): r for r in got if r.component == k + 1}
        wanted = (x - sums / n) @ vectors[:, k] / np.sqrt(values[k])
        seen = np.array([mine[int(d)].whitened for d in deviations])
        assert min(np.abs(seen - wanted).max(), np.abs(seen + wanted).max()) < 1e-9
        assert all(math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9) for r in mine.values())
    assert {r.identity_error for r in got}.pop() < 1e-10


def test_whitening_of_poor_tables(spark):
    kind = "vec_id long, embedding array<float>"
    line = spark.createDataFrame([(k, [1.0 * k, 2.0 * k, 5.0]) for k in range(9)], kind)
    rows = whitening.whiten(line).collect()
    assert {r.component for r in rows if r.whitened is not None} == {1}
    assert {r.explained for r in rows if r.component > 1} == {0.0}
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], kind)
    rows = whitening.whiten(same).collect()
    assert len(rows) == 8 and all(r.whitened is None and r.deviation == 0 and r.n == 1 for r in rows)
    assert whitening.whiten(same.limit(0)).count() == 0
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 3.0, 4.0]), (3, []), (4, [2.0, 0.0])], kind)
    assert whitening.whiten(ragged).count() == 12
    large = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [5.0, 2.0])], kind)
    n, sums, x = 3, [5 * 256, 5 * 256], (1 << 31, 256)
    found = {r.vec_id: int(r.deviation) for r in whitening.whiten(large).collect()}
    assert found[1] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))


def test_whitening_of_an_ill_conditioned_table(spark):
    """The variances of two directions differ by 10^19: a plain covariance loses the last."""
    rng = np.random.default_rng(0)
    a = rng.normal(size=(400, 4))
    a[:, 3] = a[:, 0] + 1e-9 * a[:, 2]
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(a)], "vec_id long, embedding array<double>")
    x = df.select(whitening.whole_entries(df.embedding, 2**29).alias("x"))
    model = whitening.fit(x, 4)
    rows = np.array([r.x for r in x.collect()]).astype(np.longdouble)
    wanted = np.linalg.svd((rows - rows.mean(axis=0)).astype(float))[1] ** 2 / len(rows)
    assert np.allclose(model.values, wanted, rtol=1e-3) and model.passes >= 2
    assert whitening.identity_error(x, model) < 1e-4


def scores(docs, held_out, mix):
    """Brute force with the weights of a fitted mix."""
    start, end = object(), object()
    tokens = [(d, out, [*WORD.findall((t or "").translate(LOWER)), end]) for (d, t), out in zip(docs, held_out, strict=True)]
    one, two, texts = Counter(), Counter(), 0
    for _, out, words in tokens:
        if not out:
            one.update(words)
            two.update(zip([start, *words], words, strict=False))
            texts += 1
    n, v = sum(one.values()), len(one)
    found = []
    for d, out, words in tokens:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in words)
        score = 0.0
        for a, b in zip([start, *words], words, strict=False):
            context = texts if a is start else one[a]
            w = mix.weights[min(interpolation.BUCKETS - 1, context.bit_length())]
            p = w[0] / (v + 1) + (w[1] * one[b] / n if n else 0)
            score += math.log10(p + (w[2] * two[a, b] / context if context else 0))
        found.append((d, out, len(words), sum(one[w] > 0 for w in words), n, round(base, 6), round(score, 6)))
    return sorted(found, key=str)


@pytest.fixture
def mixes(monkeypatch):
    made, learn = [], interpolation.learn
    monkeypatch.setattr(interpolation, "learn", lambda *a: made.append(learn(*a)) or made[-1])
    return made


@pytest.mark.parametrize("chunk_bytes", [1, 40_000, 1 << 23])
def test_scores(odd_docs, chunk_bytes, mixes):
    got = interpolation.interpolated_scores(odd_docs, chunk_bytes=chunk_bytes).collect()
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    held_out = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    wanted = scores(docs, held_out, mixes[0])
    assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, got)), key=str) == wanted


def test_scores_of_documents(spark, sf_small, mixes):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = interpolation.interpolated_scores(docs, chunk_bytes=50_000).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held_out = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    wanted = {r[0]: r for r in scores(rows, held_out, mixes[0])}
    assert all(math.isclose(r.score, wanted[r.doc_id][6], rel_tol=1e-6, abs_tol=1e-5) for r in got)
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known) for r in got} == {r[:4] for r in wanted.values()}
    out = [r for r in got if r.held_out]
    # learnt weights predict unseen texts better than the base does
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert np.allclose(mixes[0].weights.sum(axis=1), 1) and (mixes[0].weights >= 0).all()


def test_probabilities_sum_to_one(spark, mixes):
    """Over the vocabulary and one unknown word, after any context."""
    texts = ["a b a c", "b b a", "c a b d", "a d", "b a a c d"] * 4
    vocabulary = ["a", "b", "c", "d", None]
    docs = spark.createDataFrame(
        [(k, t, False) for k, t in enumerate(texts)]
        + [(100, "a", True), *[(101 + k, f"a {w or 'zz'}", True) for k, w in enumerate(vocabulary)]],
        "doc_id long, text string, out boolean",
    )
    # P(x, end | a) is not P(x | a), so the end is taken off with that of the text it ends
    got = interpolation.interpolated_scores(docs, F.col("out")).collect()
    mix = mixes[0]
    counts = Counter(w for t in texts for w in [*t.split(), "</s>"])
    pairs = Counter(p for t in texts for p in zip(t.split(), [*t.split()[1:], "</s>"], strict=True))
    w = mix.weights[counts["a"].bit_length()]
    n, v = sum(counts.values()), len(counts)
    p = {x: w[0] / (v + 1) + w[1] * counts[x] / n + w[2] * pairs["a", x] / counts["a"] for x in [*counts, "zz"]}
    assert math.isclose(sum(p.values()), 1.0)
    first = next(r.score for r in got if r.doc_id == 100) - math.log10(p["</s>"])
    for k, x in enumerate(vocabulary):
        assert next(r.score for r in got if r.doc_id == 101 + k) < first + math.log10(p[x or "zz"])


def test_scores_without_rows(spark, odd_docs, no_docs):
    assert interpolation.interpolated_scores(no_docs).count() == 0
    rows = interpolation.interpolated_scores(odd_docs, F.lit(True)).collect()
    assert len(rows) == odd_docs.count() and {r.train_tokens for r in rows} == {0}
    assert all(r.n_known == 0 and r.score == 0 for r in rows)
    with pytest.raises(ValueError, match="order"):
        interpolation.interpolated_scores(odd_docs, order=4)


def test_learning_finds_the_better_estimate():
    """Held-out tokens that only pairs explain take their weight to pairs, and the other way."""
    levels = interpolation.levels_of(2)
    middle = levels // 2
    cells = np.array([(5 * levels + middle) * levels + middle + 10, (9 * levels + middle + 10) * levels + middle])
    logs = np.array([[0.0, 5.0], [5.0, 0.0]])
    mix = interpolation.learn(interpolation.Mix(10, (5, 5)), cells, np.array([1000.0, 1000.0]), logs)
    assert mix.weights[5, 2] > 0.95 and mix.weights[9, 1] > 0.95
    assert (mix.weights[6] == mix.weights[5]).all()


def test_packed_counts():
    counts = np.array([0, 1, 254, 255, 256, 10**12, 3])
    data = np.frombuffer(interpolation.packed(counts) + b"rest", dtype=np.uint8)
    found, rest = interpolation.unpacked(data, len(counts))
    assert found.tolist() == counts.tolist() and rest.tobytes() == b"rest"
